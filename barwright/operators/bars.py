"""Bars from events, and the row operators on bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.exprs import by_symbol, whole

PRICES = ("open", "high", "low", "close", "volume")


def hourly_bars(events: DataFrame) -> DataFrame:
    """One bar per event type and hour; partial aggregates combine before the one shuffle."""
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return events.groupBy(F.col("event_type").alias("symbol"), at.alias("bar_ts")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )


def normal_name(header: str) -> str:
    return header.strip().lower().replace(" ", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(normal_name(c) for c in df.columns))


def coerce(df: DataFrame, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """Numbers where they can be read (NaN counts as missing); rows with a missing one go."""
    number = lambda c: F.col(c).try_cast("double")
    return df.withColumns({c: F.when(~F.isnan(number(c)), number(c)) for c in columns}).dropna(subset=list(columns))


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_ts")))).where(F.col("_place") <= n).drop("_place")


def time_window(df: DataFrame, days: int) -> DataFrame:
    """Bars up to `days` before each symbol's last one. The last times are few rows and are joined back."""
    last = df.groupBy("symbol").agg((F.max("bar_ts") - F.make_dt_interval(F.lit(days))).alias("_from"))
    return df.join(last, "symbol").where("bar_ts >= _from").drop("_from")


def stack(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def range_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.count_distinct("close").alias("n_closes"),
    )


def numbered(df: DataFrame) -> DataFrame:
    """rn: each bar's place from 1; n_bars: bars of its symbol."""
    return df.withColumns({"rn": F.row_number().over(by_symbol()), "n_bars": F.count("*").over(whole())})
