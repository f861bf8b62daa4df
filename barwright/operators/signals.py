"""Scores, levels, and the questions asked of the latest bars: screener, monitor, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.exprs import before, clamp, last_rows
from barwright.schema import FALLBACK_SWING, MIN_BARS, MODEL_THRESHOLD, SWING_THRESHOLD

from .bars import last_n, numbered

#: A fallback score looks at so many bars.
SCORE_BARS = 31


def levels(df: DataFrame, price: str = "close", atr: str = "atr_14", swing: float = SWING_THRESHOLD) -> DataFrame:
    """stop_loss and take_profit around a price, from the swing and the average true range."""
    p, a = F.col(price), F.col(atr)
    gain = F.greatest(p * swing, 2 * a)
    return df.withColumns({"stop_loss": p - F.greatest(gain * 0.5, F.greatest(p * 0.01, a)), "take_profit": p + gain})


def confidence(p: Column) -> Column:
    sure = F.greatest(p, 1 - p)
    return F.when(sure > 0.8, "High").when(sure > 0.6, "Medium").otherwise("Low")


def fallback_confidence(p: Column) -> Column:
    return F.when(p >= 0.78, "High").when(p >= 0.6, "Medium").otherwise("Low")


def strength(p: Column, prediction: Column) -> Column:
    return F.when(prediction != 1, "NO BUY").when(p >= 0.8, "STRONG BUY").when(p >= 0.6, "MODERATE BUY").otherwise("WEAK BUY")


def fallback_scores(df: DataFrame) -> DataFrame:
    """score for every bar: momentum over 15 bars, a plain-mean RSI over 14 changes, volume against its 30-bar mean.

    All three are windows over one partitioning, so any number of symbols is one exchange and one sort.
    """
    c, v = F.col("close"), F.col("volume")
    df = df.withColumn("_move", c - before(c, 1))
    start = F.first("close").over(last_rows(15))
    up, down = F.avg(F.greatest("_move", F.lit(0.0))).over(last_rows(14)), F.avg(F.greatest(-F.col("_move"), F.lit(0.0))).over(last_rows(14))
    df = df.withColumns({"_start": start, "_up": F.when(F.count("_move").over(last_rows(14)) > 0, up), "_down": F.when(F.count("_move").over(last_rows(14)) > 0, down), "_mean": F.avg(v).over(last_rows(30))})
    df = df.withColumns({
        "momentum": F.when(F.col("_start") != 0, (c - F.col("_start")) / F.col("_start")).otherwise(0.0),
        "rsi": F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).otherwise(50.0),
        "volume_ratio": F.when(F.col("_mean") != 0, v / F.col("_mean")).otherwise(1.0),
    }).drop("_move", "_start", "_up", "_down", "_mean")
    return df.withColumn("score", fallback_probability(F.col("momentum"), F.col("rsi"), F.col("volume_ratio")))


def fallback_probability(momentum: Column, rsi: Column, volume_ratio: Column) -> Column:
    raw = F.lit(0.48) + clamp(momentum, -0.2, 0.2) * 1.7 + clamp((50 - F.abs(rsi - 55)) / 300, -0.1, 0.16) + clamp((volume_ratio - 1) * 0.08, -0.1, 0.15)
    return clamp(raw, 0.05, 0.95)


def latest_analysis(bars: DataFrame, market: str = "US", min_bars: int = 1) -> DataFrame:
    """One row per symbol that has enough bars: price, change, score, confidence, levels, currency.

    Only the bars that a score looks at are kept before the exchange, as many again as `min_bars` asks for.
    """
    last = before(F.col("close"), 1)
    df = numbered(fallback_scores(last_n(bars, max(SCORE_BARS, min_bars)))).withColumn("price_change_1d", F.when(F.coalesce(last, F.lit(0.0)) != 0, (F.col("close") - last) / last).otherwise(0.0))
    df = df.where((F.col("rn") == F.col("n_bars")) & (F.col("n_bars") >= min_bars))
    swing = FALLBACK_SWING[market]
    return df.select(
        "symbol", F.col("bar_ts").alias("as_of"), F.col("close").alias("current_price"), F.col("volume").alias("current_volume"), "price_change_1d", "rsi", F.col("score").alias("swing_probability"),
        fallback_confidence(F.col("score")).alias("confidence_level"), (F.col("close") * (1 - swing * 0.5)).alias("stop_loss"), (F.col("close") * (1 + swing)).alias("take_profit"), F.lit("KRW" if market == "KR" else "USD").alias("currency"),
    )


def screener(analysis: DataFrame) -> DataFrame:
    """Ranked by probability; ties by name."""
    return analysis.orderBy(F.desc("swing_probability"), "symbol")


def screener_failures(requested: DataFrame, analysis: DataFrame) -> DataFrame:
    """Requested symbols without an analysis."""
    return requested.select("symbol").distinct().join(analysis, "symbol", "left_anti")


def monitor(analysis: DataFrame, alert: float = MODEL_THRESHOLD) -> DataFrame:
    return analysis.where(F.col("swing_probability") >= alert).orderBy(F.desc("swing_probability"), "symbol")


def dashboard(requested: DataFrame, bars: DataFrame, names: dict[str, str], market: str = "US") -> DataFrame:
    """Every requested symbol with price, change, probability and status; unavailable ones last."""
    found = latest_analysis(bars, market, min_bars=2)
    out = requested.select("symbol").distinct().join(found, "symbol", "left")
    gone = F.col("swing_probability").isNull()
    return out.select(
        "symbol", company_name(F.col("symbol"), names).alias("company"), F.col("current_price").alias("price"), F.col("price_change_1d").alias("change"), F.coalesce("swing_probability", F.lit(0.0)).alias("probability"),
        F.when(gone, "Unavailable").otherwise(F.col("confidence_level")).alias("confidence"), F.when(gone, "unavailable").otherwise("available").alias("status"), "as_of",
    ).orderBy(F.col("status") == "unavailable", F.desc("probability"), "symbol")


def dashboard_summary(board: DataFrame) -> DataFrame:
    here = F.col("status") == "available"
    return board.agg(
        F.coalesce(F.avg(F.when(here, F.col("probability"))), F.lit(0.0)).alias("avg_probability"), F.count_if(here & (F.col("probability") >= MODEL_THRESHOLD)).alias("signals_today"),
        F.count_if(here).alias("n_available"), F.min("as_of").alias("oldest"), F.max("as_of").alias("newest"),
    )


def freshness(last: DataFrame, as_of: Column) -> DataFrame:
    """Age in days of each symbol's `last_ts`, as a date and a colour."""
    age = F.datediff(as_of, F.col("last_ts").cast("date"))
    return last.select("symbol", F.date_format("last_ts", "yyyy-MM-dd").alias("last_date"), age.alias("age_days"), F.when(age <= 3, "green").when(age <= 14, "amber").otherwise("red").alias("colour"))


FIXED_WINDOWS = (("90 days", 90), ("180 days", 180), ("1 year", 365), ("3 years", 1095))


def window_options(df: DataFrame) -> DataFrame:
    """(symbol, days) of the backtest windows a history supports: fixed ones, and five-year steps up to its span."""
    spans = df.groupBy("symbol").agg(F.datediff(F.max("bar_ts"), F.min("bar_ts")).alias("span"))
    fixed = F.filter(F.array(*(F.lit(d) for _, d in FIXED_WINDOWS)), lambda d: d <= F.col("span"))
    steps = F.floor(F.floor(F.col("span") / 365.25) / 5).cast("int")
    years = F.when(steps >= 1, F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), lambda k: k * 5 * 365)).otherwise(F.array().cast("array<int>"))
    options = F.concat(fixed, years)
    return spans.select("symbol", F.explode(F.when(F.size(options) > 0, options).otherwise(F.array(F.lit(90)))).alias("days"))


def company_name(symbol: Column, names: dict[str, str]) -> Column:
    """The symbol's name in a fixed small map, else the symbol."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[symbol], symbol) if names else symbol


def enough(df: DataFrame, n: int = MIN_BARS) -> DataFrame:
    """Bars of symbols that have at least n."""
    return numbered(df).where(F.col("n_bars") >= n).drop("rn", "n_bars")

