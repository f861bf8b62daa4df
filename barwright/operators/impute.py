"""Filling of missing features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.exprs import by_symbol, finite, rolling
from barwright.functions.scan import running


def fill(df: DataFrame, columns: list[str], how: str = "both") -> DataFrame:
    """Missing values take the last one before them in their symbol and, with how="both", else the next after.

    The second pulls later values backwards; how="ffill" leaves it out. Infinite values count as values. Where no value comes before,
    the next after is the symbol's first one: it is found once for a symbol, not from every row on.
    """
    past, every = by_symbol().rowsBetween(Window.unboundedPreceding, 0), by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for c in columns:
        out[c] = F.last(c, ignorenulls=True).over(past)
        if how == "both":
            out[c] = F.coalesce(out[c], F.first(c, ignorenulls=True).over(every))
    return df.withColumns(out)


def fill_long(df: DataFrame, columns: list[str], how: str = "both") -> DataFrame:
    """As `fill`, for histories of any length: months are filled for themselves, and from the months before and after."""
    out = running(df, past={f"_past_{c}": c for c in columns}, future={f"_future_{c}": c for c in columns} if how == "both" else {})
    filled = {c: F.coalesce(*(F.col(f"_{side}_{c}") for side in (("past", "future") if how == "both" else ("past",)))) for c in columns}
    return out.withColumns(filled).select(*df.columns)


def clean(df: DataFrame, columns: list[str], zero_missing: bool = False) -> DataFrame:
    """Infinite values become 0, and with `zero_missing` so do missing ones."""
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(0.0)) if zero_missing else finite(F.col(c)) for c in columns})


def default_value(name: str) -> Column:
    """What stands in for a feature that a short history doesn't have, by its name; the first rule that fits."""
    if "sma" in name or "ema" in name:
        return F.coalesce(rolling(F.avg, F.col("close"), 20), F.col("close"))
    for part, value in (("rsi", 50.0), ("volume", 1.0), ("price_change", 0.0), ("ratio", 1.0)):
        if part in name:
            return F.lit(value)
    return F.lit(0.0)


def with_defaults(df: DataFrame, columns: list[str], zeros: bool = False) -> DataFrame:
    """Columns that a symbol lacks altogether get their default (0 with `zeros`)."""
    missing = {c: F.count(c).over(Window.partitionBy("symbol")) == 0 for c in columns}
    return df.withColumns({c: F.when(missing[c], F.lit(0.0) if zeros else default_value(c)).otherwise(F.col(c)) for c in columns})
