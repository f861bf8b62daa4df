"""Long histories in slices, so that one symbol's bars need not meet in one task.

Windows of bars look back a bounded way. A symbol's history can so be cut into slices that each get enough bars before (and after)
them, and what is computed in a slice's own rows is what the whole history gives. Sums from the start add up over calendar months.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _months(df: DataFrame) -> DataFrame:
    return df.withColumn("_month", F.date_trunc("month", "bar_ts"))


def _before_month(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Adds, for each named expression, its sum over the symbol's earlier months: one row per symbol and month is joined."""
    months = df.groupBy("symbol", "_month").agg(*(F.expr(x).alias(f"_sum_{k}") for k, x in sums.items()))
    run = Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("symbol", "_month", *(F.coalesce(F.sum(f"_sum_{k}").over(run), F.lit(0)).alias(f"_before_{k}") for k in sums))
    return df.join(months, ["symbol", "_month"])


def sliced(df: DataFrame, f: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, rows: int = 1 << 20) -> DataFrame:
    """f(df) for an f of windows by symbol that look at most `back` bars back and `ahead` ahead, in slices of `rows` bars."""
    if back > rows or ahead > rows:
        raise ValueError("a slice must be as long as what is looked back or ahead")
    place = F.row_number().over(Window.partitionBy("symbol", "_month").orderBy("bar_ts")) + F.col("_before_n") - 1
    df = _before_month(_months(df), {"n": "count(*)"}).withColumn("_at", place).drop("_month", "_before_n")
    own = F.floor(F.col("_at") / rows)
    df = df.withColumns({"_slice": own, "_in": F.col("_at") % rows})
    where = F.array(F.lit(0), F.when(F.col("_in") >= rows - back, 1), F.when((F.col("_in") < ahead) & (F.col("_slice") > 0), -1))
    df = df.withColumn("_step", F.explode(F.array_compact(where))).withColumn("_key", F.struct("symbol", (F.col("_slice") + F.col("_step")).alias("n")))
    df = df.withColumn("symbol", F.concat_ws("\x00", F.col("_key.symbol"), F.col("_key.n").cast("string"))).withColumns({"_name": F.col("_key.symbol"), "_mine": F.col("_step") == 0}).drop("_key", "_step", "_slice", "_in", "_at")
    out = f(df).where("_mine")
    return out.withColumn("symbol", F.col("_name")).drop("_name", "_mine")


def running_sums(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Sums from the start of each symbol; null where the added value is."""
    df = _before_month(_months(df), {k: f"sum({x})" for k, x in columns.items()})
    run = Window.partitionBy("symbol", "_month").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({k: F.when(F.col(x).isNotNull(), F.col(f"_before_{k}") + F.sum(x).over(run)) for k, x in columns.items()})
    return out.drop("_month", *(f"_before_{k}" for k in columns))
