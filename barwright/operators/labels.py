"""Forward-looking swing labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.exprs import by_symbol, pdiv
from barwright.schema import HOLD, LOOKFORWARD, MIN_LABEL_MOVE, SWING_THRESHOLD

from .bars import numbered


def swing_labels(df: DataFrame, lookforward: int = LOOKFORWARD, swing: float = SWING_THRESHOLD, drop_tail: bool = False) -> DataFrame:
    """swing_label, swing_profit_potential, swing_risk from the highs and lows of bars 3 to `lookforward` ahead.

    The last `lookforward` bars of a symbol have no full future: they get 0, or go with `drop_tail`.
    """
    least = max(MIN_LABEL_MOVE, 0.5 * swing)
    df = numbered(df)
    if lookforward >= HOLD:
        ahead = by_symbol().rowsBetween(HOLD, lookforward)
        up, down = pdiv(F.max("high").over(ahead) - F.col("p"), F.col("p")), pdiv(F.col("p") - F.min("low").over(ahead), F.col("p"))
    else:
        up = down = F.lit(None).cast("double")
    inside = F.col("rn") <= F.col("n_bars") - lookforward
    df = df.withColumns({"_up": up, "_down": down, "_inside": inside})
    hit = F.col("_inside") & F.coalesce(F.col("_up") >= least, F.lit(False))
    df = df.withColumns({"swing_label": hit.cast("int"), "swing_profit_potential": F.when(hit, F.col("_up")).otherwise(0.0), "swing_risk": F.when(hit, F.col("_down")).otherwise(0.0)})
    return (df.where("_inside") if drop_tail else df).drop("_up", "_down", "_inside", "rn", "n_bars")


def label_summary(df: DataFrame) -> DataFrame:
    hit = F.col("swing_label") == 1
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.count_if(hit).alias("n_positive"), (100 * F.avg("swing_label")).alias("pct_positive"),
        F.avg(F.when(hit, F.col("swing_profit_potential"))).alias("avg_profit"), F.avg(F.when(hit, F.col("swing_risk"))).alias("avg_risk"),
    )
