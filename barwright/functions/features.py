"""All 108 features of a table of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exprs import before, change
from .indicators import lags, native, with_price
from .recursive import COLUMNS, dependants, recursive
from .scan import recursive_scan
from .slices import running_sums, sliced


#: Windows look back so many bars at most: 200 of an average, 5 of its slope, and some to spare.
BACK = 256
#: From so many bars of one symbol on, histories are cut.
LONG = 1 << 17


def slices_for(bars: DataFrame) -> int | None:
    """The bars of a slice if some symbol has over LONG bars, else None: one count by symbol, one number to the driver."""
    longest = bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    return LONG // 2 if longest > LONG else None


def all_features(bars: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """The recursive pass first (one exchange), then every window over one more exchange and sort.

    With `slice_rows` histories are cut into slices of about so many bars, for tables in which a few symbols hold most of
    them: recursive indicators by an exact scan, windows with the bars they look back at, running sums by month. The features
    are the same but for rounding.
    """
    df = with_price(bars)
    if slice_rows is None:
        return lags(dependants(native(recursive(df))))
    traded = df.groupBy("symbol").agg((F.sum("volume") > 0).alias("_traded"))
    names = [*df.columns, *COLUMNS, "_traded"]

    def steps(d: DataFrame) -> DataFrame:
        p, v = F.col("p"), F.col("volume")
        return lags(dependants(native(d))).withColumns({"_gain": change(p, 1) * v, "_flow": F.when(p < before(p, 1), -v).otherwise(v)})

    df = recursive_scan(df, slice_rows).join(traded, "symbol").select(*names)
    out = running_sums(sliced(df, steps, back=min(BACK, slice_rows), rows=slice_rows), {"volume_price_trend": "_gain", "on_balance_volume": "_flow"})
    return out.withColumns({c: F.when(F.col("_traded"), F.col(c)).otherwise(0.0) for c in ("volume_price_trend", "on_balance_volume")}).drop("_gain", "_flow", "_traded")
