"""Column expressions: float division, guarded rolling windows, clamps, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def by_symbol() -> WindowSpec:
    """All bar windows share this partitioning and order, so they share one exchange and sort."""
    return Window.partitionBy("symbol").orderBy("bar_ts")


def last_rows(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def whole() -> WindowSpec:
    return Window.partitionBy("symbol")


def pdiv(a: Column, b: Column) -> Column:
    """Float division: x/0 is infinite by x's sign, 0/0 and anything with null are null."""
    return F.when(b != 0, a / b).when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF))


def rolling(f: Callable[[Column], Column], c: Column, n: int) -> Column:
    """f over the last n rows, null unless all n values are there."""
    w = last_rows(n)
    got = f(c).over(w)
    return F.when((F.count(c).over(w) == n) & ~F.isnan(got.cast("double")), got)


def before(c: Column, n: int) -> Column:
    return F.lag(c, n).over(by_symbol())


def change(c: Column, n: int) -> Column:
    return pdiv(c, before(c, n)) - 1


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def zero_if(x: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0.0)).otherwise(x)


def finite(x: Column) -> Column:
    """Infinite becomes 0; null stays."""
    return zero_if(x, F.abs(x) == F.lit(INF))


def percent(x: Column) -> Column:
    """+1.2% or -1.2%."""
    return F.when(x.isNotNull(), F.concat(F.when(x >= 0, "+").otherwise(""), F.format_number(x * 100, 1), F.lit("%")))


def money(x: Column, currency: Column) -> Column:
    """$1,234.50 or KRW 1,234."""
    return F.when(currency == "KRW", F.concat(F.lit("KRW "), F.format_number(x, 0))).otherwise(F.concat(F.lit("$"), F.format_number(x, 2)))


def safe_file_name(symbol: Column) -> Column:
    """A symbol as part of a file name: no caret, slashes as underscores."""
    return F.trim(F.translate(symbol, "/\\^", "__"))
