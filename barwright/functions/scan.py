"""Recursive indicators of histories of any length, exactly, with no task that sees a whole one.

A smoother is an affine map of its last value, so a slice of bars can say what it does to any state without knowing it. Slices say so
in parallel, the few numbers of a symbol's slices are composed in order, and every slice is finished from its true start. Indicators
that smooth what other smoothers made (the MACD's signal, the trend of the ADX) take one more such pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .recursive import COLUMNS, Smoother, SymbolState

#: Bars of a slice, about: one has whole months.
SLICE_ROWS = 8192
NUMBERS = "array<double>"


def with_slices(df: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """Adds _slice: months of a symbol follow each other in slices of at least `rows` bars and at most a month's more, the last one aside.

    Only the counts of months meet by symbol.
    """
    df = df.withColumn("_month", F.date_trunc("month", "bar_ts"))
    months = df.groupBy("symbol", "_month").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = months.withColumn("_slice", F.floor(before / rows).cast("long")).drop("_n")
    return df.join(months, ["symbol", "_month"]).drop("_month")


def _by_slice(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole slices of frames that come sorted by symbol and slice."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        symbol, number = frame.symbol.to_numpy(), frame["_slice"].to_numpy()
        cut = (np.flatnonzero((symbol[1:] != symbol[:-1]) | (number[1:] != number[:-1])) + 1).tolist()
        for a, b in zip([0, *cut], [*cut, len(frame)], strict=True):
            part = frame.iloc[a:b]
            if held and (held[-1].symbol.iloc[-1], held[-1]["_slice"].iloc[-1]) != (part.symbol.iloc[0], part["_slice"].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _begun(part: pd.DataFrame) -> SymbolState:
    """A state that knows the bar before the slice, and nothing else."""
    state, first = SymbolState(), part.iloc[0]
    if first["_before"] is not None:
        state.begun, state.last = True, tuple(np.nan if v is None else float(v) for v in first["_before"])
    return state


def _series(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(part[c].to_numpy(float) for c in ("p", "high", "low"))


def _starts(summaries: DataFrame, smoothers: Callable[[SymbolState], dict[str, Smoother]], name: str) -> DataFrame:
    """(symbol, _slice, name): the smoothers' states at the start of every slice, from the slices' summaries in order."""

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, held = None, {}
        for frame in frames:
            out = []
            for s, summary in zip(frame.symbol, frame.summary, strict=True):
                if s != symbol:
                    symbol, held = s, smoothers(SymbolState())
                out.append([v for f in held.values() for v in f.state()])
                at = 0
                for f in held.values():
                    f.advance(list(summary[at : at + 2 + f.seed]))
                    at += 2 + f.seed
            yield pd.DataFrame({"symbol": frame.symbol, "_slice": frame["_slice"], name: out})

    return summaries.repartition("symbol").sortWithinPartitions("symbol", "_slice").mapInPandas(compose, f"symbol string, _slice long, {name} {NUMBERS}")


def _restored(smoothers: dict[str, Smoother], state: np.ndarray) -> None:
    for k, f in enumerate(smoothers.values()):
        f.restore(state[4 * k : 4 * k + 4])


def recursive_scan(df: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """As `recursive`: adds the recursive indicators to bars with a price `p`. Slices of about `rows` bars are the tasks' units.

    The results are those of one pass from the first bar to the last, whatever the slices, but for rounding. Bars are dealt by
    symbol and slice; summaries, a few hundred numbers a slice, are dealt by symbol.
    """
    columns = [c for c in df.columns if c not in COLUMNS]
    df = with_slices(df.select(*columns), rows)
    last = df.groupBy("symbol", "_slice").agg(F.max_by(F.array(*(F.col(c).cast("double") for c in ("p", "high", "low"))), "bar_ts").alias("_last"))
    before = last.select("symbol", "_slice", F.lag("_last").over(Window.partitionBy("symbol").orderBy("_slice")).alias("_before"))
    dealt = lambda d: d.repartition("symbol", "_slice").sortWithinPartitions("symbol", "_slice", "bar_ts")
    df = df.join(before, ["symbol", "_slice"])
    narrow = df.select("symbol", "_slice", "bar_ts", "p", "high", "low", "_before")
    shape = f"symbol string, _slice long, summary {NUMBERS}"

    def told(part: pd.DataFrame, summary: list[float]) -> pd.DataFrame:
        return pd.DataFrame({"symbol": part.symbol.iloc[:1], "_slice": part["_slice"].iloc[:1], "summary": [summary]})

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_slice(frames):
            state = _begun(part)
            series = state.inputs(*_series(part))
            yield told(part, [v for k, f in state.first.items() for v in f.summary(series[k])])

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_slice(frames):
            state = _begun(part)
            _restored(state.first, part["_first"].iloc[0])
            got = state.made(*_series(part))
            yield told(part, [v for k, f in zip(("macd", "strength"), state.second.values(), strict=True) for v in f.summary(got[k])])

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_slice(frames):
            state = _begun(part)
            _restored(state.first, part["_first"].iloc[0])
            _restored(state.second, part["_second"].iloc[0])
            yield part[columns].assign(**state.step(*_series(part)))

    starts = _starts(dealt(narrow).mapInPandas(first, shape), lambda s: s.first, "_first")
    ends = _starts(dealt(narrow.join(starts, ["symbol", "_slice"])).mapInPandas(second, shape), lambda s: s.second, "_second")
    result = T.StructType([*df.select(*columns).schema.fields, *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])
    out = dealt(df.join(starts, ["symbol", "_slice"]).join(ends, ["symbol", "_slice"])).mapInPandas(finish, result)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in COLUMNS})


# Running values: each month tells its own, months are combined in order, and rows take what the months before theirs come to.


def _months(df: DataFrame) -> DataFrame:
    return df.withColumn("_month", F.date_trunc("month", "bar_ts"))


def running(df: DataFrame, past: dict[str, str] | None = None, future: dict[str, str] | None = None, peaks: dict[str, str] | None = None, first: dict[str, str] | None = None) -> DataFrame:
    """Adds running values of named columns (new name -> column) by symbol and time; a task sorts a month of a symbol at most.

    past: the last value there has been, this row's included; future: the next there will be; peaks: the largest so far; first:
    the first row's value, null or not. Missing values count in none but the last of these.
    """
    past, future, peaks, first = (x or {} for x in (past, future, peaks, first))
    df = _months(df)
    last_of = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("bar_ts")))
    next_of = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("bar_ts")))
    told = {f"_p_{k}": last_of(c) for k, c in past.items()} | {f"_f_{k}": next_of(c) for k, c in future.items()} | {f"_m_{k}": F.max(c) for k, c in peaks.items()} | {f"_1_{k}": F.min_by(F.struct(F.col(c).alias("v")), "bar_ts") for k, c in first.items()}
    months = df.groupBy("symbol", "_month").agg(*(x.alias(k) for k, x in told.items()))
    order = Window.partitionBy("symbol").orderBy("_month")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carried = {f"_p_{k}": F.last(f"_p_{k}", ignorenulls=True).over(earlier) for k in past} | {f"_f_{k}": F.first(f"_f_{k}", ignorenulls=True).over(later) for k in future}
    carried |= {f"_m_{k}": F.max(f"_m_{k}").over(earlier) for k in peaks} | {f"_1_{k}": F.first(f"_1_{k}").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in first}
    df = df.join(months.withColumns(carried), ["symbol", "_month"])
    inside = Window.partitionBy("symbol", "_month").orderBy("bar_ts")
    so_far, from_here = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    out = {k: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_p_{k}")) for k, c in past.items()} | {k: F.coalesce(F.first(c, ignorenulls=True).over(from_here), F.col(f"_f_{k}")) for k, c in future.items()}
    out |= {k: F.greatest(F.max(c).over(so_far), F.col(f"_m_{k}")) for k, c in peaks.items()} | {k: F.col(f"_1_{k}.v") for k in first}
    return df.withColumns(out).drop("_month", *told)
