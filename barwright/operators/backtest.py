"""Backtests: one position at a time, entered on a score, left at a stop, a target or after a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.exprs import by_symbol
from barwright.functions.scan import running
from barwright.functions.slices import sliced
from barwright.schema import LOOKFORWARD, MIN_BARS, SWING_THRESHOLD
from barwright.session import shared_dir

from .bars import numbered, time_window
from .signals import levels

STEPS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("bar_ts", T.TimestampNTZType()), T.StructField("close", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("entry_ts", T.TimestampNTZType()), T.StructField("entry_price", T.DoubleType()), T.StructField("entry_probability", T.DoubleType()),
    T.StructField("exit_reason", T.StringType()), T.StructField("profit_pct", T.DoubleType()), T.StructField("bars_held", T.LongType()), T.StructField("equity", T.DoubleType()),
])


class Position:
    """One symbol's position, carried from batch to batch. Steps go from trade to trade, not from bar to bar.

    Bars that `decide` are consecutive, so a position that isn't left `lookforward` bars on stays open.
    """

    def __init__(self, threshold: float, lookforward: int):
        self.threshold, self.lookforward = threshold, lookforward
        self.entry: dict | None = None
        self.realised = 1.0

    def walk(self, bars: pd.DataFrame, decide: np.ndarray) -> dict[str, np.ndarray]:
        close, score, i = bars.close.to_numpy(float), bars.score.to_numpy(float), bars.i.to_numpy(np.int64)
        stop, take, at = bars.stop_loss.to_numpy(float), bars.take_profit.to_numpy(float), bars.bar_ts.to_numpy("datetime64[ns]")
        n = len(close)
        enter = np.flatnonzero(decide & (score >= self.threshold))
        out = {
            "entry_ts": np.full(n, np.datetime64("NaT"), "datetime64[ns]"), "entry_price": np.full(n, np.nan), "entry_probability": np.full(n, np.nan),
            "exit_reason": np.full(n, None, object), "profit_pct": np.full(n, np.nan), "bars_held": np.full(n, np.nan), "equity": np.empty(n),
        }
        here = 0
        while here < n:
            if self.entry is None:
                k = int(np.searchsorted(enter, here))
                to = int(enter[k]) if k < len(enter) else n
                out["equity"][here:to] = self.realised
                if to == n:
                    break
                self.entry = {"i": i[to], "price": close[to], "probability": score[to], "ts": at[to], "stop": stop[to], "take": take[to]}
                first, here = to, to + 1
            else:
                first = here
            e = self.entry
            until = min(n, here + max(0, int(e["i"] + self.lookforward - i[here]) + 1)) if here < n else n
            left = decide[here:until] & ((close[here:until] <= e["stop"]) | (close[here:until] >= e["take"]) | (i[here:until] - e["i"] >= self.lookforward))
            exit_ = here + int(np.argmax(left)) if left.any() else None
            end = n if exit_ is None else exit_ + 1
            out["entry_ts"][first:end], out["entry_price"][first:end], out["entry_probability"][first:end] = e["ts"], e["price"], e["probability"]
            out["equity"][first:end] = self.realised * (1 + (close[first:end] - e["price"]) / e["price"])
            if exit_ is not None:
                profit = (close[exit_] - e["price"]) / e["price"]
                reason = "Stop-loss" if close[exit_] <= e["stop"] else "Take-profit" if close[exit_] >= e["take"] else "Max time"
                self.realised *= 1 + profit
                out["exit_reason"][exit_], out["profit_pct"][exit_], out["bars_held"][exit_], out["equity"][exit_] = reason, profit, i[exit_] - e["i"], self.realised
                self.entry = None
            here = end
        return out


def walk(scored: DataFrame, threshold: float, lookforward: int = LOOKFORWARD, start: int = MIN_BARS, tail: int | None = None, swing: float = SWING_THRESHOLD) -> DataFrame:
    """Every bar with the state of its symbol's position: entry, exit reason and profit, equity marked to market.

    Bars need close, score and atr_14. Decisions fall on bars start <= i < n - tail (`tail` is `lookforward` if not
    given). Flat: enter at a score of the threshold or more. Open: leave at the first bar after
    the entry that is at the stop, at the target, or `lookforward` bars on; never re-enter on that bar. Bars
    are dealt by symbol and sorted; the position is carried from batch to batch.
    """
    tail = lookforward if tail is None else tail
    rows = numbered(levels(scored, swing=swing)).select("symbol", "bar_ts", "close", "score", "stop_loss", "take_profit", (F.col("rn") - 1).alias("i"), "n_bars")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, position = None, Position(threshold, lookforward)
        for frame in frames:
            if not len(frame):
                continue
            names = frame.symbol.to_numpy()
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1
            parts = []
            for a, b in zip([0, *cut], [*cut, len(frame)], strict=True):
                part = frame.iloc[a:b]
                if symbol is None or names[a] != symbol:
                    symbol, position = names[a], Position(threshold, lookforward)
                decide = ((part.i >= start) & (part.i < part.n_bars - tail)).to_numpy()
                parts.append(position.walk(part, decide))
            out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            yield frame[["symbol", "bar_ts", "close", "score"]].assign(**out).astype({"bars_held": "Int64"})[STEPS.names]

    return rows.repartition("symbol").sortWithinPartitions("symbol", "bar_ts").mapInPandas(run, STEPS)


def _places(df: DataFrame) -> DataFrame:
    """Adds i, each bar's place in its symbol's history from 0, and n_bars; months are counted, and a task numbers one at a time."""
    df = df.withColumn("_month", F.date_trunc("month", "bar_ts"))
    order, whole = Window.partitionBy("symbol").orderBy("_month"), Window.partitionBy("symbol")
    months = df.groupBy("symbol", "_month").agg(F.count("*").alias("_n"))
    months = months.select("symbol", "_month", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n_bars"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("symbol", "_month").orderBy("bar_ts")) - 1
    return df.join(months, ["symbol", "_month"]).withColumn("i", place).drop("_month", "_before")


def reachable(jumps: DataFrame, begin: DataFrame) -> DataFrame:
    """(symbol, i) of all nodes that a walk along `jumps` (symbol, i, to) meets from `begin` (symbol, i), by pointer doubling.

    Each round joins what is reached with jumps twice as long as the round's before, so the rounds grow with the logarithm of the walk.
    """
    shared_dir(jumps.sparkSession)
    jumps, reached, seen = jumps.where("to is not null").checkpoint(), begin.checkpoint(), -1
    while (now := reached.count()) != seen:
        seen = now
        far = reached.join(jumps, ["symbol", "i"]).select("symbol", F.col("to").alias("i"))
        reached = reached.unionByName(far).distinct().checkpoint()
        ahead = jumps.select("symbol", F.col("i").alias("to"), F.col("to").alias("beyond"))
        jumps = jumps.join(ahead, ["symbol", "to"]).select("symbol", "i", F.col("beyond").alias("to")).checkpoint()
    return reached


def walk_long(scored: DataFrame, threshold: float, lookforward: int = LOOKFORWARD, start: int = MIN_BARS, tail: int | None = None, swing: float = SWING_THRESHOLD, slice_rows: int = 1 << 16) -> DataFrame:
    """What `walk` gives, for histories of any length: no task sees a whole one.

    Where an entry at a bar would be left is told for every bar that could be one, from the `lookforward` bars after it, in slices
    of `slice_rows`. The bar after that exit points to the next possible entry, and pointer doubling finds those that are
    reached. Their profits and positions are then carried to the other bars month by month.
    """
    tail = lookforward if tail is None else tail
    shared_dir(scored.sparkSession)
    rows = _places(levels(scored, swing=swing).select("symbol", "bar_ts", "close", "score", "stop_loss", "take_profit")).checkpoint()
    decides = lambda i: (i >= start) & (i < F.col("n_bars") - tail)

    def left(d: DataFrame) -> DataFrame:
        ahead = F.collect_list(F.struct("i", "close", "bar_ts")).over(by_symbol().rowsBetween(1, lookforward))
        out = lambda x: decides(x["i"]) & (F.coalesce((x["close"] <= F.col("stop_loss")) | (x["close"] >= F.col("take_profit")), F.lit(False)) | (x["i"] - F.col("i") >= lookforward))
        return d.withColumn("_ahead", ahead).withColumn("_exit", F.try_element_at(F.filter("_ahead", out), F.lit(1))).drop("_ahead")

    may = decides(F.col("i")) & (F.col("score") >= threshold)
    told = sliced(rows, left, back=0, ahead=lookforward, rows=max(slice_rows, lookforward)).withColumn("_may", F.when(may, F.col("i")))
    told = running(told, future={"_next": "_may"}).select(*rows.columns, "_exit", "_may", "_next").checkpoint()
    entries = told.where("_may is not null").select("symbol", "i", (F.col("_exit.i") + 1).alias("after"))
    following = told.select("symbol", F.col("i").alias("after"), F.col("_next").alias("to"))
    begin = told.groupBy("symbol").agg(F.min("_may").alias("i")).where("i is not null")
    taken = reachable(entries.join(following, ["symbol", "after"]).select("symbol", "i", "to"), begin)
    trade = F.struct("i", F.col("bar_ts").alias("ts"), F.col("close").alias("price"), F.col("score").alias("probability"), "stop_loss", "take_profit", F.col("_exit.i").alias("end"))
    held = told.join(taken.withColumn("_taken", F.lit(True)), ["symbol", "i"], "left").withColumn("_trade", F.when(F.col("_taken"), trade))
    held = running(held, past={"_last": "_trade"})
    t = F.col("_last")
    inside = t.isNotNull() & (t["end"].isNull() | (F.col("i") <= t["end"]))
    profit = F.when(F.coalesce(F.col("i") == t["end"], F.lit(False)), (F.col("close") - t["price"]) / t["price"])
    reason = F.when(F.col("close") <= t["stop_loss"], "Stop-loss").when(F.col("close") >= t["take_profit"], "Take-profit").otherwise("Max time")
    held = held.withColumns({"_inside": inside, "profit_pct": profit, "_month": F.date_trunc("month", "bar_ts")})
    months = held.groupBy("symbol", "_month").agg(F.product(F.coalesce(1 + F.col("profit_pct"), F.lit(1.0))).alias("_made"))
    months = months.select("symbol", "_month", F.coalesce(F.product("_made").over(Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)).alias("_made"))
    made = F.product(F.coalesce(1 + F.col("profit_pct"), F.lit(1.0))).over(Window.partitionBy("symbol", "_month").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)) * F.col("_made")
    held = held.join(months, ["symbol", "_month"]).withColumn("_realised", made)
    marked = F.when(F.col("_inside") & F.col("profit_pct").isNull(), F.col("_realised") * (1 + (F.col("close") - t["price"]) / t["price"])).otherwise(F.col("_realised"))
    when = lambda x: F.when(F.col("_inside"), x)
    closed = lambda x: F.when(F.col("profit_pct").isNotNull(), x)
    return held.select("symbol", "bar_ts", "close", "score", when(t["ts"]).alias("entry_ts"), when(t["price"]).alias("entry_price"), when(t["probability"]).alias("entry_probability"), closed(reason).alias("exit_reason"), "profit_pct", closed(F.col("i") - t["i"]).alias("bars_held"), marked.alias("equity"))


def trades(steps: DataFrame) -> DataFrame:
    """Closed positions; one still open at the end is no trade."""
    return steps.where("exit_reason is not null").select(
        "symbol", F.col("entry_ts").alias("entry_date"), F.col("bar_ts").alias("exit_date"), "entry_price", F.col("close").alias("exit_price"),
        F.floor((F.unix_micros(F.col("bar_ts").cast("timestamp")) - F.unix_micros(F.col("entry_ts").cast("timestamp"))) / 86_400_000_000).cast("long").alias("days_held"),
        "bars_held", "profit_pct", "entry_probability", "exit_reason",
    )


def summary(closed: DataFrame) -> DataFrame:
    """Per symbol with a trade: count, win rate, mean profit, compounded return."""
    return closed.groupBy("symbol").agg(
        F.count("*").alias("num_trades"), F.avg((F.col("profit_pct") > 0).cast("double")).alias("win_rate"), F.avg("profit_pct").alias("avg_profit"), (F.product(1 + F.col("profit_pct")) - 1).alias("total_return"),
        F.max("profit_pct").alias("best"), F.min("profit_pct").alias("worst"),
    )


def exit_stats(closed: DataFrame) -> DataFrame:
    return closed.groupBy("exit_reason").agg(F.count("*").alias("n_exits"), F.avg((F.col("profit_pct") > 0).cast("double")).alias("win_rate"))


def sharpe(closed: DataFrame) -> DataFrame:
    """Mean over population deviation of trade profits, times the root of 12; 0 where they don't vary."""
    both = closed.groupBy("symbol").agg(F.avg("profit_pct").alias("m"), F.stddev_pop("profit_pct").alias("s"))
    return both.select("symbol", F.when(F.round("s", 12) != 0, F.col("m") / F.col("s") * math.sqrt(12)).otherwise(0.0).alias("sharpe"))


def equity_curve(steps: DataFrame) -> DataFrame:
    return steps.select("symbol", "bar_ts", "equity")


def buy_hold(bars: DataFrame) -> DataFrame:
    """Growth since the first close; no task sees more than a month of a symbol."""
    return running(bars, first={"_first": "close"}).select("symbol", "bar_ts", F.when(F.col("_first") != 0, F.col("close") / F.col("_first")).alias("growth"))


def max_drawdown(curve: DataFrame, value: str = "equity") -> DataFrame:
    """The largest fall from a running peak, as a share of it; peaks are carried from month to month."""
    falls = running(curve, peaks={"_peak": value}).withColumn("_fall", F.when(F.col("_peak") != 0, (F.col("_peak") - F.col(value)) / F.col("_peak")).otherwise(0.0))
    return falls.groupBy("symbol").agg(F.max("_fall").alias("max_drawdown"))


def export(closed: DataFrame, path: str) -> None:
    """Trades as JSON lines."""
    closed.write.mode("overwrite").json(path)


def file_backtest(bars: DataFrame, days_back: int, threshold: float, score: Callable[[DataFrame], DataFrame], lookforward: int = LOOKFORWARD, swing: float = SWING_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(report, curves) of a backtest over the last `days_back` days of each symbol alone.

    Indicators and scores (`score` adds score and atr_14) see the window's bars only. A symbol needs MIN_BARS + lookforward + 1
    bars in it, so that a trade can be held to its end; one with fewer has a report of that and no curve. Decisions
    fall on bars MIN_BARS <= i < n - lookforward; every bar is marked to market, so total_return counts a position that is
    still open at the last one. The Sharpe ratio is 0 without trades; peak_probability is the highest score among the decisions.
    """
    recent = time_window(bars, days_back)
    counts = recent.groupBy("symbol").agg(F.count("*").alias("n_rows"))
    least = MIN_BARS + lookforward + 1
    steps = walk(score(recent), threshold, lookforward, MIN_BARS, lookforward, swing).join(counts.where(F.col("n_rows") >= least), "symbol")
    place = F.row_number().over(by_symbol()) - 1
    steps = steps.withColumn("_decides", (place >= MIN_BARS) & (place < F.col("n_rows") - lookforward))
    peak = F.max("equity").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("close").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumns({"_fall": F.when(peak != 0, (peak - F.col("equity")) / peak).otherwise(0.0), "buy_hold": F.when(first != 0, F.col("close") / first)})
    profit, deviation = F.col("profit_pct"), F.stddev_pop("profit_pct")
    found = steps.groupBy("symbol").agg(
        F.count("profit_pct").alias("num_trades"), F.coalesce(F.avg((profit > 0).cast("double")), F.lit(0.0)).alias("win_rate"), (F.max_by("equity", "bar_ts") - 1).alias("total_return"),
        F.when(F.coalesce(F.round(deviation, 12), F.lit(0.0)) != 0, F.avg("profit_pct") / deviation * math.sqrt(12)).otherwise(0.0).alias("sharpe"), F.max("_fall").alias("max_drawdown"),
        F.coalesce(F.max(F.when(F.col("_decides"), F.col("score"))), F.lit(0.0)).alias("peak_probability"),
    )
    status = F.when(F.col("n_rows") < least, "too few rows").when(F.col("num_trades") == 0, "no trades").otherwise("ok")
    return counts.join(found, "symbol", "left").withColumn("status", status), steps.select("symbol", "bar_ts", "equity", "buy_hold")
