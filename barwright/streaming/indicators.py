"""Recursive indicators of a stream of bars: one state a symbol, kept by Spark between batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barwright.functions.recursive import COLUMNS, SymbolState

INPUTS = ("p", "high", "low")
OUT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("bar_ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in (*INPUTS, *COLUMNS))])
STATE = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("last_ms", T.LongType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SymbolProcessor(StatefulProcessor):
    """A symbol's smoothers as some 80 numbers. Bars of a batch are taken by time; one not after the last bar taken is dropped.

    Where the watermark is `stale_seconds` beyond a symbol's last bar, its state goes: its next bar begins a history.
    """

    def __init__(self, stale_seconds: float):
        self.stale_ms = int(stale_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("symbol", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("bar_ts", kind="stable")
        state, last = SymbolState(), None
        if (held := self.held.get()) is not None:
            state, last = state.restore([np.nan if v is None else v for v in held[0]]), held[1]
        at = frame["ms"].to_numpy(np.int64)
        if last is not None:
            frame, at = frame[at > last], at[at > last]
        frame = frame[np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]]
        if not len(frame):
            return
        out = state.step(*(frame[c].to_numpy(float) for c in INPUTS))
        last = int(frame["ms"].iloc[-1])
        self.held.update(([None if np.isnan(v) else float(v) for v in state.state()], last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.stale_ms)
        yield frame[["symbol", "bar_ts", *INPUTS]].assign(**out).reset_index(drop=True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of many symbols is kept by RocksDB; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stream_recursive(bars: DataFrame, late: str = "2 days", stale_seconds: float = 30 * 86_400) -> DataFrame:
    """The recursive indicators of every bar of a stream, as `recursive` gives them for the whole table of bars.

    Bars have a price `p`. What comes over `late` after bars of any symbol is dropped, and so is a bar that isn't after its symbol's
    last one, as the recursion can't go back. State grows with the symbols, not with their histories, and comes back from the
    checkpoint when the stream restarts.
    """
    use_rocksdb(bars.sparkSession)
    at = F.col("bar_ts").cast("timestamp")
    rows = bars.select("symbol", at.alias("bar_ts"), F.unix_millis(at).alias("ms"), *(F.col(c).cast("double").alias(c) for c in INPUTS)).where("symbol is not null and bar_ts is not null").withWatermark("bar_ts", late)
    out = rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=SymbolProcessor(stale_seconds), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in COLUMNS}).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
