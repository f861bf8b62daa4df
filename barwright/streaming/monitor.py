"""The monitor as a stream: new bars come in, alerts go out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barwright.operators.bars import dedup, last_n
from barwright.operators.signals import SCORE_BARS, latest_analysis, monitor
from barwright.schema import BARS, MODEL_THRESHOLD


def stream_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly bars of an event stream, each sent once its hour is over by the watermark."""
    hour = F.window("ts", "1 hour")
    bars = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), hour.alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def monitor_stream(bars: DataFrame, folder: str, send: Callable[[DataFrame, int], None], alert: float = MODEL_THRESHOLD, market: str = "US", interval: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """After each batch of bars, send the alerts of the symbols it had.

    A score needs a symbol's last 31 bars, so that is what `folder` keeps: each batch writes the recent bars
    as they are after it, from those after the batch before and its own. A batch that is run again writes the
    same. State grows with the symbols, not with their history; folders of older batches may be deleted.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*BARS.names).persist()
        known = new.withColumn("_age", F.lit(0))
        if number:
            known = known.unionByName(spark.read.schema(BARS).parquet(f"{folder}/recent/{number - 1}").withColumn("_age", F.lit(1)))
        latest = dedup(known, ["symbol", "bar_ts"], [F.col("_age"), F.col("close"), F.col("volume")]).drop("_age")
        last_n(latest, SCORE_BARS).write.mode("overwrite").parquet(f"{folder}/recent/{number}")
        recent = spark.read.schema(BARS).parquet(f"{folder}/recent/{number}").join(new.select("symbol").distinct(), "symbol", "left_semi")
        send(monitor(latest_analysis(recent, market), alert), number)
        new.unpersist()

    writer = bars.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
