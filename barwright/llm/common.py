"""Helpers shared by the text operators: reading, materialising, Arrow buffers, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.session import shared_dir

SLICE_BYTES = 256 << 10
BATCH_ROWS = 1000
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that were written outside of any run; a run has a list of its own, in its own thread.
WRITTEN: list[str] = []
OF_RUN: ContextVar[list[str]] = ContextVar("tables of this run", default=WRITTEN)


@contextmanager
def tables_of_run() -> Iterator[list[str]]:
    """What is materialised inside belongs to this run alone; what it has left at its end counts as written outside."""
    mine: list[str] = []
    token = OF_RUN.set(mine)
    try:
        yield mine
    finally:
        OF_RUN.reset(token)
        OF_RUN.get().extend(mine)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends at files that all executors see.

    Results that read the files may be used long after, so they stay until drop_materialised(). The shuffles behind
    them are of no more use and go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before) if before is not None else spark.conf.unset(CLEAN_SHUFFLES)
    OF_RUN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession, keep: int = 0) -> int:
    """Delete what this run (outside of any: this process) has materialised, once its results are written elsewhere; says how many tables.

    The newest `keep` stay.
    """
    jvm, conf, dropped, written = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0, OF_RUN.get()
    for path in written[: len(written) - keep]:
        written.remove(path)
        at = jvm.org.apache.hadoop.fs.Path(path)
        dropped += bool(at.getFileSystem(conf).delete(at, True))
    return dropped


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, for small or short-lived frames that the cleaner may drop."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python in batches of 1,000 rows where the session has Spark's default of 10,000: a tenth of the memory."""
    if df.sparkSession.conf.get(ARROW_ROWS) == "10000":
        df.sparkSession.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return df


def text_bytes(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and the text as UTF-8 bytes (plus named columns); any other input column is left out."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *extra)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and the n+1 offsets into it; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.array([x or b"" for x in column.to_pylist()], pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of about `limit` bytes of one binary column, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of runs values[offsets[i]:offsets[i+1]]; empty runs sum to 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, share: int = 1000, how: str = "left") -> DataFrame:
    """Rows with the columns of their class, null where there is none (or left out, if `how` is inner); `classes` has one row per key and its number of rows.

    Classes of over 1 / `share` of all rows, fewer than `share` of them whatever the data, go by broadcast, so no task
    gets all rows of a hot one; the others are joined by key.
    """
    total = classes.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * share > total
    near = rows.join(F.broadcast(classes.where(hot)), keys)
    far = rows.join(F.broadcast(classes.where(hot).select(*keys)), keys, "left_anti").join(classes.where(~hot), keys, how)
    return near.unionByName(far)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b), the smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of long edges (a, b): rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps; each round is a pair of shuffles of edges only, written to
    the checkpoint folder. Only a count and a checksum reach the driver.
    """
    pair = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = checkpointed(pair(edges.select("a", "b"))), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pair(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m", "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = checkpointed(pair(small))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
