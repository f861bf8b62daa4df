"""Bounded, deterministic samples of labelled rows, by fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

MILLION = 1_000_000
#: A draw takes this much more than is asked for, since counts of distinct rows are estimates; what is over is cut.
MARGIN = 1.4


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def in_fold(doc_id: str, folds: int, number: int) -> Column:
    """Whether an id is in a fold; a null id is in none."""
    return F.coalesce(fold(doc_id, folds) == number, F.lit(False))


def sample_by_class(rows: DataFrame, label: str, per_class: int, seed: int, max_rows: int = 100_000, text: str | None = None) -> DataFrame:
    """At most `per_class` distinct rows of each class, and about `max_rows` in all, chosen by a hash of doc_id and (if named) `text`.

    Every class takes part: where there are more than max_rows / per_class of them, each gives less, but one row at least. Distinct
    rows are counted by a sketch and drawn by their hash; then repeats go, and of each class the first by hash stay. So
    neither an id nor a text that many rows have makes the sample larger, and no task sorts more than a little over it.
    """
    mark = F.xxhash64(F.col("doc_id"), *([F.col(text)] if text else []), F.lit(seed))
    counts = materialise(rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct(mark, 0.03).alias("_rows")), "classes")
    each = max(1, min(per_class, max_rows // max(1, counts.count())))
    drawn = rows.join(counts, label).where(F.pmod(mark, F.lit(MILLION)) < F.lit(MARGIN * each * MILLION) / F.col("_rows") + 1).drop("_rows")
    place = F.row_number().over(Window.partitionBy(label).orderBy("_mark"))
    return drawn.withColumn("_mark", mark).dropDuplicates([label, "_mark"]).withColumn("_place", place).where(F.col("_place") <= each).drop("_place", "_mark")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, label): at most `per_class` distinct labelled documents of each class, with their whole texts, materialised.

    Null ids or labels are left out; of an id's labels the largest holds. Ids are drawn first, then the documents that have them, so
    an id of many documents adds no more than others. Equal texts under one id are one document.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(learnable)
    ids = materialise(sample_by_class(rows.groupBy("doc_id").agg(F.max("label").alias("label")), "label", per_class, seed), "sample-ids")
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")  # as many ids as the sample has rows
    return materialise(sample_by_class(found, "label", per_class, seed, text="text"), "sample")
