"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .mixing import word_count

DIMENSIONS = ("bytes", "tokens", "rows")
#: Of rows that repeat id and text, so many are made anew in one task.
COPIES = 1 << 16


def place(vectors: np.ndarray, shards: int, slack: float) -> np.ndarray:
    """The shard of each vector: largest first, to where the dot product with what is left is highest.

    Vectors and capacities are in units of an even shard. A shard is open to a group while every dimension stays within
    1 + `slack`; if none is, those are whose first dimension does; if none is, the one with most room there takes it.
    """
    unit = vectors / np.maximum(vectors.sum(0) / shards, 1e-300)
    left, out = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), np.int64)
    for i in np.lexsort((-unit.max(1), -unit[:, 0].round(12))):
        room = left + slack - unit[i] >= 0
        open_ = room.all(1) if room.all(1).any() else room[:, 0]
        at = int(np.argmax(np.where(open_, left @ unit[i], -np.inf))) if open_.any() else int(np.argmax(left[:, 0]))
        out[i] = at
        left[at] -= unit[i]
    return out


def parcels(rows: DataFrame, shards: int, parcels_per_shard: int, whole_share: float) -> DataFrame:
    """Adds `parcel` and `cell` to rows (doc_id, same, copy, size, tokens): what is placed together, and the part of it one task numbers.

    A group over a parcel's size is cut into cells of about that size, by id and number of the copy, as ids may be null or
    repeat: no task gets all of it, and how the input is partitioned makes no difference.
    """
    limit = shards * parcels_per_shard
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    fill = F.greatest(*(F.col(d) / F.lit(max(1, total[d] or 0)) for d in DIMENSIONS))
    cells = F.ceil(fill * limit).cast("long")
    large = groups.where((fill * limit > 1) & (F.col("rows") > 1)).select("same", cells.alias("cells"), F.when(fill * shards > whole_share, cells).otherwise(1).alias("pieces"))
    rows = rows.join(F.broadcast(large), "same", "left")  # groups over 1/limit of some total: at most 3 * limit rows
    cell = F.pmod(F.xxhash64("doc_id", "copy"), F.coalesce("cells", F.lit(1)))
    piece = F.when(F.col("pieces") > 1, cell).otherwise(0)
    parcel = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("same"), F.lit(limit))).otherwise(F.lit(limit) + F.pmod(F.xxhash64("same", piece), F.lit(limit * 16)))
    return rows.withColumns({"parcel": parcel, "cell": cell}).drop("same", "copy", "cells", "pieces")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `copy`: rows alike in every column are counted and made anew with numbers from 0, many copies in several tasks."""
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long")))
    few, many = counted.where(F.col("_n") <= COPIES).withColumn("_from", F.lit(0).cast("long")), counted.where(F.col("_n") > COPIES).withColumn("_from", begin).repartition("same", "_from")
    return few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_n"), F.col("_from") + COPIES) - 1))).drop("_n", "_from")


def shard(docs: DataFrame, shards: int = 40, tokens: Column | None = None, parcels_per_shard: int = 256, whole_share: float = 1.0, overhead: int = 16, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot): shards near equal in bytes, then in tokens and rows.

    Equal texts form a group. A group up to a parcel (an even shard over `parcels_per_shard`) goes whole into the
    parcel of its hash, a larger one into a parcel of its own. Only a group that fills over `whole_share` of an even
    shard is split into as many parcels as it would fill. The number of parcels and of their cells is at most a few
    times shards * parcels_per_shard whatever the data, so their summed vectors are packed on the driver and the
    plan is broadcast. The result is a matter of the rows alone, however they are partitioned. Slots count from 0 in each shard: parcels follow each other, then their cells, documents
    in a cell by doc_id. Null text: no bytes, no tokens, group of the empty text. Null doc_ids come
    first; repeated rows get a slot each; texts of any length are one row; empty tables give no rows; other columns are ignored.
    """
    tokens = word_count() if tokens is None else tokens
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), tokens.alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"))
    rows = checkpointed(numbered(rows))
    rows = checkpointed(parcels(rows, shards, parcels_per_shard, whole_share))
    found = rows.groupBy("parcel", "cell").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("parcel", "cell").collect()
    names, first = np.unique([r.parcel for r in found], return_index=True)
    plan, used = [], np.zeros(shards, np.int64)
    if found:
        vectors = np.add.reduceat(np.array([[r[d] for d in DIMENSIONS] for r in found], float), first, axis=0)
        where = dict(zip(names.tolist(), place(vectors, shards, slack).tolist(), strict=True))
        for r in found:
            s = where[r.parcel]
            plan.append((r.parcel, r.cell, s, int(used[s])))
            used[s] += r.rows
    plan = docs.sparkSession.createDataFrame(plan, "parcel long, cell long, shard int, base long")
    slot = F.row_number().over(Window.partitionBy("parcel", "cell").orderBy("doc_id", "size", "text_crc32")) - 1 + F.col("base")
    return rows.join(F.broadcast(plan), ["parcel", "cell"]).withColumn("slot", slot.cast("long")).select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")
