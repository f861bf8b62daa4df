"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, components, flat, forest, join_classes, materialise, slices, text_bytes

FANOUT = 8
#: So many pairs of nodes are compared at a time.
PAIRS = 1 << 18


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text's word shingles, as a signed long, for every row, ids null or repeated too. No words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            raw, at, hashes, counts = data.tobytes(), offsets.tolist(), [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                words = raw[a:b].lower().split()
                n = len(words)
                if n > shingle_words:
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
                    starts = [0, *(ends[: n - shingle_words] + 1).tolist()]
                    joined = b" ".join(words)
                    hashes.extend(map(xxh64_intdigest, [joined[x:y] for x, y in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)], repeat(seed)))
                elif n:
                    hashes.append(xxh64_intdigest(b" ".join(words), seed))
                counts.append(max(n - shingle_words + 1, 1) if n else 0)
            out = np.zeros(len(counts), np.uint64)
            every, counts = np.array(hashes, np.uint64), np.array(counts)
            ends = np.cumsum(counts)
            for bit in range(64) if len(every) else ():
                set_ = np.concatenate(([0], np.cumsum((every >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
                more = 2 * (set_[ends] - set_[ends - counts]) > counts
                out |= more.astype(np.uint64) << np.uint64(bit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The position of each 64-bit pattern in the reflected Gray sequence."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def gray_order_links(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i's component's smallest node j, between patterns of one cell within `distance` bits.

    Rows must be sorted by cell and Gray rank. Leaves hold patterns; each upper node holds the bits on which its
    (up to eight) children agree, and a mask of them. A pair of nodes is descended with the differences counted
    on the bits shared so far: children add only those of newly shared bits, and a pair whose count passes
    `distance` goes with everything below it. At most PAIRS pairs of children are looked at together, and the others
    wait as pairs of their parents, so memory doesn't grow with the pairs, however few of them the bits tell apart.
    """
    n = len(fp)
    masks, patterns, cells, first = [np.full(n, ~np.uint64(0))], [fp], [cell], []
    while len(cells[-1]) > len(np.unique(cells[-1])):
        c = cells[-1]
        begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        within = np.arange(len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))
        heads = np.flatnonzero(within % FANOUT == 0)
        ones = np.bitwise_and.reduceat(patterns[-1] & masks[-1], heads)
        zeros = np.bitwise_and.reduceat(~patterns[-1] & masks[-1], heads)
        first.append(np.append(heads, len(c)))
        masks.append(ones | zeros)
        patterns.append(ones)
        cells.append(c[heads])
    label, found, held = np.arange(n), [], 0

    def joined() -> np.ndarray:
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.minimum(label, forest(n, np.concatenate((np.arange(n), u)), np.concatenate((label, v))))

    roots, child = np.arange(len(cells[-1])), np.arange(FANOUT)
    stack = [(len(first), roots, roots, np.zeros(len(roots), np.uint8))]
    while stack:
        level, u, v, gone = stack.pop()
        if not level:
            apart = label[u] != label[v]
            found.append((u[apart], v[apart]))
            held += int(apart.sum())
            if held > PAIRS:
                label, found, held = joined(), [], 0
            continue
        if len(u) > PAIRS // FANOUT**2:
            half = len(u) // 2
            stack += [(level, u[:half], v[:half], gone[:half]), (level, u[half:], v[half:], gone[half:])]
            continue
        begin, size = first[level - 1][:-1], np.diff(first[level - 1])
        mask, pattern = masks[level - 1], patterns[level - 1]
        a, b = (np.minimum(begin[x][:, None] + child, len(mask) - 1) for x in (u, v))
        shared = masks[level][u] & masks[level][v]
        new = (mask[a] & ~shared[:, None])[:, :, None] & mask[b][:, None, :]
        apart = np.bitwise_count((pattern[a][:, :, None] ^ pattern[b][:, None, :]) & new) + gone[:, None, None]
        real = (child < size[u][:, None])[:, :, None] & (child < size[v][:, None])[:, None, :]
        once = (u < v)[:, None, None] | (child[:, None] <= child)
        pair, i, j = np.nonzero((apart <= distance) & real & once)
        if len(pair):
            stack.append((level - 1, a[pair, i], b[pair, j], apart[pair, i, j]))
    label = joined() if found else label
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def similar_links(distinct: DataFrame, distance: int = 3, cell_limit: int = 20_000) -> DataFrame:
    """Links (a, b) of representatives that join exactly the fingerprints within `distance` bits.

    `distinct` has (rep, fp), one row per fingerprint. Two such fingerprints agree on one of distance + 1 blocks
    of bits at least, so each goes to one cell per block, and every cell has an index of its own. A cell with
    over `cell_limit` rows is dealt again by blocks of its remaining bits, by the same argument.
    """
    blocks = distance + 1
    width = 64 // blocks
    widths = [width + (i < 64 - width * blocks) for i in range(blocks)]
    lows = [sum(widths[:i]) for i in range(blocks)]
    cells = distinct.select("rep", "fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _bits(F.col("fp"), lows[i], widths[i]).alias("value")) for i in range(blocks)))).alias("c")).select("rep", "fp", "c.block", "c.value")
    cells = cells.withColumn("cell", F.xxhash64("block", "value"))
    hot = cells.groupBy("block", "value").count().where(F.col("count") > cell_limit).select("block", "value", F.lit(True).alias("hot"))
    cells = cells.join(hot, ["block", "value"], "left")

    def finer(block: int) -> Column:
        rest = [(lows[i] + j, 1) for i in range(blocks) if i != block for j in range(widths[i])]
        size = -(-len(rest) // blocks)
        parts = [rest[k : k + size] for k in range(0, len(rest), size)]
        return F.array(*(F.xxhash64(F.lit(block), F.col("value"), F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << low for low, _ in p))))) for k, p in enumerate(parts)))

    inner = F.lit(None).cast("array<bigint>")
    for i in range(blocks):
        inner = F.when(F.col("block") == i, finer(i)).otherwise(inner)
    cells = cells.select("rep", "fp", F.explode(F.when(F.col("hot"), inner).otherwise(F.array("cell"))).alias("cell"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def found(t: pa.Table) -> pa.RecordBatch:
            cell, fp, rep = t["cell"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy()
            order = np.lexsort((gray_rank(fp), cell))
            cell, fp, rep = cell[order], fp[order], rep[order]
            i, j = gray_order_links(cell, fp, distance)
            return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(held)
            cell = rows["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], "left")) if cell[0] != cell[-1] else 0
            if cut and len(cell) >= 50_000:
                yield found(rows.slice(0, cut))
                held = [rows.slice(cut)]
        if held:
            yield found(pa.concat_tables(held))

    return dealt.select("cell", "fp", "rep").mapInArrow(link, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash_groups(docs: DataFrame, shingle_words: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Equal fingerprints collapse to their smallest doc_id before any comparison, so copies, however many, cost one
    index entry, and a fingerprint that many documents have is joined back by broadcast. Null and empty texts have fingerprint
    0 and link like any other; texts of any length are whole; repeated rows stay; rows with a null doc_id keep a null
    component and link nothing; an empty table gives no rows; other columns are ignored.
    """
    marks = checkpointed(fingerprints(docs, shingle_words, seed))
    groups = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    parts = components(similar_links(groups.where("rep is not null").select("rep", "fp"), distance)).withColumnRenamed("node", "rep")
    named = materialise(groups.join(parts, "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "fingerprint-groups")
    return join_classes(marks, named, ["fp"], "n").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of `docs` but those of documents that are linked, however far, to one of smaller doc_id.

    Only the dropped ids are joined. Rows with a null doc_id stay; rows that share an id stay or go together.
    """
    groups = simhash_groups(docs, **settings)
    dropped = materialise(groups.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
