"""Near-duplicates by word shingles: the Gray-order index of SimHash fingerprints proposes, bands of min-hashes propose what it can't reach, the similarity of the whole sets decides."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, flat, materialise, slices, text_bytes
from .simhash import similar_links

#: A pair of similarity 0.8 shares none of 40 bands of 6 with a chance of 5 in a million.
BANDS, BAND_ROWS = 40, 6
#: Fingerprints that differ in so many bits at most are proposed. At a similarity of 0.8 some ten differ, so the index alone reaches the nearer copies.
DISTANCE = 7
MIX = np.random.default_rng(54321).integers(0, 1 << 32, size=(2, BANDS * BAND_ROWS), dtype=np.uint32)


def shingle_set(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted digests of the distinct runs of `words` words in lower case; a shorter text is one run, no words none."""
    found = text.lower().split()
    runs = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else ()
    return np.sort(np.fromiter((xxh64_intdigest(x, seed) for x in runs), np.uint64, len(runs)))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band digests for each of some sets, none of them empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    every = np.concatenate(sets)
    h = (every ^ every >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        digest = np.full(len(sets), band, np.uint64)
        for i in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            least = np.minimum.reduceat((h ^ MIX[0, i]) * (MIX[1, i] | np.uint32(1)), starts)
            digest = digest * np.uint64(0x9E3779B97F4A7C15) ^ least
            digest ^= digest >> np.uint64(29)
            digest *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, band] = digest
    return out


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each of some sets, none of them empty: the bits that over half of its digests have."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    digests = np.concatenate(sets)
    out = np.zeros(len(sets), np.uint64)
    for bit in range(64):
        had = np.add.reduceat((digests >> np.uint64(bit) & np.uint64(1)).astype(np.int32), starts)
        out |= (2 * had > [len(x) for x in sets]).astype(np.uint64) << np.uint64(bit)
    return out


def similar_sets(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join exactly the sets of Jaccard similarity `least` or more, however far.

    Two such sets share one at least of their rarest digests (all but `least` of each, and one more), so only sets that
    meet there are compared, and only those that aren't joined yet.
    """
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(values))
    ends = np.cumsum([len(x) for x in sets])
    ranked = [np.sort(rank[x]) for x in np.split(where, ends[:-1])]
    size, label = np.array([len(x) for x in sets]), np.arange(len(sets))
    members, posted, links = {i: [i] for i in range(len(sets))}, defaultdict(list), []
    for x in np.argsort(size, kind="stable").tolist():
        prefix = ranked[x][: size[x] - ceil(least * size[x] - 1e-9) + 1].tolist()
        near = np.unique(np.array([y for r in prefix for y in posted[r]], np.int64))
        near = near[size[near] >= least * size[x] - 1e-9]
        while len(near := near[label[near] != label[x]]):
            y, near = int(near[0]), near[1:]
            both = len(np.intersect1d(ranked[x], ranked[y], assume_unique=True))
            if both + 1e-9 >= least * (size[x] + size[y] - both):
                links.append((x, y))
                keep, go = sorted((label[x], label[y]), key=lambda r: -len(members[r]))
                label[members[go]] = keep
                members[keep] += members.pop(go)
        for r in prefix:
            posted[r].append(x)
    return links


def _marks(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, fp, bands): a digest of each text's whole set, the set's fingerprint (null without words) and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            sets = [shingle_set(raw[a:b], words) for a, b in zip(at[:-1], at[1:], strict=True)]
            mark = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            full = [x for x in sets if len(x)]
            found = bands(full).view(np.int64).ravel() if full else np.zeros(0, np.int64)
            ends = np.cumsum([0, *(BANDS * bool(len(x)) for x in sets)]).astype(np.int32)
            prints, none = np.zeros(len(sets), np.int64), np.array([not len(x) for x in sets], bool)
            prints[~none] = set_fingerprints(full).view(np.int64) if full else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mark), pa.array(prints, mask=none), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], ["doc_id", "mark", "fp", "bands"])

    return text_bytes(docs.where("doc_id is not null")).mapInArrow(run, "doc_id long, mark long, fp long, bands array<long>")


def _near_prints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the texts whose fingerprints are DISTANCE bits apart or nearer, by the Gray-order index."""
    nodes = nodes.where("fp is not null").select("fp", "rep")
    first = nodes.groupBy("fp").agg(F.min("rep").alias("first"))
    same = nodes.join(first, "fp").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return same.unionByName(similar_links(first.select(F.col("first").alias("rep"), "fp"), DISTANCE))


def _meetings(nodes: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) from each text to the first one that shares a band with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            c, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            heads = np.concatenate(([True], c[1:] != c[:-1]))
            lead = rep[heads]
            if c[0] == cell:
                lead[0] = first
            b = lead[np.cumsum(heads) - 1]
            cell, first = c[-1], b[-1]
            yield pa.RecordBatch.from_arrays([pa.array(rep[rep != b]), pa.array(b[rep != b])], ["a", "b"])

    cells = nodes.select(F.explode("bands").alias("cell"), "rep").repartition(parts, "cell").sortWithinPartitions("cell", "rep")
    return cells.mapInArrow(run, "a long, b long")


def _verified(texts: DataFrame, parts: int, words: int, least: float) -> DataFrame:
    """Links (a, b) of similar texts, from rows (share, doc_id, text) dealt by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        at = None

        def found() -> pa.RecordBatch:
            links = similar_sets(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x[i]] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for share, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if share != at:
                    yield found()
                    ids, sets, at = [], [], share
                if len(one := shingle_set(text or b"", words)):
                    ids.append(doc_id)
                    sets.append(one)
        yield found()

    return texts.repartition(parts, "share").sortWithinPartitions("share").select("share", "doc_id", "text").mapInArrow(run, "a long, b long")


def _shares(docs: DataFrame, met: DataFrame, part_bytes: int) -> DataFrame:
    """(share, doc_id, text): what is compared together. A component's texts of over `part_bytes` are dealt in parts, each pair of parts a share."""
    texts = text_bytes(docs)
    large = texts.select("doc_id", F.octet_length("text").alias("n")).join(met, "doc_id").groupBy("component").agg(F.sum("n").alias("bytes")).where(F.col("bytes") > part_bytes)
    large = materialise(large.select("component", F.ceil(F.col("bytes") / part_bytes).cast("int").alias("parts")), "large-components")
    texts = texts.join(met, "doc_id").join(large, "component", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("component", F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    return texts.select(F.explode(F.when(F.col("parts").isNull(), F.array(F.xxhash64("component"))).otherwise(pairs)).alias("share"), "doc_id", "text")


def one_of_each_similar(docs: DataFrame, words: int = 5, least: float = 0.8, part_bytes: int = 32 << 20) -> DataFrame:
    """The rows of `docs` but those of documents that are linked, however far, to one of smaller doc_id.

    Linked are texts whose sets of `words`-word runs have a Jaccard similarity of `least` or more; equal sets and texts
    without words are. Sets whose fingerprints the Gray-order index finds near, or that share a band, are gathered by component, where the whole sets are compared: a pair is
    missed only if no chain of either joins it. A component of over `part_bytes` of text is compared by pairs of parts, so no
    task holds more than two of them. Null and empty texts have no words; texts of any length are whole. Rows with a null doc_id
    stay; rows that share an id stay or go together; an empty table stays empty.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = materialise(_marks(docs, words), "shingle-marks")
    nodes = materialise(marks.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "shingle-sets")
    met = components(_near_prints(nodes).unionByName(_meetings(nodes, parts))).withColumnRenamed("node", "doc_id")
    groups = components(materialise(_verified(_shares(docs, met, part_bytes), parts, words, least), "similar-sets"))
    named = nodes.select("mark", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("mark", F.coalesce("component", "rep").alias("component"))
    dropped = materialise(marks.select("doc_id", "mark").join(named, "mark").where("component <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
