"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix is indexed where it starts at an anchor: of every `length`-byte string, the `PREFIX`-byte string in it
with the smallest digest, leftmost first. Equal strings so have equal anchors at equal places, and one anchor stands
for the run of strings that chose it. A suffix's key is its first `PREFIX` bytes as they are, then a digest of the bytes of
that run: arrays are in byte order, and the common prefix of neighbours says whether they share the anchor or the run.

The arrays are dealt by prefix. In each share, new batches become sorted arrays, are merge-scanned against
the levels there are, and levels of equal size merge. A run met again is a repeat whole. A prefix met
with different runs is a match whose ends must be found: the bytes around it are fetched and compared string by string.

`remove_repeats` treats one table. `SuffixLevels` keeps the levels in a folder, for batches that come later.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, flat, join_classes, materialise, slices, small_batches

PREFIX = 32
KEY = PREFIX + 8
NO_ID = -(1 << 63)
HOT_IN_SLICE = 64
HOT_GROUP = 4096
LEVEL_ROWS = 1 << 15
#: A share's arrays stand for about so many bytes of text, some two million suffixes.
SHARE_BYTES = 64 << 20
REP, SALTED, MARK, REPEAT, OPEN, HOT = range(6)
DOC = ("batch", "doc", "version")
PLACE = (*DOC, "packed")
ROWS = "kind byte, key binary, batch long, doc long, version long, packed long"
LETTERS = np.random.default_rng(12345).integers(1, 1 << 63, size=256, dtype=np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def digests(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each power of two asked for, digests of all byte strings of that length."""
    h, size, out = LETTERS[data], 1, {}
    while True:
        if size in lengths:
            out[size] = h
        if size >= max(lengths):
            return [out[x] for x in lengths]
        h = _join(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2


def strings(h64: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Digests of the strings of `length` (64 to 128) bytes at the given places."""
    return _join(h64[start], h64[start + length - 64])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text row, run digest, anchor place, places of the run's first and last string)."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    h32, h64 = digests(data, PREFIX, 64)
    low, at, span, reach = h32, np.arange(len(h32), dtype=np.int32), 1, length - PREFIX + 1

    def lower(shift: int) -> None:
        nonlocal low, at
        n = len(low) - shift
        right = low[shift:] < low[:n]
        low, at = np.where(right, low[shift:], low[:n]), np.where(right, at[shift:], at[:n])

    while span * 2 <= reach:
        lower(span)
        span *= 2
    if reach > span:
        lower(reach - span)
    s = np.arange(len(low))
    fits = offsets[1:][doc[s]] - s >= length
    s, a = s[fits], at[fits].astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))) if len(s) else np.zeros(0, np.int64)
    first, last, a = s[head], s[np.append(head[1:], len(s)) - 1] if len(head) else s[:0], a[head]
    size = last - first + length
    shape = ((a - first) << 8 | (last - first)).astype(np.uint64)
    run = _join(_join(h64[first], h64[first + np.minimum(64, size - 64)]), _join(h64[last + length - 64], shape))
    return doc[a], run, a, first, last


def _pack(anchor: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(anchor, run's reach): longs that order suffixes of one text. A place is (batch, doc, version, packed)."""
    return anchor << 14 | before << 7 | after


def _starts(packed: Column) -> tuple[Column, Column]:
    """(first, last) of packed runs."""
    anchor = F.shiftright(packed, 14)
    return anchor - F.shiftright(packed, 7).bitwiseAND(F.lit(127)), anchor - packed.bitwiseAND(F.lit(127))


def _keyed(docs: DataFrame, batch: int, *extra: Column) -> DataFrame:
    """Rows with the document's key. Texts under an id that occurs more than once are told apart by their 64-bit digest, the version."""
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    again = materialise(docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("again")), "repeated-ids")
    rows = small_batches(docs).select(doc.alias("doc"), text.alias("text"), *extra).join(again, "doc", "left")
    return rows.select(F.lit(batch).cast("long").alias("batch"), "doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("version"), "text", *(c for c in rows.columns if c not in ("doc", "text", "again")))


def _keys(data: np.ndarray, anchor: np.ndarray, run: np.ndarray) -> np.ndarray:
    out = np.empty((len(anchor), KEY), np.uint8)
    out[:, :PREFIX] = data[anchor[:, None] + np.arange(PREFIX)]
    out[:, PREFIX:] = run.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view(f"S{KEY}").ravel()


def common(keys: np.ndarray) -> np.ndarray:
    """How many leading bytes each sorted key has in common with the one before; 0 for the first."""
    if not len(keys):
        return np.zeros(0, np.int64)
    b = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, KEY)
    apart = b[1:] != b[:-1]
    return np.concatenate(([0], np.where(apart.any(1), apart.argmax(1), KEY)))


def _prefix_digest(keys: np.ndarray) -> np.ndarray:
    w = np.ascontiguousarray(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, KEY)[:, :PREFIX]).view(np.uint64)
    h = w[:, 0]
    for k in range(1, PREFIX // 8):
        h = _join(h, w[:, k])
    return h.view(np.int64)


def _sorted(key: np.ndarray, *place: np.ndarray) -> list[np.ndarray]:
    """In order of key, then place; a place met again is left out."""
    o = np.lexsort(place[::-1])
    o = o[np.argsort(key[o], kind="stable")]
    rows = [x[o] for x in (key, *place)]
    if not len(o):
        return rows
    once = np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in rows])))
    return [x[once] for x in rows]


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * KEY), pa.py_buffer(np.ascontiguousarray(keys).view(np.uint8))])


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """Rows (kind, key, place), a sorted array for each slice of texts. Runs met twice in one slice go out as repeats at once.

    A prefix with many runs in a slice is hot: its runs are dealt by key, and a mark to the prefix's share says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=3, limit=2 << 20):
            data, offsets = flat(batch.column(3))
            parts, begin = [], 0
            while begin < len(offsets) - 1:  # in stretches that stay in the processor's cache
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1)
                part = anchors(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], length)
                parts.append((part[0] + begin, part[1], *(x + offsets[begin] for x in part[2:])))
                begin = end
            row, g, a, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            key, *place = _sorted(_keys(data, a, g), *(batch.column(k).to_numpy()[row] for k in range(3)), _pack(a - offsets[row], a - first, a - last))
            shared = common(key)
            new, fresh = shared < PREFIX, shared < KEY
            group = np.cumsum(new) - 1
            hot = np.bincount(group, weights=fresh)[group] >= HOT_IN_SLICE if len(key) else new
            kind = np.where(fresh, np.where(hot, SALTED, REP), REPEAT).astype(np.int8)
            marks = np.flatnonzero(new & hot)
            both = lambda x: np.concatenate((x, x[marks]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((kind, np.full(len(marks), MARK, np.int8)))), _binary(both(key)), *(pa.array(both(x)) for x in place)], ["kind", "key", *PLACE])

    return docs.select(*DOC, "text").mapInArrow(run, ROWS)


def _share() -> Column:
    """What rows are dealt by: the prefix, runs of hot prefixes by the whole key, repeats by document."""
    kind = F.col("kind")
    return F.when(kind == SALTED, F.xxhash64("key")).when(kind == REPEAT, F.xxhash64(*DOC)).otherwise(F.xxhash64(F.substring("key", 1, PREFIX)))


class Family:
    """Sorted arrays of distinct keys, each with its first place; sizes fall geometrically."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def add(self, key: np.ndarray, *place: np.ndarray) -> list[np.ndarray]:
        """Take in a batch; returns the places of the runs that have an earlier equal. A place met again is no repeat."""
        rows = _sorted(key, *place)
        fresh = common(rows[0]) < KEY
        out = [[x[~fresh] for x in rows[1:]]]
        rows = [x[fresh] for x in rows]
        for level in self.levels:
            if not len(rows[0]):
                break
            at, found = _scan(level[0], rows[0])
            mine, theirs = np.flatnonzero(found), at[found]
            new, old = [x[mine] for x in rows[1:]], [x[theirs] for x in level[1:]]
            earlier, same = np.zeros(len(mine), bool), np.ones(len(mine), bool)
            for x, y in zip(new, old, strict=True):
                earlier |= same & (x < y)
                same &= x == y
            out.append([np.where(earlier, y, x)[~same] for x, y in zip(new, old, strict=True)])
            for to, x in zip(level[1:], new, strict=True):
                to[theirs[earlier]] = x[earlier]
            rows = [x[~found] for x in rows]
        if len(rows[0]):
            self.levels.append(rows)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self._merge()
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        where = _scan(a[0], b[0])[0] + np.arange(len(b[0]))
        keep = np.ones(len(a[0]) + len(b[0]), bool)
        keep[where] = False
        merged = []
        for x, y in zip(a, b, strict=True):
            z = np.empty(len(keep), x.dtype)
            z[where], z[keep] = y, x
            merged.append(z)
        self.levels.append(merged)

    def whole(self) -> list[np.ndarray]:
        """Key and the columns of the place; nothing where no batch came."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else []


def _scan(level: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys met with a sorted level, each search going on from the last: their places in it, and whether they are there."""
    at = np.searchsorted(level, keys)
    found = at < len(level)
    found[found] = level[at[found]] == keys[found]
    return at, found


def match(rows: DataFrame, newest: int = 0, keep: bool = False) -> DataFrame:
    """(kind, h, key, place): repeats, and runs whose prefix occurs with other runs too (open; hot if many).

    Of prefixes that batch `newest` doesn't have, only hot runs come. With `keep`, the runs and marks that
    are new with it come too, with their keys: its level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, salted, marked = Family(), Family(), [np.zeros(0, f"S{KEY}")]
        held: list[pa.RecordBatch] = []

        def take() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            kind, *place = (rows[c].to_numpy() for c in ("kind", *PLACE))
            data, offsets = flat(rows["key"].chunk(0))
            key = data.view(f"S{KEY}")
            repeats = [[x[kind == REPEAT] for x in place]]
            mark = kind == MARK
            if mark.any():
                marks, one = np.unique(key[mark], return_index=True)
                marked.append(marks)
                if keep:
                    ours = [x[mark][one] for x in place]
                    yield out(np.full(len(marks), MARK), marks, *ours, kept=ours[0] == newest)
            for which, family in ((REP, plain), (SALTED, salted)):
                k = kind == which
                if k.any():
                    repeats.append(family.add(key[k], *(x[k] for x in place)))
            place = [np.concatenate(x) for x in zip(*repeats, strict=True)]
            yield out(np.full(len(place[0]), REPEAT), None, *place)

        def out(kind: np.ndarray, key: np.ndarray | None, *place: np.ndarray, kept: np.ndarray | None = None) -> pa.RecordBatch:
            if kept is not None:
                kind, key, place = kind[kept], key[kept], [x[kept] for x in place]
            h = pa.array(_prefix_digest(key)) if key is not None else pa.nulls(len(kind), pa.int64())
            keys = _binary(key) if kept is not None else pa.nulls(len(kind), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), h, keys, *map(pa.array, place)], ["kind", "h", "key", *PLACE])

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= LEVEL_ROWS:
                yield from take()
                waiting = 0
        yield from take()
        if whole := plain.whole():
            key, *place = whole
            new = common(key) < PREFIX
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            runs = np.bincount(group)[group]
            prefix = lambda x: np.ascontiguousarray(x).astype(f"S{PREFIX}")
            hot = (runs > HOT_GROUP) | np.isin(prefix(key), prefix(np.concatenate(marked)))
            live = np.maximum.reduceat(place[0], begin)[group] == newest
            kind = np.where(hot, HOT, np.where((runs > 1) & live, OPEN, -1))
            use = kind >= 0
            yield out(kind[use], key[use], *(x[use] for x in place))
            if keep:
                yield out(np.full(len(key), REP), key, *place, kept=place[0] == newest)
        if whole := salted.whole():
            key, *place = whole
            yield out(np.full(len(key), HOT), key, *place)
            if keep:
                yield out(np.full(len(key), SALTED), key, *place, kept=place[0] == newest)

    return rows.mapInArrow(run, "kind byte, h long, key binary, batch long, doc long, version long, packed long")


def _around(docs: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """For open and hot runs, (kind, h, place, bytes) with all bytes of the run's strings."""
    first, last = _starts(F.col("packed"))
    wanted = hits.where(F.col("kind").isin(OPEN, HOT)).select(*DOC, F.struct("kind", "h", "packed", first.cast("int").alias("first"), (last - first + length).cast("int").alias("size")).alias("run"))
    wanted = wanted.groupBy(*DOC).agg(F.collect_list("run").alias("runs"))
    cut = F.transform("runs", lambda r: F.struct(r["kind"].alias("kind"), r["h"].alias("h"), r["packed"].alias("packed"), F.substring("text", r["first"] + 1, r["size"]).alias("bytes")))
    found = docs.select(*DOC, "text").join(wanted, list(DOC))
    return found.select(*DOC, F.explode(cut).alias("r")).select("r.kind", "r.h", *DOC, "r.packed", "r.bytes")


def _open_strings(batch: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """(row, digest, place from the anchor) of every string of every run."""
    data, offsets = flat(batch["bytes"].combine_chunks() if isinstance(batch, pa.Table) else batch["bytes"])
    (h64,) = digests(data, 64)
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, strings(h64, offsets[:-1][row] + k, length), k


def _ends(around: DataFrame, length: int, parts: int) -> DataFrame:
    """(batch, doc, version, first, last): runs of strings with an earlier equal, from bytes dealt by prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = sum(b.num_rows for b in held)
            if rows < 20_000 or held[0]["h"][0] == batch["h"][-1]:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = table["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            yield compare(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    def compare(table: pa.Table) -> pa.RecordBatch:
        row, digest, k = _open_strings(table, length)
        h, *doc, packed = (table[c].to_numpy() for c in ("h", *PLACE))
        before = packed >> 7 & 127
        first = (packed >> 14) - before
        o = np.lexsort((k, packed[row], *(x[row] for x in doc[::-1]), digest, before[row] - k, h[row]))
        same = np.zeros(len(o), bool)
        r, d, x = row[o], digest[o], (before[row] - k)[o]
        same[1:] = (d[1:] == d[:-1]) & (h[r][1:] == h[r][:-1]) & (x[1:] == x[:-1])
        repeat = np.zeros(len(o), bool)
        repeat[o] = same
        return _runs(row[repeat], k[repeat], doc, first)

    once = around.repartition(parts, "h").dropDuplicates(["h", *PLACE])  # rows that repeat id and text
    return once.sortWithinPartitions("h").mapInArrow(run, SPANS)


SPANS = "batch long, doc long, version long, first long, last long"


def _runs(row: np.ndarray, k: np.ndarray, doc: list[np.ndarray], first: np.ndarray) -> pa.RecordBatch:
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1)))) if len(row) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(row)) - 1 if len(head) else head
    r = row[head]
    return pa.RecordBatch.from_arrays([*(pa.array(x[r]) for x in doc), pa.array(first[r] + k[head]), pa.array(first[r] + k[tail])], [*DOC, "first", "last"])


def _hot_ends(around: DataFrame, length: int) -> DataFrame:
    """The same for hot prefixes, whose strings are dealt one by one: no task gets all of a prefix, nor all of one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                row, digest, k = _open_strings(part, length)
                h, *doc, packed = (part[c].to_numpy() for c in ("h", *PLACE))
                first = (packed >> 14) - (packed >> 7 & 127)
                yield pa.RecordBatch.from_arrays([pa.array(_join(h.view(np.uint64)[row], digest).view(np.int64)), pa.array(digest.view(np.int64)), *(pa.array(x[row]) for x in doc), pa.array(first[row] + k)], ["u", "v", *DOC, "first"])

    each = materialise(around.mapInArrow(run, "u long, v long, batch long, doc long, version long, first long"), "hot-strings")
    here = F.struct(*DOC, "first")
    earliest = materialise(each.groupBy("u", "v").agg(F.min(here).alias("e"), F.count("*").alias("n")).where("n > 1"), "hot-earliest")
    return join_classes(each, earliest, ["u", "v"], "n", how="inner").where(here != F.col("e")).select(*DOC, "first", F.col("first").alias("last"))


def _shares(docs: DataFrame) -> int:
    """The session's number of partitions, or more if a share would stand for over SHARE_BYTES of text."""
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text // SHARE_BYTES))


def _spans(hits: DataFrame, texts: DataFrame, length: int, parts: int, newest: int) -> DataFrame:
    """(batch, doc, version, first, last) of the runs of strings of batch `newest` that start earlier too."""
    around = materialise(_around(texts, hits, length), "around")
    ends = materialise(_ends(around.where(F.col("kind") == OPEN), length, parts).unionByName(_hot_ends(around.where(F.col("kind") == HOT), length)).where(F.col("batch") == newest), "ends")
    first, last = _starts(F.col("packed"))
    return hits.where((F.col("kind") == REPEAT) & (F.col("batch") == newest)).select(*DOC, first.alias("first"), last.alias("last")).unionByName(ends)


def _removed(keyed: DataFrame, spans: DataFrame, length: int, carry: list[str] | None, whole_characters: bool) -> DataFrame:
    spans = spans.groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias("found"))
    joined = keyed.join(spans, list(DOC), "left").select("doc", "text", "found", "carried")
    shape = joined.select("carried").schema["carried"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, kept, spans = batch.column(1).to_pylist(), [], []
            found = batch.column(2)
            fields, offsets = found.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
            begin, end = fields.field(0).to_numpy(zero_copy_only=False), fields.field(1).to_numpy(zero_copy_only=False) + length
            for i, text in enumerate(texts):
                a, b = begin[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]]
                if not len(a):
                    kept.append(text)
                    spans.append([])
                    continue
                o = np.argsort(a, kind="stable")
                a, b = a[o], np.maximum.accumulate(b[o])
                head = np.concatenate(([True], a[1:] > b[:-1]))
                a, b = a[head], b[np.append(np.flatnonzero(head)[1:], len(b)) - 1]
                stay = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                kept.append(stay.decode("utf-8", "ignore").encode() if whole_characters else stay)
                spans.append(list(zip(a.tolist(), b.tolist(), strict=True)))
            span = pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), span, batch.column(3)], ["doc", "text", "kept", "spans", "carried"])

    out = joined.mapInArrow(cut, f"doc long, text binary, kept binary, spans array<struct<start:long,end:long>>, carried {shape}")
    return out.select(F.when(~F.col("carried._none"), F.col("doc")).alias("doc_id"), "text", "kept", "spans", *(F.col(f"carried.c{k}").alias(c) for k, c in enumerate(carry or [])))


def _carried(carry: list[str] | None) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("_none"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry or []))).alias("carried")


def remove_repeats(docs: DataFrame, length: int = 100, carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """Texts without the bytes of any `length`-byte string that starts earlier too.

    Earlier: in a document of smaller doc_id, or in the same one further to the front. Rows: doc_id, text (as it
    was, binary), kept (binary), spans (array of first and past-last byte of the removed runs), and the columns
    named in `carry`. With `whole_characters`, kept also loses the bytes of UTF-8 characters that a removal cut apart.

    Null text is empty and stays empty; texts of any length are whole. A null doc_id comes before all others, in the place of the smallest long. Rows that repeat
    both doc_id and text are one document, each with its result; rows that repeat a doc_id with other text follow in an order
    fixed by their texts. An empty table gives no rows; columns not named are left out. `length` may be 64 to 128.
    """
    keyed = _keyed(docs, 0, _carried(carry))
    parts = _shares(keyed)
    hits = materialise(match(suffixes(keyed, length).repartition(parts, _share())), "repeats")
    return _removed(keyed, _spans(hits, keyed, length, parts, 0), length, carry, whole_characters)


class SuffixLevels:
    """The family kept in a folder, for corpora that come in batches.

    Each batch becomes an array, is merge-scanned against the levels there are, and is written as a level of the runs that
    are new with it; a level that is less than twice the next one merges with it. So there are few levels, and a suffix is
    written anew a number of times that grows with the logarithm of the batches. Documents of earlier batches
    come before those of later ones, whatever their ids. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = 100):
        self.spark, self.folder, self.length = spark, folder.rstrip("/"), length
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self.fs_path(f"{self.folder}/{kind}")
        whole = [x.getPath() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return [x.getName() for x in whole if self.fs.exists(self.fs_path(f"{x.toString()}/_SUCCESS"))]

    def levels(self) -> list[tuple[int, int, str]]:
        """(first batch, last batch, path) of the levels in order; one that a merged level covers doesn't count."""
        found = sorted((*map(int, n.split("-")[:2]), f"{self.folder}/levels/{n}") for n in self._names("levels"))
        return [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and (y[1] - y[0] > x[1] - x[0]) for y in found)]

    def _write(self, rows: DataFrame, first: int, last: int, parts: int) -> None:
        rows.repartition(parts, _share()).sortWithinPartitions("key").write.parquet(f"{self.folder}/levels/{first}-{last}-{uuid.uuid4().hex}")

    def add(self, docs: DataFrame, carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
        """The batch's rows as `remove_repeats` gives them, against all earlier batches and itself; then it is part of the index."""
        levels = self.levels()
        batch = levels[-1][1] + 1 if levels else 0
        keyed = materialise(_keyed(docs, batch, _carried(carry)), "batch")
        keyed.select(*DOC, "text").distinct().write.mode("overwrite").parquet(f"{self.folder}/texts/{batch}")
        texts = self.spark.read.parquet(*(f"{self.folder}/texts/{k}" for k in range(batch + 1)))
        rows, parts = suffixes(keyed, self.length), _shares(texts)
        if levels:
            rows = rows.unionByName(self.spark.read.parquet(*(path for *_, path in levels)))
        hits = materialise(match(rows.repartition(parts, _share()), batch, keep=True), "repeats")
        spans = _spans(hits, texts, self.length, parts, batch)
        self._write(hits.where(F.col("kind").isin(REP, SALTED, MARK)).select("kind", "key", *PLACE), batch, batch, parts)
        self._merge(parts)
        return _removed(keyed, spans, self.length, carry, whole_characters)

    def _merge(self, parts: int) -> None:
        sized = [(*x, self.spark.read.parquet(x[2]).count()) for x in self.levels()]
        while len(sized) > 1 and sized[-2][3] < 2 * sized[-1][3]:
            (first, _, a, n), (_, last, b, m) = sized[-2:]
            self._write(self.spark.read.parquet(a, b), first, last, parts)
            for old in (a, b):
                self.fs.delete(self.fs_path(old), True)
            sized[-2:] = [(*next(x for x in self.levels() if x[:2] == (first, last)), n + m)]
