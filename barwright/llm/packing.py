"""Packing token streams into fixed windows, mixed by deficit round-robin over source queues."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, materialise, slices, small_batches

WEIGHT_BITS = 20
#: Words up to so many bytes are remembered, so many of them: a bounded number of bytes whatever the texts.
CACHE_BYTES, CACHE_WORDS = 64, 500_000
#: Beyond so many sources the largest keep queues of their own, and the others are dealt over the shared ones, which are trees of
#: their sources' own queues with so many branches a node.
QUEUES, SHARED, FAN = 2000, 200, 64
#: Byte-level models write bytes as letters: visible Latin-1 characters stand for themselves, others for 256 and up in turn.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}


class WordTokenizer:
    """Ids of texts by a tokenizer whose pieces never cross ASCII white space, each distinct word encoded once.

    Words are remembered in two generations of bounded size. One instance serves all tasks of a Python worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        special = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not t.normalized]
        self.between = special[0] if special else None
        self.plain = True
        self.plain = all([t.id for t in self.tokenizer.model.tokenize(self._letters(w.encode()) or "")] == self._ids(w) for w in ("Water", "ééñß", "ÀÖÝ", "eau"))
        self.plain = self.plain and self._ids("Ab1., Éa,. cD.") == self._ids("ab1 ., éa ,. cd .")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        words = [self._words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*words).difference(known)
        known.update((w, older[w]) for w in new if w in older)
        self._learn([w for w in new if w not in known])
        get, stop = known.__getitem__, np.array([end], self.dtype).tobytes()
        out = [b"".join(map(get, ws)) + stop for ws in words]
        for w in new:
            if len(w) > CACHE_BYTES:
                known.pop(w, None)
                known.pop(w.rstrip(b".,"), None)
        return out

    def _words(self, text: bytes) -> list[bytes]:
        return (text.lower() if self.plain and b"<|" not in text else text).split()

    def _learn(self, new: list[bytes]) -> None:
        """Encode words not met yet; one that ends in commas and stops is its stem's ids and theirs."""
        parts, need = [], set()
        for w in new:
            stem = w.rstrip(b".,")
            if self.plain and len(stem) < len(w) and stem[-1:].isalnum():
                parts.append((w, stem, w[len(stem) :]))
                need.update(parts[-1][1:])
            else:
                need.add(w)
        known, rest = self.known, []
        for w in need:
            if w not in known:
                if w in self.older:
                    known[w] = self.older[w]
                elif letters := self._letters(w):
                    known[w] = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], self.dtype).tobytes()
                else:
                    rest.append(w)
        self._encode(rest)
        for w, stem, stops in parts:
            known[w] = known[stem] + known[stops]

    def _letters(self, word: bytes) -> str | None:
        """What the model itself is given of a word of plain letters; None for any other."""
        if not self.plain:
            return None
        if word.isascii():
            return word.decode().lower() if word.isalpha() else None
        try:
            text = word.decode()
        except UnicodeDecodeError:
            return None
        return text.lower().encode().decode("latin-1").translate(BYTES) if text.isalpha() and max(text) < "\u0100" else None

    def _encode(self, new: list[bytes]) -> None:
        """Encode words in groups, parted by a special token, which is no word's own."""
        mark = self.between[1].encode() if self.between else b""
        alone = [w for w in new if not mark or mark[:1] in w]
        joined = [w for w in new if mark and mark[:1] not in w]
        text = lambda w: w.decode("utf-8", "replace")
        self.known.update((w, np.array(self.tokenizer.encode(text(w), add_special_tokens=False).ids, self.dtype).tobytes()) for w in alone)
        groups = [joined[i : i + 100] for i in range(0, len(joined), 100)]
        for i in range(0, len(groups), 100):
            coded = self.tokenizer.encode_batch_fast([text(mark.join(g)) for g in groups[i : i + 100]], add_special_tokens=False)
            for group, e in zip(groups[i : i + 100], coded, strict=True):
                ids = np.array(e.ids, self.dtype)
                ends = np.append(np.flatnonzero(ids == self.between[0]), len(ids)) * self.dtype.itemsize
                raw, at = ids.tobytes(), 0
                for w, to in zip(group, ends.tolist(), strict=True):
                    self.known[w] = raw[at:to]
                    at = to + self.dtype.itemsize


@lru_cache(maxsize=1)
def _coder(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _tokenised(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Per document its ids and their place among its partition's ids of the same source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, part, at = _coder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in slices(batches, limit=1 << 20):
            data, offsets = flat(batch.column(1))
            raw, o = data.tobytes(), offsets.tolist()
            ids = coder.encode([raw[a:b] for a, b in zip(o[:-1], o[1:], strict=True)], end)
            sources, starts, size = batch.column(2).to_pylist(), [], coder.dtype.itemsize
            for s, x in zip(sources, ids, strict=True):
                starts.append(at.get(s, 0))
                at[s] = starts[-1] + len(x) // size
            counts = [len(x) // size for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), batch.column(0), batch.column(2), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "source", "at", "n", "ids"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return materialise(rows.mapInArrow(run, "part int, doc_id long, source string, at long, n long, ids binary"), "tokens")


class Schedule:
    """Deficit round-robin in closed form: which quantum of which queue comes when.

    Every queue's deficit grows by its share of what is packed, and a quantum is taken off it when the queue is served. Served
    is the queue whose deficit is largest for its weight: the k-th quantum of queue s is due at (2k + 1) / weight. A
    quantum's turn is then the number of quanta due earlier, which any task can count for itself, so the deficits carry
    over windows and partitions without a sequential pass; `deficit` says what they are. A queue that has run dry
    drops out; the others keep their proportions.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, quantum: int):
        self.names = sorted(totals)
        self.index = {s: i for i, s in enumerate(self.names)}
        self.quantum = quantum
        self.total = np.array([totals[s] for s in self.names], np.int64)
        share = np.array([float((weights or totals).get(s, 0)) for s in self.names])
        self.weight = np.maximum(1, np.round(share / max(share.sum(), 1e-300) * (1 << WEIGHT_BITS)).astype(np.int64))
        self.quanta = -(-self.total // quantum)
        self.hole = self.quanta * quantum - self.total
        self.last = self.turn(np.arange(len(self.names)), self.quanta - 1)

    def turn(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.int64)
        for other in range(len(self.names)):
            due = (2 * k + 1) * self.weight[other]
            top = (due - (other >= s)) // self.weight[s]
            out += np.minimum(self.quanta[other], np.where(other == s, k, (top + 1) // 2))
        return out

    def deficit(self, turns: int) -> np.ndarray:
        """Each queue's share of the first `turns` quanta, less the quanta it got of them; while no queue has run dry."""
        got = []
        for s, quanta in enumerate(self.quanta.tolist()):
            low, high = 0, quanta
            while low < high:
                k = (low + high) // 2
                low, high = (k + 1, high) if self.turn(np.array([s]), np.array([k]))[0] < turns else (low, k)
            got.append(low)
        return self.weight / self.weight.sum() * turns - np.array(got)

    def place(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of the at-th id of queue s in the whole packed stream."""
        turn = self.turn(s, at // self.quantum)
        order = np.argsort(self.last)
        holes = np.concatenate(([0], np.cumsum(self.hole[order])))
        return turn * self.quantum + at % self.quantum - holes[np.searchsorted(self.last[order], turn, "left")]


def spread(schedule: Schedule, s: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, place) of the quanta of the stretches [at, at + n) of queues s."""
    q = schedule.quantum
    first, count = at // q, (at + n - 1) // q - at // q + 1
    row = np.repeat(np.arange(len(s)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    begin = np.maximum(k * q, at[row])
    return row, begin - at[row], np.minimum((k + 1) * q, (at + n)[row]) - begin, schedule.place(s[row], begin)


def joined(row: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, window: int = 1 << 62) -> tuple[np.ndarray, ...]:
    """Pieces by row and start, those made one that touch in their document and in the stream, within a window."""
    order = np.lexsort((start, row))
    row, start, place, size = row[order], start[order], place[order], size[order]
    joins = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + size[:-1]) & (place[1:] % window != 0)
    heads = np.flatnonzero(np.concatenate(([True], ~joins)))
    return row[heads], start[heads], np.add.reduceat(size, heads), place[heads]


def pieces(schedule: Schedule, s: np.ndarray, at: np.ndarray, n: np.ndarray, window: int, inner: list[list[tuple[Schedule, np.ndarray]]] = ()) -> tuple[np.ndarray, ...]:
    """(document row, start, length, place) of the pieces of documents [at, at + n) of queues s.

    `inner` has the levels of shared queues, lowest first: at each, schedules of groups and every document's branch there (-1: none).
    """
    row, start, size, place = np.arange(len(s)), np.zeros(len(s), np.int64), n, at
    for level in inner:
        found, rest = [], np.ones(len(row), bool)
        for group, branch in level:
            mine = np.flatnonzero(branch[row] >= 0)
            rest[mine] = False
            r, begin, length, to = spread(group, branch[row[mine]], place[mine], size[mine])
            found.append((row[mine[r]], start[mine[r]] + begin, length, to))
        found.append((row[rest], start[rest], size[rest], place[rest]))
        row, start, size, place = joined(*map(np.concatenate, zip(*found, strict=True)))
    r, begin, size, place = spread(schedule, s[row], place, size)
    row, start = row[r], start[r] + begin
    over = np.maximum(0, place % window + size - window)
    row, start = np.concatenate((row, row[over > 0])), np.concatenate((start, (start + size - over)[over > 0]))
    place = np.concatenate((place, (place + size - over)[over > 0]))
    size = np.concatenate((size - over, over[over > 0]))
    return joined(row, start, size, place, window)


def _queues(totals: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(source, queue, n, weight) of each source with its ids `n`; `=` starts the names of own queues, `#` of shared ones."""
    spark = totals.sparkSession
    if not weights:
        totals = totals.withColumn("weight", F.col("n").cast("double"))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
        totals = totals.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    own = F.concat(F.lit("="), F.col("source"))
    if len(totals.limit(QUEUES + 1).collect()) <= QUEUES:
        return totals.withColumn("queue", own)
    largest = totals.orderBy(F.desc("n"), "source").limit(QUEUES - SHARED).select("source", F.lit(True).alias("own"))
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("string"))
    return totals.join(F.broadcast(largest), "source", "left").withColumn("queue", F.when(F.col("own"), own).otherwise(shared)).drop("own")


GROUP = "array<struct<node:string,branch:int,n:array<long>,weight:array<double>>>"


def _inner(queues: DataFrame) -> DataFrame:
    """(source, inner) of each source of a shared queue: the groups of at most `FAN` branches that it is in, lowest first.

    A branch is a source, or a group of them with the sum of its sources' ids and weights; the topmost group is the queue.
    """
    number = (F.row_number().over(Window.partitionBy("queue").orderBy("source")) - 1).cast("long")
    shared = materialise(queues.where(F.col("queue").startswith("#")).withColumn("number", number), "shared-queues")
    most = shared.agg(F.max("number")).first()[0]
    nodes, paths, groups, width = shared.select("queue", "number", "n", "weight"), shared.select("source", "queue", "number"), [], 1
    while width <= most or not groups:
        node, up = f"node{width}", F.expr(f"number div {FAN}").alias("up")
        found = nodes.groupBy("queue", up).agg(F.sort_array(F.collect_list(F.struct("number", "n", "weight"))).alias("branches"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
        about = F.struct(F.concat_ws("/", F.lit(width), "queue", "up").alias("node"), F.col("branches.n").alias("n"), F.col("branches.weight").alias("weight"))
        paths = paths.withColumn("up", F.expr(f"number div {width * FAN}")).join(found.select("queue", "up", about.alias(node)), ["queue", "up"]).drop("up")
        groups.append(F.struct(F.col(f"{node}.node"), F.expr(f"cast(number div {width} % {FAN} AS int)").alias("branch"), F.col(f"{node}.n"), F.col(f"{node}.weight")))
        nodes, width = found.select("queue", F.col("up").alias("number"), "n", "weight"), width * FAN
    return paths.select("source", F.array(*groups).cast(GROUP).alias("inner"))


def _levels(paths: list[list[dict] | None], quantum: int) -> list[list[tuple[Schedule, np.ndarray]]]:
    """The `inner` of pieces(), from that of each document."""
    out = []
    for depth in range(max((len(p) for p in paths if p), default=0)):
        groups: dict[str, tuple[Schedule, np.ndarray]] = {}
        for k, g in ((k, p[depth]) for k, p in enumerate(paths) if p):
            if g["node"] not in groups:
                groups[g["node"]] = Schedule(dict(enumerate(g["n"])), dict(enumerate(g["weight"])), quantum), np.full(len(paths), -1, np.int64)
            groups[g["node"]][1][k] = g["branch"]
        out.append([*groups.values()])
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, quantum: int = 256, weights: dict[str, float] | None = None, max_sources: int | None = None) -> DataFrame:
    """Pieces of all documents in windows of `window` ids, every window near the target token shares of sources.

    Rows: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    source, padded_length. `weights` are target shares by source; the default is each source's share of the ids,
    so all queues end together. All windows are full but the last, which is padded to a power of two. A
    null source is the queue "". Null and empty texts are one `end` id. Repeated rows are packed as often as they
    occur, null doc_ids keep null. An empty table packs into no rows. Any number of sources packs, each with its own deficit: of over
    `QUEUES`, the largest have queues of their own, and the others are dealt by hash over `SHARED` queues with the sum of
    their shares, in which deficit round-robin serves groups of `FAN` branches, and in them smaller ones, down to the
    sources; only a caller that gives `max_sources` has more of them as an error. `tokenizer` must not join
    words over ASCII white space. Ids are written once, by input partition, and joined to one offset per partition and source: a
    written table too, so that Spark knows its size and broadcasts it while it is small.
    """
    tokens = _tokenised(docs, tokenizer, end)
    parts = materialise(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "source-ids")
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    if max_sources is not None and len(totals.limit(max_sources + 1).collect()) > max_sources:
        raise ValueError(f"more than {max_sources} sources; give a coarser source column")
    queues = materialise(_queues(totals, weights).select("source", "queue", "n", "weight").coalesce(8), "queues")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = queues.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()
    begins = parts.select("part", "source", before.alias("base")).join(queues.select("source", "queue"), "source")
    shared = any(r.queue.startswith("#") for r in found)
    begins = begins.join(_inner(queues), "source", "left") if shared else begins.withColumn("inner", F.lit(None).cast(GROUP))
    begins = materialise(begins.coalesce(8), "offsets")
    spark = docs.sparkSession
    total = sum(r.n for r in found)
    shape = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string, padded_length long"
    if not total:
        return spark.createDataFrame([], shape)
    schedule = Schedule({r.queue: r.n for r in found}, {r.queue: r.weight for r in found}, quantum)
    rest = total - total // window * window
    last = min(window, 1 << max(0, int(rest - 1).bit_length())) if rest else window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=4, limit=1 << 20):
            s = np.array([schedule.index[x] for x in batch.column(5).to_pylist()], np.int64)
            at, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            data, offsets = flat(batch.column(4))
            width = int(offsets[-1]) // int(n.sum())
            ids = np.frombuffer(data.tobytes(), np.dtype(f"<u{width}")).astype("<u4")
            row, start, length, place = pieces(schedule, s, at, n, window, _levels(batch.column(6).to_pylist(), quantum))
            begin = offsets[row] // width + start
            order = np.argsort(begin)  # pieces tile the ids in this order
            row, start, length, place = row[order], start[order], length[order], place[order]
            ends = np.concatenate(([0], np.cumsum(length))) * 4
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            sequence = place // window
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), held, pa.array(n[row]), pa.array(sequence), pa.array(place % window), batch.column(1).take(pa.array(row)), pa.array(np.where(sequence == total // window, last, window))],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source", "padded_length"],
            )

    return tokens.join(begins, ["part", "source"]).select("doc_id", "source", (F.col("at") + F.col("base")).alias("at"), "n", "ids", "queue", "inner").mapInArrow(cut, shape)
