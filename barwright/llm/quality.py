"""Quality by attention-based multiple-instance learning: documents are bags of passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, flat, materialise, slices, small_batches, text_bytes
from .learn import labelled_sample
from .rules import Slice

PASSAGE_WORDS = 64
#: Passages of a part (a batch has up to 1,000 parts), passages of a task while they are few, and tasks of a step at most.
PART, TASK_PASSAGES, TASKS = 4, 20_000, 64
CLASSES = 129
WORD_BUCKETS, GRAM_BUCKETS = 64, 192
HASHED_SCALE = 0.1
EXTRA = 6
INPUTS = CLASSES + WORD_BUCKETS + GRAM_BUCKETS + EXTRA
#: A word's digest is the sum of its bytes, each times a factor of its place in the word.
FACTORS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _shares(passage: np.ndarray, bucket: np.ndarray, rows: int, buckets: int) -> np.ndarray:
    """The root of each bucket's share in each passage."""
    seen = np.bincount(passage * buckets + bucket, minlength=rows * buckets).reshape(rows, buckets).astype(np.float32)
    return np.sqrt(seen / np.maximum(1, seen.sum(1, keepdims=True)))


def passages(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of every passage (runs of 64 words; a text without words has one empty one) and their text's row.

    They are the shares of bytes, of hashed words and of hashed runs of three bytes, in lower case, and six counts.
    """
    n = len(s.texts)
    per = np.maximum(1, -(-s.n_words // PASSAGE_WORDS))
    first = np.cumsum(per) - per
    rows = int(per.sum())
    inside = ~WHITESPACE[s.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[s.offsets[:-1][s.offsets[:-1] < len(inside)]] |= inside[s.offsets[:-1][s.offsets[:-1] < len(inside)]]
    doc = np.repeat(np.arange(n), np.diff(s.offsets))
    word = np.cumsum(begins) - 1
    before = np.cumsum(s.n_words) - s.n_words
    at = first[doc] + np.maximum(0, word - before[doc]) // PASSAGE_WORDS
    seen = np.bincount(at * CLASSES + np.minimum(s.data, 128), minlength=rows * CLASSES).reshape(rows, CLASSES).astype(np.float32)
    size = seen.sum(1, keepdims=True)
    low = LOWER[s.data]
    starts = np.flatnonzero(begins)
    in_word = np.flatnonzero(inside)
    place = in_word - starts[word[in_word]] if len(starts) else in_word
    total = np.concatenate(([np.uint64(0)], np.cumsum((low[in_word].astype(np.uint64) + np.uint64(1)) * FACTORS[place & 63])))
    first_byte = np.searchsorted(in_word, starts)
    digest = total[np.append(first_byte[1:], len(in_word))] - total[first_byte] if len(starts) else np.zeros(0, np.uint64)
    three = low.astype(np.uint64)
    three = three[:-2] | three[1:-1] << np.uint64(8) | three[2:] << np.uint64(16) if len(low) > 2 else three[:0]
    one_text = np.flatnonzero(doc[:-2] == doc[2:]) if len(low) > 2 else np.zeros(0, np.int64)
    of_word = np.repeat(np.arange(n), s.n_words)
    passage = first[of_word] + (np.arange(len(of_word)) - before[of_word]) // PASSAGE_WORDS
    words = np.bincount(passage, minlength=rows)
    h = s.hashes
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((h, passage))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], weights=new, minlength=rows)
    share = lambda x: x / np.maximum(1, words)
    extra = np.stack([share(np.bincount(passage, weights=same, minlength=rows)), share(distinct), share(np.bincount(passage, weights=s.repeated, minlength=rows)), np.minimum(words, PASSAGE_WORDS) / PASSAGE_WORDS, np.log1p(size[:, 0] / np.maximum(1, words)), np.log1p(np.minimum(s.n_words, 1000))[np.repeat(np.arange(n), per)] / 7], 1)
    hashed = _shares(passage, _bucket(digest, WORD_BUCKETS), rows, WORD_BUCKETS), _shares(at[one_text], _bucket(three[one_text], GRAM_BUCKETS), rows, GRAM_BUCKETS)
    return np.concatenate((np.sqrt(seen / np.maximum(1, size)), *hashed, extra), 1).astype(np.float32), np.repeat(np.arange(n), per)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """encode: h = tanh(xW + b); attention: softmax over a text of u . (tanh(hV) * sigmoid(hU)); score: sigmoid(c . z + d).

    |u . (...)| is at most the sum of |u|, so the softmax needs no shift, and a text's sums may come from several parts of it.
    """

    def __init__(self, inputs: int, hidden: int = 24, gate: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"W": r.normal(0, 1 / np.sqrt(8), (inputs, hidden)), "b": np.zeros(hidden), "V": r.normal(0, 0.3, (hidden, gate)), "U": r.normal(0, 0.3, (hidden, gate)), "u": r.normal(0, 0.3, gate), "c": r.normal(0, 0.3, hidden), "d": np.zeros(1)}
        self.shift, self.scale = np.zeros(inputs), np.ones(inputs)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift.astype(np.float32)) * (self.scale * 0.5).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hidden, tanh gate, sigmoid gate, weight before it is made a share) of passages."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, np.exp((t * s) @ p["u"])

    def sums(self, x: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        """(bags, 1 + hidden): each text's sums of weights and of weighted passages, of the passages given."""
        h, _, _, e = self.encode(x)
        out = np.zeros((bags, 1 + h.shape[1]))
        np.add.at(out, bag, np.concatenate((e[:, None], e[:, None] * h), 1))
        return out

    def judge(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, representation) of texts from their sums."""
        z = sums[:, 1:] / sums[:, :1]
        return _sigmoid(z @ self.p["c"] + self.p["d"]), z

    def gradient(self, x: np.ndarray, bag: np.ndarray, total: np.ndarray, z: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """What the passages given add to the gradient of W, b, V, U and u, from their texts' sums of weights, z and d = dloss/dlogit."""
        p = self.p
        h, t, s, e = self.encode(x)
        a = e / total[bag]
        dz = d[:, None] * p["c"]
        dlogit = a * ((dz[bag] * h).sum(1) - (dz * z).sum(1)[bag])
        dgate = dlogit[:, None] * p["u"]
        dt, ds = dgate * s * (1 - t**2), dgate * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "u": (t * s).T @ dlogit}

    def fit(self, parts: Parts, y: np.ndarray, weight: np.ndarray, steps: int = 100, rate: float = 0.04, decay: float = 1e-4) -> None:
        """Adam on the whole weighted log loss. `parts` adds functions of parts of the passages up, wherever those are."""
        moments = parts.total(lambda x, bag: np.stack([x.sum(0, dtype=float), np.einsum("ij,ij->j", x, x, dtype=float, casting="same_kind"), np.full(x.shape[1], float(len(x)))]))
        self.shift = moments[0] / moments[2]
        self.scale = 1 / (np.sqrt(np.maximum(0, moments[1] / moments[2] - self.shift**2)) + 0.02)
        if len(self.shift) == INPUTS:  # many hashed inputs, each of little weight
            self.scale[CLASSES : INPUTS - EXTRA] *= HASHED_SCALE
        m, v, bags = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, len(y)
        weight = weight / weight.sum()
        for step in range(1, steps + 1):
            sums = parts.total(lambda x, bag: self.sums(self.scaled(x), bag, bags))
            out, z = self.judge(sums)
            d = (out - y) * weight
            parted = parts.total(lambda x, bag, total=sums[:, 0], z=z, d=d: _packed(self.gradient(self.scaled(x), bag, total, z, d)))
            g = _unpacked(parted, {k: w for k, w in self.p.items() if k not in "cd"}) | {"c": z.T @ d, "d": np.array([d.sum()])}
            lr = rate * 0.5 * (1 + np.cos(np.pi * (step - 1) / steps))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])

    def score(self, s: Slice) -> np.ndarray:
        x, bag = passages(s)
        return self.judge(self.sums(self.scaled(x), bag, len(s.texts)))[0]


def _packed(g: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([g[k].ravel() for k in ("W", "b", "V", "U", "u")])


def _unpacked(flat_: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([w.size for w in like.values()])
    return {k: part.reshape(w.shape) for (k, w), part in zip(like.items(), np.split(flat_, ends[:-1]), strict=True)}


class Parts:
    """Passages in a table of parts (x: inputs, marks: text of each passage), read by tasks in batches; a text may lie in several parts."""

    def __init__(self, held: DataFrame, marks: np.ndarray):
        self.held, self.marks = held, marks

    def total(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of f over all passages. f takes a batch's inputs and the numbers of their texts; each task gives one row."""
        marks = self.marks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                if batch.num_rows:
                    x = flat(batch.column(0))[0].view(np.float32).reshape(-1, INPUTS)
                    made = f(x, np.searchsorted(marks, flat(batch.column(1))[0].view(np.int64)))
                    found = made if found is None else found + made
            if found is not None:
                shape = pa.array([list(found.shape)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([shape, pa.array([found.astype(float).tobytes()], pa.binary())], ["shape", "sums"])

        return sum(np.frombuffer(bytes(r["sums"])).reshape(r["shape"]) for r in self.held.mapInArrow(run, "shape array<long>, sums binary").collect())


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality", per_class: int = 600, seed: int = 5) -> AttentionModel | None:
    """Fit on at most `per_class` labelled documents of each class, whole; None if there are none.

    Passages are written in parts of a few, whatever text they are of. A step sums every text's weights and weighted passages, then the
    gradient; of each of at most TASKS tasks only such sums reach the driver. The classes are weighted back to their shares among the labels, so
    scores are probabilities. Null ids aren't learnt from; texts that share an id are texts of their own.
    """
    mark = F.xxhash64("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bag = passages(Slice(batch.column(1)))
            marks = batch.column(0).take(pa.array(bag)).to_numpy()
            for k in range(0, len(x), PART):
                yield pa.RecordBatch.from_arrays([pa.array([x[k : k + PART].tobytes()], pa.binary()), pa.array([marks[k : k + PART].tobytes()], pa.binary())], ["x", "marks"])

    rows = labels.select(F.col(label).cast("int").alias("label"), "doc_id").where("doc_id is not null").where(learnable)
    share = {r.label: r["count"] for r in rows.where("label is not null").groupBy("label").count().collect()}
    sample = labelled_sample(docs, labels, label, learnable, per_class, seed).where("label in (0, 1)").withColumn("mark", mark)
    texts = sorted((r.mark, r.label) for r in sample.select("mark", "label").collect())
    if not texts:
        return None
    marks, y = (np.array(c) for c in zip(*texts, strict=True))
    parts = materialise(sample.select("mark", "text").mapInArrow(cut, "x binary, marks binary"), "passages")
    rows = parts.agg(F.sum(F.octet_length("marks"))).first()[0] // 8
    held = parts.coalesce(min(TASKS, -(-rows // TASK_PASSAGES))).persist()
    weight = np.array([share.get(c, 1) / max(1, (y == c).sum()) for c in (0, 1)])[y]
    model = AttentionModel(INPUTS)
    try:
        model.fit(Parts(held, marks), y.astype(float), weight)
    finally:
        held.unpersist()
    return model


def quality_scores(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text.

    Null and empty texts have one empty passage and are scored as that; without a model every score is 0.5.
    Repeated rows and null doc_ids are scored like any row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.score(Slice(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, score double")


def quality_filter(docs: DataFrame, model: AttentionModel | None, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns as they were, whose score is at least `threshold`. Nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=at):
            if model:
                yield batch.filter(pa.array(model.score(Slice(batch.column(at).cast(pa.binary()))) >= threshold))
            else:
                yield batch

    return small_batches(docs).mapInArrow(run, docs.schema)
