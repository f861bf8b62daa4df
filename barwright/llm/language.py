"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, slices, text_bytes
from .learn import sample_by_class

ORDERS = (1, 2, 3)
SCALE = 64.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and each text's offsets into them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    more = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    b0, b1, b2, b3 = more[lead], more[lead + 1] & 0x3F, more[lead + 2] & 0x3F, more[lead + 3] & 0x3F
    two, three = (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2
    out = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, ((b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3) % 0x110000)))
    return out, np.searchsorted(lead, offsets)


def ngrams(data: np.ndarray, offsets: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each text (any letter in them), the texts' offsets, and their letters' number."""
    points, ends = code_points(data, offsets)
    c = _letters()[points].astype(np.uint64)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    letter = c != 0x20
    n_letters = np.bincount(doc, weights=letter, minlength=len(ends) - 1)
    key, any_, out, docs = np.zeros(len(c), np.uint64), np.zeros(len(c), bool), [], []
    for n in ORDERS:
        k = len(c) - n + 1
        if k <= 0:
            break
        key = key[:k] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        any_ = any_[:k] | letter[n - 1 :]
        use = any_ & (doc[:k] == doc[n - 1 :])
        h = key[use] * np.uint64(0x9E3779B97F4A7C15)
        out.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - dim.bit_length() + 1)).astype(np.int32))
        docs.append(doc[:k][use])
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(ends), np.int64), n_letters
    out, docs = np.concatenate(out), np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return out[order], np.searchsorted(docs[order], np.arange(len(ends))), n_letters


def document_frequencies(texts: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """In how many texts of the whole frame each bucket occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts_seen, seen = np.zeros(dim, np.int64), 0, np.zeros(dim, bool)
        for batch in slices(batches):
            buckets, ends, _ = ngrams(*flat(batch.column(1)), dim)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if b - a < dim // 8:
                    total[np.unique(buckets[a:b])] += 1
                else:
                    seen[buckets[a:b]] = True
                    total += seen
                    seen[:] = False
            texts_seen += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], texts_seen))], ["bucket", "n"])

    found = text_bytes(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(dim)
    held = found[found.bucket >= 0]
    out[held.bucket.to_numpy()] = held.n.to_numpy()
    return out, int(found[found.bucket < 0].n.sum())


class Model:
    """Weights already times IDF, so a text's logits are sums over its n-grams over the sum of their IDF."""

    def __init__(self, classes: list[str], weights: np.ndarray, idf: np.ndarray, bias: np.ndarray, temperature: float):
        self.classes, self.idf, self.bias, self.temperature = classes, idf.astype(np.float32), bias, temperature
        self.weights = (weights * idf[:, None] * SCALE).astype(np.float32)

    def probabilities(self, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        texts, used = len(ends) - 1, np.diff(ends) > 0
        logits = np.tile(self.bias, (texts, 1))
        if used.any():
            at = ends[:-1][used]
            over = np.add.reduceat(self.idf[buckets], at, dtype=np.float64)
            for k in range(len(self.classes)):
                logits[used, k] += np.add.reduceat(self.weights[buckets, k], at, dtype=np.float64) / over
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_regularised_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dim: int, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.002, l2: float = 0.01, epochs: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net: weights (dim, classes), many of them exactly 0, and a bias."""
    z, n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, x = np.append(rows[i][0], dim), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:dim], w[dim]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which held-back rows are likeliest."""
    grid = np.geomspace(0.5, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_language(docs: DataFrame, learnable: Column, per_class: int = 500, dim: int = 1 << 15, seed: int = 7) -> Model | None:
    """Fit on about `per_class` learnable texts of each language; IDF is over all of them. None without any.

    A fifth of the sample is held back for the temperature. Of the sample, which is about 100,000 rows at most, only counts by bucket reach
    the driver; every language is learnt, with fewer rows of each where there are many. Weights grow with the number of languages.
    Rows that repeat count in the IDF, but are learnt once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(learnable).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    df, texts = document_frequencies(rows, dim)
    if not texts:
        return None
    idf = np.log((1 + texts) / (1 + df)) + 1

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buckets, ends, _ = ngrams(*flat(batch.column(1)), dim)
            at, tf = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                u, c = np.unique(buckets[a:b], return_counts=True)
                at.append(u)
                tf.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["lang", "doc_id", "at", "tf"])

    drawn = sample_by_class(rows, "lang", per_class, seed, text="text")
    sample = drawn.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), "lang").mapInArrow(counts, "lang string, doc_id long, at array<int>, tf array<int>").where("size(at) > 0").toPandas()
    sample = sample.sort_values(["doc_id", "lang"], kind="stable")
    classes = sorted(set(sample.lang))
    if not classes:
        return None
    y = np.array([classes.index(x) for x in sample.lang])
    data = []
    for at, tf in zip(sample["at"], sample["tf"], strict=True):
        x = np.asarray(tf) * idf[np.asarray(at)]
        data.append((np.asarray(at), SCALE * x / x.sum()))
    back = np.arange(len(data)) % 5 == 4
    train = [d for d, b in zip(data, back, strict=True) if not b]
    w, bias = follow_the_regularised_leader(train, y[~back], len(classes), dim, seed=seed)
    logits = np.array([x @ w[at] + bias for (at, x), b in zip(data, back, strict=True) if b])
    return Model(classes, w, idf, bias, temperature(logits, y[back]) if len(logits) else 1.0)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its calibrated probability.

    Null text and text without a letter are "und" with score 1, as is everything without a model (no learnable
    rows, score 0). Repeated rows and null doc_ids are predicted like any row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buckets, ends, letters = ngrams(*flat(batch.column(1)), len(model.idf) if model else 2)
            if model:
                p = model.probabilities(buckets, ends)
                names, score = np.array(model.classes, object)[p.argmax(1)], p.max(1)
            else:
                names, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            none = letters == 0
            names[none], score[none] = UNKNOWN, 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
