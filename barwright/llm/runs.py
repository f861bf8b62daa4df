"""Periodic runs of words: a harmonic grid of longest-common-extension queries over suffix arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: A run repeats its period this often at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: So many queries are answered at once, so memory is bounded beside a text's own arrays.
QUERIES = 1 << 20
SHAPE = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed binary"


class Extensions:
    """Longest common extensions of two places of a sequence: suffix array, common prefixes of neighbours, range minima."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        levels = [np.append(rank, -1).astype(np.int32)]
        while n and rank.max() < n - 1:  # prefixes of twice the length
            step = 1 << len(levels) - 1
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            levels.append(np.append(rank, -1).astype(np.int32))
        self.rank = rank
        array = np.empty(n, np.int64)
        array[rank] = np.arange(n)
        a, b, common = array[:-1], array[1:], np.zeros(max(0, n - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            common += (levels[k][a + common] == levels[k][b + common]).astype(np.int64) << k
        self.minima = [common.astype(np.int32)]
        while len(last := self.minima[-1]) > (half := 1 << len(self.minima) - 1):
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For places i != k, how many elements agree from there on."""
        a, b = self.rank[i], self.rank[k]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for t in np.unique(level):
            at = level == t
            out[at] = np.minimum(self.minima[t][low[at]], self.minima[t][high[at] - (1 << int(t))])
        return out


def grid(x: np.ndarray, periods: int) -> Iterator[tuple[int, np.ndarray]]:
    """(p, places jp) for every period up to `periods` whose grid points jp .. (j + 3)p agree.

    A run of four periods covers four neighbouring points of its grid, wherever that begins; elsewhere no query can find one.
    """
    for p in range(1, periods + 1):
        y = x[::p]
        same = y[1:] == y[:-1]
        for _ in range(TIMES - 2):
            same = same[1:] & same[:-1]
        if same.any():
            yield p, np.flatnonzero(same) * p


def maximal_runs(x: np.ndarray, periods: int) -> np.ndarray:
    """(start, end, period) of every run in x, by start, then period; none crosses between texts if their ids differ."""
    n = len(x)
    ahead, behind, found = Extensions(x), Extensions(x[::-1]), []

    def ask(i: np.ndarray, p: np.ndarray) -> None:
        f, b = ahead(i, i + p), np.zeros(len(i), np.int64)
        inner = i > 0
        b[inner] = behind(n - i[inner], n - i[inner] - p[inner])
        length = p + f + b
        at = length >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.stack([(i - b)[at], (i + p + f)[at], p[at]], 1), axis=0))

    held, size = [], 0
    for p, places in grid(x, periods):
        for at in range(0, len(places), QUERIES):
            held.append((places[at : at + QUERIES], p))
            size += len(held[-1][0])
            if size >= QUERIES:
                ask(np.concatenate([a for a, _ in held]), np.concatenate([np.full(len(a), q) for a, q in held]))
                held, size = [], 0
    if held:
        ask(np.concatenate([a for a, _ in held]), np.concatenate([np.full(len(a), q) for a, q in held]))
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), bool)  # a stretch found with several periods has the smallest; the others are its multiples
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    out = out[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, told by its id, with a repetition from some place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of every text. Words become numbers that no other text has, so one sequence holds them all."""
    ids, numbers, base = [], {}, 0
    for words in texts:
        ids.append(np.fromiter((numbers.setdefault(w, base + len(numbers)) for w in words), np.int64, len(words)))
        base, numbers = base + len(numbers), {}
    size = np.array([len(a) for a in ids], np.int64)
    longest = int(size.max(initial=0)) // TIMES
    begin = np.cumsum(size) - size
    x = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    may = np.zeros(len(ids), bool)  # most texts have no place that agrees four times: they need no arrays
    for _, places in grid(x, longest):
        may[np.searchsorted(begin, places, "right") - 1] = True
    out = [np.zeros((0, 3), np.int64)] * len(ids)
    chosen = np.flatnonzero(may)
    if not len(chosen):
        return out
    at = np.cumsum(size[chosen]) - size[chosen]
    found = maximal_runs(np.concatenate([ids[k] for k in chosen]), int(size[chosen].max()) // TIMES)
    ends = np.append(np.searchsorted(found[:, 0], at), len(found))
    for k, text in enumerate(chosen.tolist()):
        out[text] = found[ends[k] : ends[k + 1]] - [at[k], at[k], 0]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The text with every run cut to its first period, words joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    inside = np.cumsum(change[:-1]) > 0
    return b" ".join(w for w, d in zip(words, inside.tolist(), strict=True) if not d) if inside.any() else b" ".join(words)


def periodic_runs(docs: DataFrame, plant: bool = False, slice_bytes: int = 1 << 18) -> DataFrame:
    """Per document: number of runs, the one of greatest exponent, digests of all runs and of the collapsed text, and that text.

    A run is a maximal stretch of words with smallest period q, of max(6, 4q) words or more. For every period p the places jp and
    (j + 1)p are extended forward by the suffix array and backward by that of the reversed words; what spans four periods is
    a run. `plant` gives one document in ten a repetition first. Nothing is shuffled: a task works through runs of texts of
    `slice_bytes`, a longer text alone, in memory of some 300 bytes a word. Null and empty texts have no runs, four nulls and the
    digests of nothing; repeated rows and null ids (never planted) are judged like any row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=slice_bytes):
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if plant:
                texts = [planted(i, w) for i, w in zip(ids, texts, strict=True)]
            rows = []
            for i, words, found in zip(ids, texts, runs_of(texts), strict=True):
                best = (None, None, None, None)
                if len(found):
                    start, length, period = found[:, 0], found[:, 1] - found[:, 0], found[:, 2]
                    ratio = length / period
                    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12)).tolist()
                    k = min(near, key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k]))
                    best = int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k])
                listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in found.tolist()).encode()
                left = collapsed(words, found)
                rows.append((i, len(found), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest(), left))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()]
            names = [c.split()[0] for c in SHAPE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return text_bytes(docs).mapInArrow(run, SHAPE)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_runs): every text with its runs cut to one period."""
    return periodic_runs(docs).select("doc_id", F.col("collapsed").cast("string").alias("text"), "n_runs")
