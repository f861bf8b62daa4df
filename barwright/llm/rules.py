"""Quality rules as a short-circuit cascade, ordered by rejections per cost measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, flat, segment_sum, slices, text_bytes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LOWER = np.zeros(256, bool)
LOWER[ord("a") : ord("z") + 1] = True

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Slice:
    """A run of texts with the base counts, and what rules derive from them for chosen rows only."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat(column)
        raw = self.data.tobytes()
        self.texts = [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]
        n = len(self.texts)
        inside = ~WHITESPACE[self.data]
        words = [t.split() for t in self.texts]
        self.n_words = np.fromiter(map(len, words), np.int64, n)
        self.word_chars = segment_sum(inside & ((self.data & 0xC0) != 0x80), self.offsets)
        self.n_symbols = segment_sum(SYMBOLS[self.data], self.offsets)
        self.n_lines, self.n_dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, t in enumerate(self.texts):
            lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else ([t] if words[i] else [])
            self.n_lines[i] = len(lines)
            self.n_dup_lines[i] = len(lines) - len(set(lines))
        self.n_repeat_words = self._repeats(words)

    def _repeats(self, words: list[list[bytes]]) -> np.ndarray:
        total = int(self.n_words.sum())
        self.hashes = h = np.fromiter((hash(w) for ws in words for w in ws), np.int64, total).view(np.uint64)
        self.repeated = np.zeros(total, bool)
        if total < 3:
            return np.zeros(len(words), np.int64)
        doc = np.repeat(np.arange(len(words)), self.n_words)
        key = _mix(h[:-2], h[1:-1], h[2:], doc[:-2])
        where = np.flatnonzero(doc[:-2] == doc[2:])
        order = where[np.argsort(key[where])]
        same = key[order[1:]] == key[order[:-1]]
        found = self.repeated
        for step in range(3):
            found[order[1:][same] + step] = True
            found[order[:-1][same] + step] = True
        return np.bincount(doc, weights=found, minlength=len(words)).astype(np.int64)

    def share(self, which: np.ndarray, of: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each row, bytes in `which` over bytes in `of`; only those rows' bytes are looked at."""
        out = np.zeros(len(rows))
        for k, i in enumerate(rows):
            seen = np.bincount(self.data[self.offsets[i] : self.offsets[i + 1]], minlength=256)
            out[k] = seen[which].sum() / max(1, seen[of].sum())
        return out


Rule = Callable[[Slice, np.ndarray], np.ndarray]


def default_rules() -> dict[str, Rule]:
    """Each takes a slice and row numbers and says which of those rows it rejects."""
    return {
        "symbols_per_word": lambda s, r: s.n_symbols[r] > 0.1 * s.n_words[r],
        "duplicate_lines": lambda s, r: (s.n_dup_lines[r] >= 2) & (s.n_dup_lines[r] > 0.3 * s.n_lines[r]),
        "mean_word_length": lambda s, r: ~((2 * s.n_words[r] <= s.word_chars[r]) & (s.word_chars[r] <= 15 * s.n_words[r])),
        "shouting": lambda s, r: s.share(UPPER, UPPER | LOWER, r) > 0.3,
        "few_letters": lambda s, r: s.share(UPPER | LOWER | (np.arange(256) >= 0x80), ~WHITESPACE, r) < 0.6,
        "word_variety": lambda s, r: np.array([len(set(s.texts[i].split())) < 0.1 * min(s.n_words[i], 500) for i in r], bool),
    }


def base_failed(s: Slice) -> np.ndarray:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def measured(docs: DataFrame, rules: dict[str, Rule], rows: int, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """(rejected, seconds) of about `rows` drawn documents that pass the base check, twice that at most: a row a document, a column a rule.

    Tasks run every rule on each drawn text, whole, one at a time; only verdicts and times come back.
    """
    names = sorted(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = Slice(batch.column(1))
            out, spent = [], []
            for i in np.flatnonzero(~base_failed(s)):
                row, verdicts, times = np.array([i]), [], []
                for name in names:
                    began = time.perf_counter()
                    verdicts.append(bool(rules[name](s, row)[0]))
                    times.append(time.perf_counter() - began)
                out.append(verdicts), spent.append(times)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.bool_())), pa.array(spent, pa.list_(pa.float64()))], ["rejected", "seconds"])

    share = min(1.0, rows / max(1, docs.count()))
    some = text_bytes(docs).where("text is not null").where(F.rand(seed) < share)
    found = some.mapInArrow(measure, "rejected array<boolean>, seconds array<double>").limit(2 * rows).collect()
    return np.array([r.rejected for r in found], bool).reshape(-1, len(names)), np.array([r.seconds for r in found], float).reshape(-1, len(names))


def rule_order(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = 1000) -> list[str]:
    """Names of the rules by rejections per second, each measured on what reaches it in the cascade.

    About `sample_rows` documents of any length are drawn over all partitions. Those that pass the base check are left; the rule with
    most rejections per second on them comes first, then the one with most on what it leaves, and so on. The sample only
    decides the order, never the verdict, which is a conjunction. Equal rates go by name; without a sample all do. Null ids and
    repeated rows are drawn like any row; texts that are null aren't.
    """
    rules = rules or default_rules()
    rejected, seconds = measured(docs, rules, sample_rows)
    left, open_, order = np.ones(len(rejected), bool), sorted(rules), []
    column = {name: k for k, name in enumerate(open_)}
    while open_:
        rate = {name: (rejected[left, column[name]].sum() + 1e-3) / (seconds[left, column[name]].sum() + 1e-9) if left.any() else 0.0 for name in open_}
        best = max(open_, key=rate.__getitem__)
        order.append(best)
        open_.remove(best)
        left &= ~rejected[:, column[best]]
    return order


def quality_rules(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """Base counts, base_failed, kept, and the rule that rejected each document (null if none).

    Rules run in the measured order, each only on the rows that are left: base failures are never passed to them.
    Null text counts as no words (so base_failed); a null doc_id and repeated rows are judged like any row; an
    empty table gives an empty result; other input columns are ignored.
    """
    rules = rules or default_rules()
    order = rule_order(docs, rules, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = Slice(batch.column(1))
            failed = base_failed(s)
            by = np.full(batch.num_rows, -1)
            left = np.flatnonzero(~failed)
            for k, name in enumerate(order):
                if not len(left):
                    break
                out = rules[name](s, left)
                by[left[out]] = k
                left = left[~out]
            kept = np.zeros(batch.num_rows, bool)
            kept[left] = True
            names = pa.array([order[k] if k >= 0 else None for k in by.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, kept)), names], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    return text_bytes(docs).mapInArrow(judge, f"doc_id long, {BASE}, base_failed boolean, kept boolean, rejected_by string")
