"""What filters remove together: exact copies by a fingerprint-routed RDD, counts of failure masks by combineByKey."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SYMBOLS = re.compile(rb"[#$%&*|]")
#: Texts that a task holds at once to find copies before the exchange, and those that a task gets after it, in bytes.
HELD_BYTES, PART_BYTES = 32 << 20, 16 << 20
Chains = dict[int, list[list]]


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 50


def low_variety(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    a = np.frombuffer(text, np.uint8)
    capitals, points = np.count_nonzero((a >= 0x41) & (a <= 0x5A)), np.count_nonzero((a & 0xC0) != 0x80)
    return 100 * capitals > 5 * points


def symbols(text: bytes, words: list[bytes]) -> bool:
    return SYMBOLS.search(text) is not None


#: Tests of one text by letter, in the order of the mask's bits; the copy test's letter comes after them.
TESTS: dict[str, Callable[[bytes, list[bytes]], bool]] = {"A": few_words, "B": low_variety, "C": shouting, "D": symbols}
COPY = "E"


def _chain(chains: Chains, text: bytes, mark: int, doc_id: int, facts: Counter) -> tuple[int, Counter] | None:
    """Put a text into its collision chain, which holds it whole with the smallest id; what is (or was) not smallest comes back."""
    chain = chains.setdefault(mark, [])
    for link in chain:
        if link[0] == text:
            if doc_id == link[1]:
                link[2] += facts
                return None
            if doc_id > link[1]:
                return doc_id, facts
            out = link[1], link[2]
            link[1], link[2] = doc_id, facts
            return out
    chain.append([text, doc_id, facts])
    return None


def failures(docs: DataFrame, tests: dict[str, Callable[[bytes, list[bytes]], bool]] = TESTS) -> RDD:
    """(doc_id, part, mask, n): n rows of an id and part fail the tests whose bits are set, the last one being "a smaller id has this text".

    Every input task chains its own texts first, some 32 MB at a time: rows that aren't of the smallest id there are settled. Only
    one row a text and stretch goes on, to the partition of its fingerprint (xxhash), where chains of whole texts give the smallest
    id of all. So a text that a third of all rows have is sent once a task, and equal fingerprints of other texts do no harm.
    """
    copy = 1 << len(tests)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def settled(doc_id: int, facts: Counter) -> Iterator[tuple]:
        for (part, mask), n in facts.items():
            yield xxhash.xxh64_intdigest(f"{doc_id}:{part}:{mask}"), (None, doc_id, part, mask | copy, n)

    def look(batch: Iterator) -> Iterator[tuple]:
        chains, held = {}, 0
        for doc_id, text, part in batch:
            text = bytes(text)
            words = text.split()
            mask = sum(1 << k for k, f in enumerate(tests.values()) if f(text, words))
            if doc_id is None:
                yield xxhash.xxh64_intdigest(f"{part}:{mask}"), (None, None, part, mask, 1)
                continue
            mark = xxhash.xxh64_intdigest(text)
            if out := _chain(chains, text, mark, doc_id, Counter({(part, mask): 1})):
                yield from settled(*out)
            else:
                held += len(text) + 200
            if held > HELD_BYTES:
                yield from waiting(chains)
                chains, held = {}, 0
        yield from waiting(chains)

    def waiting(chains: Chains) -> Iterator[tuple]:
        for mark, chain in chains.items():
            for text, doc_id, facts in chain:
                yield mark, (text, doc_id, dict(facts))

    def route(batch: Iterator[tuple]) -> Iterator[tuple]:
        chains = {}
        for mark, (text, doc_id, *rest) in batch:
            if text is None:
                yield doc_id, *rest
            elif out := _chain(chains, text, mark, doc_id, Counter(rest[0])):
                for (part, mask), n in out[1].items():
                    yield out[0], part, mask | copy, n
        for chain in chains.values():
            for _, doc_id, facts in chain:
                for (part, mask), n in facts.items():
                    yield doc_id, part, mask, n

    return rows.rdd.mapPartitions(look).partitionBy(parts, lambda mark: mark % parts).mapPartitions(route)


def labelled(found: RDD, labels: DataFrame, columns: tuple[str, ...], parts: int) -> RDD:
    """(part, mask, n, flags): flag k is set where the id's label `columns[k]` is 1; of several labels the largest holds."""
    flags = sum(F.when(F.max(F.col(c).cast("int")) == 1, 1 << k).otherwise(0) for k, c in enumerate(columns))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flags.alias("flags")).where("flags > 0")
    marks = marks.rdd.map(lambda r: (r.doc_id, (r.flags, {})))
    facts = found.map(lambda r: (r[0] if r[0] is not None else f"{r[1]}:{r[2]}", (0, {(r[1], r[2]): r[3]})))  # text is no id, so it has no label

    def add(a: tuple[int, dict], b: tuple[int, dict]) -> tuple[int, dict]:
        both = a[1]
        for k, n in b[1].items():
            both[k] = both.get(k, 0) + n
        return a[0] | b[0], both

    joined = facts.union(marks).combineByKey(lambda v: (v[0], dict(v[1])), add, add, parts)
    return joined.flatMap(lambda r: ((part, mask, n, r[1][0]) for (part, mask), n in r[1][1].items()))


def mask_vectors(marked: RDD, width: int, flags: int, parts: int) -> RDD:
    """(part, vector): documents of each mask and flags. Tasks add their own vectors up first, so a hot part is one row a task."""
    cells = (1 << width) << flags

    def put(v: np.ndarray, row: tuple[int, int, int]) -> np.ndarray:
        v[row[0] << flags | row[2]] += row[1]
        return v

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    return marked.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(lambda row: put(np.zeros(cells, np.int64), row), put, add, parts)


def orders(vector: np.ndarray, letters: str, flags: tuple[str, ...]) -> Iterator[tuple]:
    """Every order and step of one part, from its mask counts alone: documents of a mask meet the same fate in an order."""
    table = vector.reshape(-1, 1 << len(flags))
    n, masks = table.sum(1), np.arange(len(table))
    marked = [table[:, (np.arange(1 << len(flags)) >> k & 1) == 1].sum(1) for k in range(len(flags))]
    sums = lambda at: (int(n[at].sum()), *(int(m[at].sum()) for m in marked))
    rows, shapley = [], Counter()
    for order in permutations(range(len(letters))):
        before = 0
        for step, k in enumerate(order, 1):
            fails, gone = (masks >> k & 1) == 1, (masks & before) != 0
            before |= 1 << k
            removed, *lost = sums(fails & ~gone)
            shapley[k] += removed
            rows.append((order, step, k, int(n[(masks & before) == 0].sum()), removed, int(n[fails & gone].sum()), int(n[1 << k]), *lost))
    for order, step, k, *rest in rows:
        yield "".join(letters[j] for j in order), step, *rest, shapley[k]


def filter_audit(docs: DataFrame, labels: DataFrame, tests: dict[str, Callable[[bytes, list[bytes]], bool]] = TESTS, columns: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """One row per part (source), order of the filters and step: what is kept and removed there, and what the filter does alone.

    removed: documents that fail the step's filter and none before it; redundant: fail it, but are gone; unique_fails: fail it
    only; lost_<label>: removed with that label 1; shapley: the filter's removals in all orders. The last filter, E, removes a text
    that any smaller doc_id has, in whatever part and removed or not. Copies, labels and mask counts each take one exchange, added
    up before it; parts have a vector of 2^filters x 2^labels counts, from which all orders follow. A null text is an empty one, a
    null source the part ""; a null doc_id is smaller or larger than nothing, so it neither fails E nor makes others fail, and has no
    label; rows that repeat id and text count each and stay or go together; without rows there are no parts; other columns are ignored.
    """
    letters, spark = "".join(tests) + COPY, docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = labelled(failures(docs, tests), labels, columns, parts)
    rows = mask_vectors(marked, len(letters), len(columns), parts).flatMap(lambda r: ((r[0], *row) for row in orders(r[1], letters, columns)))
    lost = ", ".join(f"lost_{c} long" for c in columns)
    return spark.createDataFrame(rows, f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, {lost}, shapley long")
