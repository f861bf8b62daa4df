"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

SPACES = " ▁"
#: At most so many of the commonest pre-tokens, of up to so many characters, are sent to all tasks: 20 MB at most.
COMMON, COMMON_CHARS = 1 << 16, 64
TURN = re.compile(f"[^{SPACES}](?=[{SPACES}])")
#: A task's table of pre-tokens is sent on at this many entries or characters; a text is read in stretches of this many characters.
HELD, HELD_CHARS, STRETCH = 100_000, 8 << 20, 1 << 20


class PreTokens:
    """Cuts a text where no piece of a SentencePiece BPE vocabulary can lie across, and counts the pieces between.

    Two symbols are only ever merged into a piece of the vocabulary. So a text may be cut before a run of spaces, as no piece has a
    space after another character, and on both sides of a character that is in no longer piece: what lies between has
    the same pieces alone as in the text. Vocabularies that have such pieces, and models that drop or change spaces, are refused.
    """

    def __init__(self, path: str):
        self.path = path

    def __getstate__(self) -> dict:
        return {"path": self.path}

    @cached_property
    def model(self):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=self.path)
        if "".join(model.encode(" a  ｂ ", out_type=str)) != "▁▁a▁▁" + "".join(model.encode("ｂ", out_type=str))[1:] + "▁":
            raise ValueError("this model changes texts before it cuts them into pieces")
        return model

    @cached_property
    def joined(self) -> set[str]:
        """Characters, but for spaces, in pieces of two characters or more."""
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        if crossing := [p for p in pieces if SPACES[1] in p.lstrip(SPACES[1])]:
            raise ValueError(f"{len(crossing)} pieces have a space after another character")
        return {c for p in pieces if len(p) > 1 for c in p} - set(SPACES)

    @cached_property
    def pattern(self) -> re.Pattern:
        some = "".join(map(re.escape, sorted(self.joined)))
        return re.compile(f"[{SPACES}]*[{some}]+|[{SPACES}]+|." if some else f"[{SPACES}]+|.", re.DOTALL)

    @cached_property
    def anchor(self) -> tuple[str, int]:
        """A character that joins nothing, and the number of pieces it has at the start of a text."""
        alone = next(c for c in ("\n", *map(chr, range(1, 0xD800))) if c not in self.joined and c not in SPACES)
        return alone, len(self.model.encode(alone))

    def cut(self, text: str) -> Counter:
        """How often each pre-token is in a whole text; a text that isn't empty begins with the model's space."""
        text = " " + text if text else ""
        out, at = Counter(), 0
        while at < len(text):
            end = TURN.search(text, at + STRETCH)
            end = end.end() if end else len(text)
            out.update(self.pattern.findall(text, at, end))
            at = end
        return out

    def count(self, pre: str) -> int:
        """Pieces of one pre-token, anywhere but at the start of a text: after a character that joins nothing."""
        alone, own = self.anchor
        return len(self.model.encode(alone + pre)) - own


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))


def pieces_of_pre_tokens(docs: DataFrame, cutter: PreTokens) -> DataFrame:
    """(pre, uses, pieces): every distinct pre-token of the corpus, how often it occurs, and its number of pieces, counted once.

    Tasks add their own tables up before the shuffle, so a common pre-token is one row a task and no key is hot.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = cutter.cut(text)
                chars += sum(len(k) for k in found if k not in held)
                held.update(found)
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pre", "uses"])
                    held, chars = Counter(), 0
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pre", "uses"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [cutter.count(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["pre", "uses", "pieces"])

    distinct = _texts(docs).select("text").mapInArrow(tables, "pre string, uses long").groupBy("pre").agg(F.sum("uses").alias("uses"))
    return distinct.mapInArrow(pieces, "pre string, uses long, pieces long")


def commonest(known: DataFrame) -> dict[str, int]:
    """The pieces of at most COMMON pre-tokens: all those that occur over so many times that no more do, to a twentieth."""
    step = F.floor(F.log2("uses") * 16).cast("int")
    steps = known.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # under 1,024 rows
    least, total = None, 0
    for r in steps:
        total += r["count"]
        if total > COMMON:
            break
        least = r.step
    return {r.pre: r.pieces for r in known.where(step >= least).select("pre", "pieces").collect()} if least is not None else {}


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, as the SentencePiece model at `path` would give them.

    The table of pre-tokens is written once. Each document's frequencies are joined to it: the commonest pre-tokens (a bounded
    table, sent to all tasks) are summed where the text is read, so only the rarer ones are shuffled to their counts, and then, as
    numbers, to their document. Ids are never made. Null texts count as empty: no bytes, no tokens. Rows that repeat, and null ids,
    each have their own result; texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
    """
    cutter, spark = PreTokens(path), docs.sparkSession
    known = materialise(pieces_of_pre_tokens(docs, cutter), "pre-tokens")
    common = spark.sparkContext.broadcast(commonest(known.where(F.length("pre") <= COMMON_CHARS)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in batches:
            rows, pres, times, tokens, ids, sizes = [], [], [], [], [], []
            for doc_id, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = 0
                for pre, n in cutter.cut(text).items():
                    if (pieces := table.get(pre)) is not None:
                        total += n * pieces
                    else:
                        rows.append(row), pres.append(pre), times.append(n), tokens.append(0), ids.append(None), sizes.append(None)
                rows.append(row), pres.append(None), times.append(0), tokens.append(total), ids.append(doc_id), sizes.append(len(text.encode()))
            columns = [pa.array(rows, pa.int64()), pa.array(pres, pa.string()), *(pa.array(c, pa.int64()) for c in (times, tokens, ids, sizes))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "pre", "times", "tokens", "doc_id", "n_bytes"])

    found = _texts(docs).mapInArrow(frequencies, "row long, pre string, times long, tokens long, doc_id long, n_bytes long")
    # no pre-token is two such characters: rows without one join nothing, and lie scattered
    key = F.coalesce("pre", F.concat(F.lit(2 * cutter.anchor[0]), F.col("row").cast("string")))
    sent = spark.createDataFrame([(k,) for k in common.value], "pre string")
    rare = known.join(F.broadcast(sent), "pre", "left_anti").select(F.col("pre").alias("key"), "pieces")
    tokens = F.sum(F.col("tokens") + F.col("times") * F.coalesce("pieces", F.lit(0)))
    out = found.withColumn("key", key).join(rare, "key", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
