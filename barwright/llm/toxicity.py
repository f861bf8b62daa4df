"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, compared on windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, flat, slices, text_bytes
from .learn import labelled_sample

GRAM = 4
WINDOW, STEP = 64, 48
#: Bytes and segment of the ordinary and the toxic dictionary; bytes of text whose windows train one; gains that may count.
SIZES, GROUP_BYTES, THRESHOLDS = ((1 << 15, 64), (1 << 11, 16)), 8 << 20, range(2, 20)
FOLD = np.where(WHITESPACE, 0x20, np.arange(256)).astype(np.uint32)
FOLD[ord("A") : ord("Z") + 1] += 32


def codes(text: bytes) -> np.ndarray:
    """A 16-bit code for each run of four bytes, lower-cased: strings in which a match is at least five letters long.

    zstandard matches three bytes or more, which in plain text is any syllable. Written in codes, a shared
    run must be two codes, five letters, to be found, and every letter not found costs two bytes.
    """
    a = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    if len(a) < GRAM:
        return np.zeros(0, "<u2")
    return ((a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24) * np.uint32(2654435761) >> np.uint32(16)).astype("<u2")


def windows(coded: np.ndarray) -> list[bytes]:
    raw = coded.tobytes()
    return [raw[2 * i : 2 * (i + WINDOW)] for i in range(0, max(1, len(coded) - WINDOW + STEP), STEP)]


def _train(size: int, samples: list[bytes], k: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=8, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to choose from: all of them
        return b"".join(samples)[-size:]


class CompressionModel:
    """Two dictionaries and the thresholds on how much shorter the toxic one makes a window.

    They are trained apart. The toxic side compresses with both, so that what it saves is what only the toxic dictionary has:
    with the toxic one alone, the ordinary words around a toxic one cost more than it saves.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, ordinary + toxic
        self.threshold, self.weights = 4, np.array([-6.0, 1.0, 0.0, 0.0])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "coders"}

    def _coders(self) -> list[zstandard.ZstdCompressor]:
        if "coders" not in self.__dict__:
            set_ = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self.coders = []
            for content in (self.ordinary, self.toxic):
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(compression_params=set_)
                self.coders.append(zstandard.ZstdCompressor(dict_data=words, compression_params=set_))
        return self.coders

    def gains(self, text: bytes) -> np.ndarray:
        """By how many bytes the toxic dictionary shortens each window of the text beyond the ordinary one."""
        plain, toxic = self._coders()
        return np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(codes(text))])

    def inputs(self, gains: np.ndarray) -> np.ndarray:
        return np.array([1.0, gains.max(), np.log1p((gains >= self.threshold).sum()), np.log1p(len(gains))])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ self.inputs(self.gains(text)), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    w, hold = np.zeros(x.shape[1]), ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + hold @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + hold + 1e-6 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -5, 5)
    return w


def _code_frequencies(texts: DataFrame) -> np.ndarray:
    """(2, codes): in how many texts of each label every code is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << 16), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[y, np.unique(codes(text.as_py()))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], ["at", "n"])

    out = np.zeros(2 << 16)
    for r in texts.select("text", "label").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out.reshape(2, -1)


def _dictionaries(texts: DataFrame, odds: np.ndarray) -> list[bytes]:
    """Dictionaries of ordinary windows and of over-represented toxic runs, of all texts of the frame.

    Windows are dealt into groups of some 20 MB, whatever text they are of, and each trains a dictionary. One group's is the
    result; those of several are trained on once more, cut into windows.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, held = max(1, -(-total // GROUP_BYTES)), texts.sparkSession.sparkContext.broadcast(odds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coded = codes(text)
                if y:
                    hit = np.flatnonzero(held.value[coded] > 3)
                    runs = [coded[max(0, g[0] - 1) : g[-1] + 2].tobytes() for g in np.split(hit, np.flatnonzero(np.diff(hit) > 2) + 1)] if len(hit) else []
                    parts = [t for t in runs if len(t) >= 8]
                else:
                    parts = windows(coded)
                for k in range(0, len(parts), 512):
                    some = parts[k : k + 512]
                    yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([(mark + k) % groups], pa.int64()), pa.array([mark]), pa.array([k]), pa.array([some], pa.list_(pa.binary()))], ["label", "group", "mark", "at", "parts"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mark", "ascending"), ("at", "ascending")])
        y, samples = table["label"][0].as_py(), [p for row in table["parts"].to_pylist() for p in row]
        return pa.table({"label": pa.array([y], pa.int32()), "group": pa.array([table["group"][0].as_py()]), "content": pa.array([_train(SIZES[y][0], samples, SIZES[y][1])], pa.binary())})

    dealt = texts.select("mark", "text", "label").mapInArrow(cut, "label int, group long, mark long, at long, parts array<binary>")
    found = dealt.groupBy("label", "group").applyInArrow(lambda t: learn(t), "label int, group long, content binary").orderBy("label", "group").collect()
    out = []
    for y, (size, k) in enumerate(((s, k) for s, k in SIZES)):
        own = [bytes(r.content) for r in found if r.label == y]
        out.append(own[0] if len(own) == 1 else _train(size, [c[i : i + 2 * WINDOW] for c in own for i in range(0, len(c), 2 * WINDOW)], k))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", per_class: int = 900, seed: int = 11) -> CompressionModel | None:
    """Fit on at most `per_class` labelled texts of each class, whole; None without both classes.

    Two thirds of the sample train the dictionaries. The ordinary one is trained on windows of ordinary
    texts; the toxic one goes on from it, trained on the runs of toxic texts whose codes are over-represented there.
    On the other third the window threshold and the weights of a text's largest gain, number of windows
    over the threshold and number of windows are calibrated, classes weighted to their shares among the labels. Texts stay in tasks:
    the driver gets counts, dictionaries and a few numbers a text. Null ids aren't learnt from; texts that share an id each are.
    """
    rows = labels.where("doc_id is not null").where(learnable)
    share = {r[0]: r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}
    sample = labelled_sample(docs, labels, label, learnable, per_class, seed).where("label in (0, 1)").withColumn("mark", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    marks = sorted((r.label, r.mark) for r in sample.select("label", "mark").collect())
    n = np.bincount([y for y, _ in marks], minlength=2)
    if not n.all():
        return None
    back = {m for y in (0, 1) for m in [m for c, m in marks if c == y][2::3]}
    sample = sample.withColumn("back", F.col("mark").isin(back) if back else F.lit(False))
    train = sample.where(~F.col("back"))
    n = np.array([sum(c == y and m not in back for c, m in marks) for y in (0, 1)])
    seen = _code_frequencies(train)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen[1] < max(3, 0.01 * n[1])] = 0
    model = CompressionModel(*_dictionaries(train, odds))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.gains(t) for t in batch.column(0).to_pylist()]
            over = [[int((g >= t).sum()) for t in THRESHOLDS] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([float(g.max()) for g in got]), pa.array([len(g) for g in got]), pa.array(over, pa.list_(pa.int64()))], ["label", "mark", "top", "n", "over"])

    found = sample.where("back").select("text", "label", "mark").mapInArrow(gains, "label int, mark long, top double, n long, over array<long>").orderBy("mark").collect()
    if not found:
        return model
    truth = np.array([r.label for r in found])
    weight = np.array([share.get(c, 1) / max(1, (truth == c).sum()) for c in (0, 1)])[truth]
    weight = weight / weight.mean()
    top = np.array([r.top for r in found])
    best = int(np.argmin([(weight * ((top >= t) != truth)).sum() for t in THRESHOLDS]))
    model.threshold = THRESHOLDS[best]
    model.weights = _logistic(np.array([[1.0, r.top, np.log1p(r.over[best]), np.log1p(r.n)] for r in found]), truth, weight)
    return model


def toxicity_scores(docs: DataFrame, model: CompressionModel | None) -> DataFrame:
    """(doc_id, score): the calibrated probability that a whole text is toxic, from all of its windows.

    Null and empty texts have one empty window; without a model every score is 0. Repeated rows and null
    doc_ids are scored like any row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            score = [model.score(raw[a:b]) if model else 0.0 for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, score double")
