"""Classifiers on held-out rows, and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barwright.llm.language import code_points, fit_language, follow_the_regularised_leader, identify, softmax, temperature
from barwright.llm.learn import fold, labelled_sample, sample_by_class
from barwright.llm.quality import CLASSES, GRAM_BUCKETS, WORD_BUCKETS, AttentionModel, fit_quality, passages, quality_filter, quality_scores
from barwright.llm.queries import TREE_WEIGHTS, mix_sql
from barwright.llm.rules import Slice
from barwright.llm.toxicity import codes, fit_toxicity, toxicity_scores, windows
from tests.llm.conftest import prose
from tests.llm.test_links import five_words, removed, smallest
from tests.oracle import connect

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def auc(rows):
    s, y = np.array([r.score for r in rows]), np.array([r.y for r in rows])
    order = s.argsort().argsort()
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    model = fit_quality(docs, labels, fold("doc_id", 5) != 0)
    got = quality_scores(docs, model).join(labels.where(fold("doc_id", 5) == 0).select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert auc(got) > 0.95
    right = np.mean([(r.score >= 0.3) == (r.y == 1) for r in got])
    assert right > 0.9
    kept = quality_filter(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality_scores(docs, model).where("score >= 0.3").count()


class Held:
    """Parts of passages, added up here."""

    def __init__(self, parts):
        self.parts = parts

    def total(self, f):
        return sum(f(x, bag) for x, bag in self.parts)


def bags(seed=0):
    r = np.random.default_rng(seed)
    x, bag, y = [], [], []
    for k in range(200):
        n = r.integers(1, 6)
        x.append(r.normal(size=(n, 10)))
        y.append(k % 2)
        if y[-1]:
            x[-1][r.integers(n), :3] += 4
        bag += [k] * n
    return np.concatenate(x).astype(np.float32), np.array(bag), np.array(y, float)


def test_attention_finds_the_bad_passage():
    x, bag, y = bags()
    model = AttentionModel(10, hidden=8, gate=4)
    model.fit(Held([(x, bag)]), y, np.ones(200))
    assert ((model.judge(model.sums(model.scaled(x), bag, 200))[0] > 0.5) == y).mean() > 0.95


def test_texts_in_several_parts_have_the_same_gradient():
    x, bag, y = bags()
    model = AttentionModel(10, hidden=8, gate=4)
    r = np.random.default_rng(2).permutation(len(x))
    parts = [(x[i], bag[i]) for i in np.array_split(r, 7)]
    sums = sum(model.sums(*p, 200) for p in parts)
    assert np.allclose(sums, model.sums(x, bag, 200))
    out, z = model.judge(sums)
    d = (out - y) / 200
    got = [model.gradient(*p, sums[:, 0], z, d) for p in parts]
    loss = lambda: -np.mean(np.log(np.where(y == 1, o := model.judge(model.sums(x.astype(float), bag, 200))[0], 1 - o)))
    for k in ("W", "b", "V", "U", "u"):
        g = sum(p[k] for p in got)
        for at in [np.unravel_index(i, g.shape) for i in (0, g.size // 2, g.size - 1)]:
            old = model.p[k][at]
            model.p[k][at] = old + 1e-5
            up = loss()
            model.p[k][at] = old - 1e-5
            down = loss()
            model.p[k][at] = old
            assert np.isclose(g[at], (up - down) / 2e-5, atol=1e-5), (k, at)


def test_passages_cover_whole_texts():
    s = Slice(pa.array([b"a b " * 100, b"", None, b"one"]))
    x, bag = passages(s)
    assert bag.tolist() == [0, 0, 0, 0, 1, 2, 3] and np.isfinite(x).all()


def test_passages_see_words_and_runs_of_letters():
    a, b = (passages(Slice(pa.array([t])))[0][0] for t in (b"good water runs", b"Runs WATER, good"))
    words, grams = slice(CLASSES, CLASSES + WORD_BUCKETS), slice(CLASSES + WORD_BUCKETS, CLASSES + WORD_BUCKETS + GRAM_BUCKETS)
    assert np.isclose((a[words] ** 2).sum(), 1) and np.isclose((a[grams] ** 2).sum(), 1) and np.isclose((b[words] ** 2).sum(), 1)
    same = passages(Slice(pa.array([b"x " * 70 + b"good water runs", b"good water runs"])))[0]
    assert np.array_equal(same[2], a) and np.count_nonzero(a[words] != b[words]) <= 4 and not np.array_equal(a[grams], b[grams])


def test_toxicity_on_planted_words(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        text, toxic = prose(r, "en", r.randint(30, 200)).split(), i % 3 == 0
        for _ in range(r.randint(2, 4) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(["grumblok", "zwifnug", "plonkerdom"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, truth, fold("doc_id", 4) != 2)
    got = toxicity_scores(docs, model).join(truth.where(fold("doc_id", 4) == 2).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert auc(got) > 0.97 and np.mean([(x.score >= 0.3) == (x.y == 1) for x in got]) > 0.93


def test_windows_cover_all_codes():
    c = codes(b"abc" * 100)
    parts = windows(c)
    assert len(c) == 299 and sum(len(p) for p in parts) >= 2 * len(c) and windows(codes(b"")) == [b""] and len(codes(b"a")) == 0


def test_language_of_held_out_documents(tables, docs):
    every, _ = tables
    model = fit_language(every, fold("doc_id", 4) != 2)
    got = identify(every, model).join(every.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert [odd[k] for k in (1000, 1001, 1002, 1004)] == ["und"] * 4 and odd[1008] != "und"


def test_code_points():
    text = "aé漢😀\n".encode()
    points, ends = code_points(np.frombuffer(text, np.uint8), np.array([0, 3, len(text)]))
    assert points.tolist() == [ord(c) for c in "aé漢😀\n"] and ends.tolist() == [0, 2, 5]


def test_ftrl_is_sparse_and_calibrated():
    r = np.random.default_rng(1)
    rows = [(np.sort(r.choice(50, 8, replace=False)), np.ones(8)) for _ in range(300)]
    y = np.array([int((a < 10).sum() > 1) for a, _ in rows])
    w, b = follow_the_regularised_leader(rows, y, 2, 60, l1=0.5, epochs=5)
    assert (w[50:] == 0).all() and (w == 0).mean() > 0.1
    logits = np.array([x @ w[a] + b for a, x in rows])
    assert (logits.argmax(1) == y).mean() > 0.9 and 0.5 <= temperature(logits, y) <= 20 and np.allclose(softmax(logits).sum(1), 1)


def test_samples_are_bounded(tables):
    docs, _ = tables
    got = sample_by_class(docs, "lang", 20, 1, text="text")
    by = {r.lang: r["count"] for r in got.groupBy("lang").count().collect()}
    assert by.keys() == {r.lang for r in docs.select("lang").where("lang is not null").distinct().collect()} and max(by.values()) == 20
    assert sample_by_class(docs, "lang", 20, 1, max_rows=2 * len(by), text="text").groupBy("lang").count().where("count > 2").count() == 0
    twice = docs.unionByName(docs).unionByName(docs.limit(1).crossJoin(docs.sparkSession.range(500)).drop("id"))
    assert sample_by_class(twice, "lang", 10**6, 1, text="text").count() == docs.where("lang is not null").select("doc_id", "text", "lang").distinct().count()


def test_one_id_with_very_many_texts_is_bounded(spark):
    docs = spark.range(50_000).selectExpr("5 AS doc_id", "concat('text ', id) AS text").unionByName(spark.range(100, 140).selectExpr("id AS doc_id", "concat('other ', id) AS text")).repartition(6)
    labels = spark.range(100, 140).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").unionByName(spark.sql("SELECT 5L AS doc_id, 1 AS quality"))
    got = labelled_sample(docs, labels, "quality", F.lit(True), 30, 1)
    by = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert by[0] == 20 and by[1] == 30
    null = docs.where("doc_id > 5").withColumn("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")))
    assert labelled_sample(null, labels, "quality", F.lit(True), 30, 1).where("doc_id is null").count() == 0


def test_a_long_text_is_learnt_whole(spark, monkeypatch):
    """Its only bad passage is far inside; its passages lie in many parts, and its windows in many groups."""
    monkeypatch.setattr("barwright.llm.quality.TASK_PASSAGES", 200)
    monkeypatch.setattr("barwright.llm.toxicity.GROUP_BYTES", 1 << 16)
    r = random.Random(4)
    rows = [(i, prose(r, "en", 60) + (" zwifnug plonkerdom grumblok" * 3 if i % 2 else "")) for i in range(60)] + [(60, prose(r, "en", 40_000) + " zwifnug plonkerdom grumblok" * 3)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(60, 1, 1)], "doc_id long, quality int, toxic int")
    assert labelled_sample(docs, labels, "quality", F.lit(True), 100, 1).where(F.col("doc_id") == 60).first().text.decode() == rows[60][1]
    model = fit_quality(docs, labels, F.lit(True))
    got = {x.doc_id: x.score for x in quality_scores(docs, model).collect()}
    assert got[60] > 0.5 and np.mean([(got[i] > 0.5) == (i % 2 == 1) for i in range(60)]) > 0.95
    toxic = {x.doc_id: x.score for x in toxicity_scores(docs, fit_toxicity(docs, labels, F.lit(True))).collect()}
    assert toxic[60] > 0.5


def test_held_out_is_never_null(spark):
    from barwright.llm.learn import in_fold

    assert [r[0] for r in spark.sql("SELECT NULL AS doc_id UNION ALL SELECT 3").select(in_fold("doc_id", 4, 2)).collect()] == [False, zlib.crc32(b"3") % 4 == 2]


def test_without_labels_or_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit_quality(odd, labels, F.lit(True)) is None and fit_toxicity(odd, labels, F.lit(True)) is None and fit_language(none, F.lit(True)) is None
    assert quality_scores(odd, None).where("score = 0.5").count() == 6 and quality_filter(odd, None).count() == 6
    assert toxicity_scores(odd, None).count() == 6 and identify(odd, None).where("lang_pred = 'und'").count() == 6
    for f in (quality_scores, toxicity_scores, identify):
        assert f(none, None).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert docs.columns == names and docs.select("doc_id").distinct().count() == docs.count() <= before.count()
    assert docs.count() > 0 and corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == docs.columns


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Each stage against a plain version of it, over all that the stage before it kept."""
    small = "/root/testdata/sf0.001"
    docs, rows = spark.read.parquet(f"{small}/documents.parquet"), {}
    model = fit_quality(docs, spark.read.parquet(f"{small}/labels.parquet"), fold("doc_id", 5) != 0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, small)
        if k == 4:
            break
        out.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = {r.doc_id: r for r in docs.collect()}
        texts = {i: r.text or "" for i, r in before.items()}
        if name == "quality":
            want = {i: t for i, t in texts.items() if model.score(Slice(pa.array([t.encode()])))[0] >= 0.3}
        elif name == "near_duplicates":
            sets, ids = {i: five_words(t) for i, t in texts.items()}, sorted(texts)
            near = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            want = {i: texts[i] for i in set(smallest(ids, near).values())}
        elif name == "repeated_passages":
            want = {i: v[0].decode("utf-8", "ignore") for i, v in removed(list(texts.items()), 100).items()}
            assert all(rows[i].n_chars == len(t) for i, t in want.items())
        else:
            sql = f"SELECT doc_id FROM ({mix_sql(TREE_WEIGHTS, 0.9, 1)})"
            want = {i: texts[i] for (i,) in connect(f"{tmp_path}/repeated_passages", recursive=True).sql(sql).fetchall()}
        assert {i: r.text or "" for i, r in rows.items()} == want and 0 < len(want) <= len(before)
    tokenizer, pieces, places = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == rows.keys()
    for i, found in pieces.items():
        ids, at = np.array([*tokenizer.encode(rows[i].text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc in sorted(found):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    assert all(sum(x[1] for x in v) == 2048 for k, v in places.items() if k < max(places)) and sorted(places) == list(range(len(places)))


def test_pipelines_at_once_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda _: corpus_pipeline.run(spark, "/root/testdata/sf0.001").count(), range(2))
    assert a == b > 0


def test_pipeline_takes_odd_rows(spark, odd):
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, "/root/testdata/sf0.001")
        counts.append(odd.select("doc_id").count())
    assert counts[0] >= counts[1] >= counts[3] and counts[1] == counts[2] and counts[4] >= counts[3] > 0


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
