"""The registered text queries: their contract's columns, against DuckDB or brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barwright.llm import queries
from tests.llm.test_links import fingerprint, smallest
from tests.oracle import check, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_statement(spark, name):
    check(spark, connect(SMALL), SMALL, queries.queries()[name], queries.oracle_sql()[name])


def test_sharding_query(spark, texts):
    got = queries.op1_sharding(spark, SMALL).collect()
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    slots = defaultdict(list)
    for r in got:
        text = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize(("name", "folds", "held"), [("op2_quality", 5, 0), ("op3_toxicity", 4, 2)])
def test_classifier_queries(spark, texts, name, folds, held):
    got = queries.queries()[name](spark, SMALL).collect()
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    assert all(r.held_out == (fold(r.doc_id, folds) == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_language_query(spark, texts):
    got = queries.op7_language(spark, SMALL).collect()
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id])) for r in got)


def test_packing_query(spark, texts):
    tokenizer, pieces, places = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for doc_id, rows in pieces.items():
        ids, at = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for k, v in places.items():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at == 2048 or (k == max(places) and at < 2048)


def test_simhash_query(spark, texts):
    marks, ids = {k: fingerprint(t) for k, t in texts.items()}, sorted(texts)
    want = smallest(ids, [(a, b) for a in ids for b in ids if a < b and (marks[a] ^ marks[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, SMALL).collect()}
    assert got == {k: (f"{marks[k]:016x}", want[k]) for k in ids}
