"""The audit, token counts and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from barwright.llm import audit, counts, queries, runs
from barwright.llm.audit import filter_audit
from barwright.llm.counts import PreTokens, count_tokens, pieces_of_pre_tokens
from barwright.llm.runs import collapse_runs, maximal_runs, periodic_runs, planted, runs_of

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def audited(rows, labels):
    """rows: (doc_id, text, source); labels: id -> (quality, toxic)."""
    facts = []
    for doc_id, text, source in rows:
        t = text or ""
        words = re.findall(WORD, t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows)
        facts.append((source or "", fails, labels.get(doc_id, (0, 0))))
    out = {}
    for part in {f[0] for f in facts}:
        mine, total = [f for f in facts if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                removed = [f for f in left if f[1][k]]
                left = [f for f in left if not f[1][k]]
                total[k] += len(removed)
                redundant = sum(f[1][k] for f in mine) - len(removed)
                alone = sum(f[1][k] and sum(f[1].values()) == 1 for f in mine)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, alone, sum(f[2][0] == 1 for f in removed), sum(f[2][1] == 1 for f in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def told(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost_quality, r.lost_toxic, r.shapley) for r in frame.collect()}


@pytest.mark.parametrize("held", [200, 32 << 20])
def test_audit_matches_brute_force(spark, docs, rows, held, monkeypatch):
    monkeypatch.setattr(audit, "HELD_BYTES", held)
    marks = [(x[0], x[0] % 3 % 2, int(x[0] % 5 == 0)) for x in rows if x[0] % 7] + [(5, 1, 1), (5, None, 0), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    known = {}
    for i, q, t in marks:
        known[i] = tuple(max(a or 0, b) for a, b in zip((q, t), known.get(i, (0, 0)), strict=True))
    assert told(filter_audit(docs, labels)) == audited([(x[0], x[1], x[3]) for x in rows], {k: v for k, v in known.items() if k is not None})


def test_audit_of_null_ids_repeated_rows_and_clashing_fingerprints(spark, odd, none, monkeypatch):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    want = audited([(r.doc_id, r.text, r.source) for r in odd.collect()], {7: (1, 0), 8: (1, 1)})
    assert told(filter_audit(odd, labels)) == want and want["s", "EABCD", 1][1] == 1
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda x: 3)
    chains, seen = {}, []
    for doc_id, text in ((5, b"a"), (4, b"b"), (3, b"a"), (9, b"a"), (4, b"b")):
        seen.append(audit._chain(chains, text, 3, doc_id, Counter({("s", 0): 1})))
    assert [x and x[0] for x in seen] == [None, None, 5, 9, None] and [x[:2] for x in chains[3]] == [[b"a", 3], [b"b", 4]] and chains[3][1][2] == {("s", 0): 2}
    assert filter_audit(none, labels).count() == 0 and filter_audit(odd, labels.limit(0)).count() == 3 * 600


def test_a_hot_text_is_sent_once_a_task(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text", "'s' AS source").repartition(6)
    found = audit.failures(frame).collect()
    assert sum(n for _, _, mask, n in found if mask & 16) == 999 and min(i for i, _, mask, _ in found if mask & 16) == 3


def test_audit_query(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = queries.op11_filter_audit(spark, SMALL)
    assert got.columns[-4:] == ["unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert told(got.withColumnsRenamed({"good_lost": "lost_quality", "toxic_lost": "lost_toxic"})) == audited([(r.doc_id, r.text, r.source) for r in texts], labels)


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab thein▁ \n\t\réß漢😀\x00<s>　'.,-1"), max_size=40))
@example("")
@example("   ")
@example("<s> </s><unk><0x0A>")
def test_pre_tokens_have_the_pieces_of_the_text(text):
    cutter = CUTTER
    assert sum(n * cutter.count(p) for p, n in cutter.cut(text).items()) == len(cutter.model.encode(text))


CUTTER = PreTokens(PIECES)


def test_stretches_cut_nothing(model, monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice(["the ", "  water", "\n", "x" * 50, "▁", "stone,", "é漢"]) for _ in range(3000))
    whole = CUTTER.cut(text)
    monkeypatch.setattr(counts, "STRETCH", 7)
    assert CUTTER.cut(text) == whole and sum(n * CUTTER.count(p) for p, n in whole.items()) == len(model.encode(text))


@pytest.mark.parametrize("common", [0, 40, 1 << 16])
def test_counts_match_the_library(docs, rows, model, common, monkeypatch):
    monkeypatch.setattr(counts, "COMMON", common)
    got = {r.doc_id: r for r in count_tokens(docs, PIECES, limit=500).collect()}
    assert got.keys() == {x[0] for x in rows}
    for doc_id, text, *_ in rows:
        n = len(model.encode(text or ""))
        assert (got[doc_id].n_bytes, got[doc_id].n_tokens, got[doc_id].over_limit) == (len((text or "").encode()), n, n > 500), doc_id


def test_the_commonest_pre_tokens_are_bounded(spark, monkeypatch):
    known = spark.range(1, 2001).selectExpr("cast(id AS string) AS pre", "cast(4000 / id AS long) AS uses", "id AS pieces")
    for most in (0, 1, 40, 700, 5000):
        monkeypatch.setattr(counts, "COMMON", most)
        got = sorted(counts.commonest(known).values())
        assert got == list(range(1, len(got) + 1)) and min(most // 2, 2000) <= len(got) <= most
    assert counts.commonest(known.limit(0)) == {}


def test_each_pre_token_is_counted_once(docs, monkeypatch):
    monkeypatch.setattr(counts, "HELD", 50)
    got = pieces_of_pre_tokens(docs, CUTTER).collect()
    assert len(got) == len({r.pre for r in got}) > 100 and max(r.uses for r in got) > 1


def test_counts_of_odd_and_empty(odd, none, model):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in count_tokens(odd, PIECES).collect())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd.collect())
    assert got == want and count_tokens(none, PIECES).count() == 0


def test_models_that_pieces_cross_are_refused(monkeypatch):
    cutter = PreTokens(PIECES)

    class Crossing:
        vocab_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")
        is_control = is_unknown = is_unused = is_byte = staticmethod(lambda i: False)

    cutter.__dict__["model"] = Crossing()
    with pytest.raises(ValueError, match="space"):
        cutter.joined  # noqa: B018


def test_token_query(spark, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, SMALL).collect()}
    assert got == {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts.items()}


def plain_runs(words):
    """By the definition: every stretch with a period, extended while it holds, kept under its smallest one."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at < n - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(6, 4 * q):
                out.setdefault((at, end + q), q)
            at = end
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sorted_runs(found):
    return [(int(s), int(e - s), int(p)) for s, e, p in found]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=70).map(lambda x: x * 1), max_size=5), st.integers(1, 6))
@example([["a"] * 40, [], ["a", "b"] * 30 + ["b"], list("aab") * 9 + list("ab") * 9, ["a"] * 5, ["a"] * 6], 1)
def test_runs_match_the_definition(texts, times):
    texts = [[w.encode() for w in t] * times for t in texts]
    assert [sorted_runs(r) for r in runs_of(texts)] == [sorted(plain_runs(t), key=lambda x: (x[0], x[2])) for t in texts]


def test_queries_in_parts_find_the_same(monkeypatch):
    x = np.array([i * i % 7 // 3 for i in range(300)] + [0, 1] * 60 + [2] * 50)
    whole = maximal_runs(x, len(x) // 4)
    monkeypatch.setattr(runs, "QUERIES", 3)
    assert np.array_equal(maximal_runs(x, len(x) // 4), whole) and sorted_runs(whole) == sorted(plain_runs(x.tolist()), key=lambda x: (x[0], x[2]))


def judged(doc_id, text, plant):
    words = re.findall(WORD.encode(), (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(words), key=lambda x: (x[0], x[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def row(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def test_run_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: row(r) for r in queries.op13_periodic_runs(spark, SMALL).collect()}
    assert got == {i: judged(i, t, True) for i, t in texts.items()} and sum(v[0] > 0 for v in got.values()) > 10


def test_planted_words_follow_their_rule():
    words = [str(i).encode() for i in range(50)]
    chosen = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert all(planted(i, words) == words for i in range(300) if i not in chosen) and planted(None, words) == words and planted(chosen[0], []) == []
    for i in chosen:
        for n in (1, 2, 3, 7, 50):
            g = zlib.crc32(str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert planted(i, words[:n]) == [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_runs_of_odd_and_empty(spark, docs, rows, odd, none):
    got = {r.doc_id: row(r) for r in periodic_runs(docs).collect()}
    assert got == {x[0]: judged(x[0], x[1], False) for x in rows if x[0] != 1007} | {1007: got[1007]}
    assert periodic_runs(odd).count() == 6 and periodic_runs(none).count() == 0
    assert {r.doc_id: r.text for r in collapse_runs(docs).collect()}[1005] == "ab"
