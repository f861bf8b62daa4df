"""Sharding, packing, mixing and rules against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barwright.llm import packing, sharding
from barwright.llm.mixing import _propagate, mix
from barwright.llm.packing import Schedule, pack
from barwright.llm.queries import TREE_WEIGHTS, mix_sql
from barwright.llm.queries import tree as query_tree
from barwright.llm.rules import quality_rules, rule_order
from barwright.llm.sharding import shard
from tests.oracle import connect

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = r"[^\x20\x09-\x0D]+"
SMALL = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").encode()) + 16


def test_shards_are_even_and_slots_gapless(docs, rows):
    got = shard(docs, shards=4).collect()
    texts = {x[0]: x[1] for x in rows}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r["size"] == size(texts[r.doc_id]) and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_shards_are_near_equal_in_bytes(spark):
    frame = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id % 37 AS int)) || id AS text")
    got = shard(frame, shards=8).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    total = [r.b for r in got]
    assert len(got) == 8 and max(total) <= 1.005 * np.mean(total) and min(total) >= 0.995 * np.mean(total)


def test_a_hot_group_is_split(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a copy of a copy' ELSE 'own ' || id END AS text")
    got = {r.shard: r.b for r in shard(frame, shards=10).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(got) == 10 and max(got.values()) < 1.02 * min(got.values())


def test_equal_texts_of_ordinary_groups_share_a_shard(spark):
    frame = spark.range(4000).selectExpr("id AS doc_id", "'text ' || (id div 2) AS text")
    assert shard(frame, shards=4, parcels_per_shard=64).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


def test_shard_odd_and_empty(odd, none):
    assert shard(odd, 3).count() == 6 and shard(none, 3).count() == 0


def test_no_task_numbers_a_whole_hot_group(spark):
    """One text on 2 % of 40,000 rows and one on a third, most of them without an id."""
    rows = spark.range(40_000).selectExpr("xxhash64(CASE WHEN id % 50 = 0 THEN 'x' WHEN id % 3 = 0 THEN 'y' ELSE 'z' || id END) AS same", "if(id % 7 = 0, id, null) AS doc_id", "100L AS size", "10L AS tokens")
    counts = sharding.parcels(sharding.numbered(rows), 40, 256, 1.0).groupBy("parcel", "cell").count()
    assert counts.agg(F.max("count")).first()[0] < 40 and counts.count() < 5 * 40 * 256


def test_shards_of_many_null_ids_and_copies_are_even(spark):
    frame = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a copy of a copy' ELSE 'own ' || id END AS text")
    got = shard(frame, shards=10).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.count_distinct("slot").alias("k"), F.max("slot").alias("top")).collect()
    assert len(got) == 10 and max(r.b for r in got) < 1.02 * min(r.b for r in got) and all(r.n == r.k == r.top + 1 for r in got)


def test_shards_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    frame = spark.range(4000).selectExpr("if(id % 5 = 0, null, id % 3000) AS doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id % 700)) AS text")
    got = [Counter(map(tuple, shard(frame.repartition(n), shards=4, parcels_per_shard=16).collect())) for n in (3, 7)]
    assert got[0] == got[1] and sum(got[0].values()) == 4000
    assert all(sorted(r[5] for r in got[0] if r[4] == k) == list(range(sum(r[4] == k for r in got[0]))) for k in range(4))


def plainly_placed(vectors, shards):
    even = [sum(v[d] for v in vectors) / shards for d in range(len(vectors[0]))]
    unit = [[x / max(e, 1e-300) for x, e in zip(v, even, strict=True)] for v in vectors]
    left, out = [[1.0] * len(even) for _ in range(shards)], {}
    for i in sorted(range(len(unit)), key=lambda i: (-round(unit[i][0], 12), -max(unit[i]))):
        fits = lambda s, dims: all(left[s][d] - unit[i][d] >= 0 for d in dims)  # noqa: B023, E731
        open_ = [s for s in range(shards) if fits(s, range(len(even)))] or [s for s in range(shards) if fits(s, [0])]
        best = max(open_, key=lambda s: (round(sum(a * b for a, b in zip(left[s], unit[i], strict=True)), 9), -s)) if open_ else max(range(shards), key=lambda s: (left[s][0], -s))  # noqa: B023
        out[i] = best
        left[best] = [a - b for a, b in zip(left[best], unit[i], strict=True)]
    return [out[i] for i in range(len(unit))]


def test_placement_matches_a_plain_one():
    vectors = np.random.default_rng(9).integers(1, 1000, (120, 3)).astype(float)
    assert sharding.place(vectors, 7, 0.0).tolist() == plainly_placed(vectors.tolist(), 7)


def test_place_prefers_room_in_every_dimension():
    where = sharding.place(np.array([[1.0, 9.0], [1.0, 1.0], [1.0, 1.0], [1.0, 9.0]]), 2, 0.0)
    assert where[0] != where[3] and where[1] != where[2]


@pytest.fixture(scope="module")
def packed(docs):
    return pack(docs, PATH, window=256, quantum=32).collect()


def test_every_id_is_in_one_piece(packed, rows):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {x[0]: np.array([*tokenizer.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u4") for x in rows}
    places, by = defaultdict(list), defaultdict(list)
    for r in packed:
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        by[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == ids.keys()
    for pieces, whole in ((by, {k: len(v) for k, v in ids.items()}), (places, None)):
        for k, v in pieces.items():
            at = 0
            for start, length in sorted(v):
                assert start == at
                at += length
            assert at == (whole[k] if whole else 256) or (not whole and k == max(places))


def test_windows_hold_the_target_shares(packed):
    total, each = Counter(), defaultdict(Counter)
    for r in packed:
        total[r.source] += r.length
        each[r.sequence_id][r.source] += r.length
    tokens = sum(total.values())
    for k in range(max(each)):
        for s in total:
            assert abs(each[k][s] - 256 * total[s] / tokens) <= 2 * 32 + 1


def test_schedule_turns_are_a_permutation_and_follow_weights():
    s = Schedule({"a": 1000, "b": 333, "c": 50}, {"a": 1, "b": 1, "c": 2}, 10)
    turns = np.concatenate([s.turn(np.full(q, i), np.arange(q)) for i, q in enumerate(s.quanta)])
    assert sorted(turns) == list(range(s.quanta.sum()))
    assert abs((s.turn(np.zeros(10, int), np.arange(10)) - 4 * np.arange(10)).max()) <= 4
    places = np.concatenate([s.place(np.full(t, i), np.arange(t)) for i, t in enumerate(s.total)])
    assert sorted(places) == list(range(1383))


def test_deficits_are_carried_and_stay_small():
    s = Schedule({"a": 50_000, "b": 20_000, "c": 7000, "d": 300}, None, 10)
    every = np.array([s.deficit(turns) for turns in range(1, 7000, 97)])
    assert np.abs(every.sum(1)).max() < 1e-6 and np.abs(every).max() <= 2


def test_long_words_are_not_remembered():
    coder, tokenizer = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = [f"water {'x' * 500}{i}., stone" for i in range(30)]
    for t in texts * 2:
        assert coder.encode([t.encode()], 1) == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u2").tobytes()]
    assert max(map(len, coder.known)) <= packing.CACHE_BYTES


def test_pack_odd_and_empty(odd, none):
    got = pack(odd, PATH).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count_distinct("doc_tokens").alias("k")).collect()
    assert {r.doc_id for r in got} == {None, 7, 8} and pack(none, PATH).count() == 0


def test_too_many_sources_are_an_error(docs):
    with pytest.raises(ValueError, match="sources"):
        pack(docs, PATH, max_sources=2)


def test_more_sources_than_queues_pack(spark):
    n = packing.QUEUES + 500
    frame = spark.range(3 * n).selectExpr("id AS doc_id", "repeat('water stone ', cast(3 + id % 5 AS int)) AS text", f"'host' || (id % {n}) AS source").repartition(4)
    got = pack(frame, PATH, window=256, quantum=32, weights={"host0": 1.0, f"host{n - 1}": 1.0}).collect()
    docs, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.source == f"host{r.doc_id % n}"
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    assert len(docs) == 3 * n and all(sum(x[1] for x in v) == v[0][2] for v in docs.values())
    assert sorted(places) == list(range(len(places)))
    for k, v in places.items():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at == 256 or k == len(places) - 1


def test_sources_of_shared_queues_keep_their_own_deficits(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 12)
    monkeypatch.setattr(packing, "SHARED", 2)
    monkeypatch.setattr(packing, "FAN", 3)
    frame = spark.range(6000).selectExpr("id AS doc_id", "repeat('water ', cast(3 + id % 40 AS int)) AS text", "'s' || cast(sqrt(id % 1600) AS int) AS source").repartition(5)
    got = pack(frame, PATH, window=256, quantum=16).collect()
    total = Counter()
    for r in got:
        total[r.source] += r.length
    whole, queue = sum(total.values()), Counter()
    assert len(total) == 40 and sorted((r.sequence_id * 256 + r.offset) for r in got)[0] == 0
    for k, r in enumerate(sorted(got, key=lambda r: (r.sequence_id, r.offset))):
        assert r.sequence_id * 256 + r.offset == sum(queue.values())
        queue[r.source] += r.length
        if k % 50 == 0:
            done = sum(queue.values())
            assert all(abs(queue[s] - total[s] * done / whole) <= 2 * 16 * 5 for s in total)
    assert queue == total


def test_coder_remembers_across_generations(monkeypatch, rows):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    coder, tokenizer = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for x in rows[:40] + rows[-10:]:
        assert coder.encode([(x[1] or "").encode()], 1) == [np.array([*tokenizer.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u2").tobytes()]


def tree():
    return {"domain": F.when(F.col("source") == "src3", "big").otherwise("small"), "lang": F.col("lang"), "source": F.col("source")}


def test_mix_meets_weights_where_it_can(docs):
    weights = {"domain": {"big": 1, "small": 1}, "lang": {"*": 1}, "source": {"*": 1}}
    got = mix(docs, tree(), weights, budget_share=0.3, max_epochs=4).withColumns({k: F.coalesce(c, F.lit("-")).alias(k) for k, c in tree().items()})
    by = {r.domain: r.n for r in got.groupBy("domain").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    assert 0.6 < by["big"] / by["small"] < 1.7


def test_mix_shortage_goes_to_siblings_first(spark):
    frame = spark.createDataFrame([(i, "w " * 10, *k) for i, k in enumerate([("a", "x")] * 2 + [("a", "y")] * 100 + [("b", "z")] * 100)], "doc_id long, text string, lang string, source string")
    got = mix(frame, {"lang": F.col("lang"), "source": F.col("source")}, {}, budget_share=0.25, max_epochs=1)
    by = {(r.lang, r.source): r["count"] for r in got.groupBy("lang", "source").count().collect()}
    assert by[("a", "x")] == 2 and by[("a", "y")] in (22, 23) and by[("b", "z")] in (25, 24)


def test_mix_epochs_and_columns(docs):
    got = mix(docs, tree(), {"lang": {"fr": 50}}, budget_share=0.9, max_epochs=2)
    assert "mix_u" not in got.columns and {"shard", "tokens", "epoch"} <= set(got.columns)
    assert got.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    assert got.where("epoch > 1").count() == 0 and got.where("epoch = 1").count() > 0


def test_mix_odd_and_empty(odd, none):
    assert mix(odd, tree(), {}, budget_share=1.0, max_epochs=1).count() == 5 and mix(none, tree(), {}).count() == 0


def test_rules_match_brute_force(docs, rows):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        words = re.findall(WORD, text or "")
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_verdict_is_the_conjunction_of_the_rules(docs, rows):
    letters = lambda t, keep: sum(map(keep, t.encode()))
    upper, lower, space = (lambda b: 65 <= b <= 90), (lambda b: 97 <= b <= 122), (lambda b: b in b" \t\n\r\x0b\x0c")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for doc_id, text, *_ in rows:
        t, r = text or "", got[doc_id]
        words, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
        u, low, high, inked = letters(t, upper), letters(t, lower), letters(t, lambda b: b >= 128), letters(t, lambda b: not space(b))
        rejected = [
            r.n_symbols > 0.1 * len(words), r.n_dup_lines >= 2 and r.n_dup_lines > 0.3 * len(lines), not 2 * len(words) <= r.word_chars <= 15 * len(words),
            u / max(1, u + low) > 0.3, (u + low + high) / max(1, inked) < 0.6, len(set(words)) < 0.1 * min(len(words), 500),
        ]
        assert r.kept == (not r.base_failed and not any(rejected)), doc_id


def test_rules_are_measured_on_what_reaches_them(spark):
    """`echo` rejects most alone, but nothing that `first` leaves; `late` rejects little, but of what is left."""
    frame = spark.range(900).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 60) AS again", "array_join(transform(sequence(1, 60), x -> concat('w', x, 'x', id)), ' ') AS text")
    ids = lambda s, r: np.array([int(s.texts[i].split()[0].split(b"x")[1]) for i in r], int)
    wait = lambda: [sum(range(20_000)) for _ in range(3)]
    rules = {"first": lambda s, r: ids(s, r) % 10 < 8, "echo": lambda s, r: wait() and ids(s, r) % 10 < 8, "late": lambda s, r: wait() and ids(s, r) % 10 == 9}
    assert rule_order(frame, rules) == ["first", "late", "echo"]


def test_rule_order_is_by_rejections_per_cost(docs, odd, none):
    rules = {"slow": lambda s, r: np.array([bool(sum(range(20_000))) for _ in r]), "never": lambda s, r: np.zeros(len(r), bool), "fast": lambda s, r: np.ones(len(r), bool)}
    assert rule_order(docs, rules)[0] == "fast"
    assert quality_rules(docs, rules).where("kept").count() == 0
    assert quality_rules(odd).count() == 6 and quality_rules(none).count() == 0


def planned(leaves, names, weights, share, epochs):
    """Budgets by plain recursion: single tokens by weight, one at a time, to whichever child is furthest behind and has room."""
    weight = lambda i, name: weights.get(names[i], {}).get(name, weights.get(names[i], {}).get("*", 1))
    able = lambda path: epochs * sum(n for k, n in leaves.items() if k[: len(path)] == path and all(weight(i, x) > 0 for i, x in enumerate(k)))
    out = {}

    def give(path, budget):
        if len(path) == len(names):
            out[path] = budget
            return
        room = {k[: len(path) + 1]: able(k[: len(path) + 1]) for k in leaves if k[: len(path)] == path and weight(len(path), k[len(path)]) > 0}
        got, left, open_ = dict.fromkeys(room, 0), budget, set(room)
        while open_:
            wide = sum(weight(len(path), c[-1]) for c in open_)
            full = {c for c in open_ if room[c] * wide <= weight(len(path), c[-1]) * left}
            if not full:
                for c in open_:
                    got[c] = weight(len(path), c[-1]) * left // wide
                for c in sorted(open_)[: left - sum(got[c] for c in open_)]:
                    got[c] += 1
                break
            c = min(full, key=lambda c: (room[c] / weight(len(path), c[-1]), c))
            got[c] = room[c]
            left -= room[c]
            open_.remove(c)
        for c, n in got.items():
            give(c, n)

    give((), min(int(sum(leaves.values()) * share), able(())))
    return out


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("cde"), st.sampled_from("fgh")), st.integers(1, 500), min_size=1, max_size=12), st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 4), max_size=6), st.sampled_from([0.3, 0.8, 1.5]))
@example({("a", "c", "f"): 10, ("a", "c", "g"): 100, ("a", "d", "f"): 100}, {"g": 0}, 0.5)
def test_budgets_match_plain_recursion(spark, leaves, weight, share):
    names = ["x", "y", "z"]
    weights = {n: {k: w for k, w in weight.items() if k in ks} for n, ks in zip(names, ("ab", "cde", "fgh"), strict=True)}
    frame = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "x string, y string, z string, tokens long")
    got = {(r.x, r.y, r.z): r.budget for r in _propagate(frame, names, weights, share, 2).collect()}
    want = planned(leaves, names, weights, share, 2)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_mix_passes_the_shortage_of_weightless_leaves_on(spark):
    frame = spark.createDataFrame([(i, "w " * 10, *k) for i, k in enumerate([("a", "x")] * 10 + [("a", "y")] * 100 + [("b", "z")] * 100)], "doc_id long, text string, lang string, source string")
    got = mix(frame, {"lang": F.col("lang"), "source": F.col("source")}, {"source": {"y": 0}}, budget_share=0.5, max_epochs=1)
    assert {(r.lang, r.source): r["count"] for r in got.groupBy("lang", "source").count().collect()} == {("a", "x"): 10, ("b", "z"): 95}


@pytest.mark.parametrize("weights", [TREE_WEIGHTS, {"domain": {"d0": 3, "d1": 0}, "lang": {"en": 0, "*": 2}, "source": {"src1": 0, "src5": 7}}])
def test_mix_matches_its_statement(spark, weights):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mix(docs, query_tree(), weights, budget_share=0.8, max_epochs=3).select("doc_id", "epoch")
    want = connect(SMALL).sql(f"SELECT doc_id, epoch FROM ({mix_sql(weights, 0.8, 3)})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_mix_of_many_null_ids(spark):
    frame = spark.range(2000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "'a b c' AS text", "'en' AS lang", "'s' AS source")
    got = mix(frame, {"lang": F.col("lang")}, {}, budget_share=0.5, max_epochs=1)
    assert got.where("doc_id is null").count() in (0, 667) and got.count() <= 1000
