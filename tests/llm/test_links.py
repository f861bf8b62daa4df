"""Near-duplicates and repeated passages against brute force."""

import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barwright.llm import suffixes
from barwright.llm.common import components, drop_materialised, forest, join_classes, materialise, tables_of_run
from barwright.llm.embeddings import Lattice, near_vectors, nearest_point, shortest_vectors
from barwright.llm.simhash import gray_order_links, gray_rank, one_of_each_group, simhash_groups, similar_links
from barwright.llm.shingles import one_of_each_similar
from barwright.llm.suffixes import remove_repeats
from corpus_pipeline import near_duplicates


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(ids, pairs):
    at = {x: i for i, x in enumerate(ids)}
    label = forest(len(ids), np.array([at[a] for a, _ in pairs], int), np.array([at[b] for _, b in pairs], int))
    return {x: ids[label[i]] for i, x in enumerate(ids)}


def test_simhash_groups_match_brute_force(docs, rows):
    ids = sorted(x[0] for x in rows)
    marks = {x[0]: fingerprint(x[1]) for x in rows}
    want = smallest(ids, [(a, b) for a in ids for b in ids if a < b and (marks[a] ^ marks[b]).bit_count() <= 3])
    got = {r.doc_id: r for r in simhash_groups(docs).collect()}
    assert {k: r.fp & (1 << 64) - 1 for k, r in got.items()} == marks
    assert {k: r.component_id for k, r in got.items()} == want
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("cell_limit", [20_000, 5])
def test_index_finds_every_near_pattern(spark, cell_limit):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ sum(np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64) for _ in range(k)) for k in (1, 2, 3, 4, 5))]))
    rows = list(zip(range(len(fps)), fps.view(np.int64).tolist(), strict=True))
    links = similar_links(spark.createDataFrame(rows, "rep long, fp long"), cell_limit=cell_limit).collect()
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert np.array_equal(forest(len(fps), a, b), forest(len(fps), np.array([x.a for x in links]), np.array([x.b for x in links])))


def test_gray_order_links_of_one_dense_cell():
    fp = np.unique(np.random.default_rng(2).integers(0, 1 << 12, 700).astype(np.uint64) << np.uint64(20))
    fp = fp[np.argsort(gray_rank(fp))]
    i, j = gray_order_links(np.zeros(len(fp), np.int64), fp, 1)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 1)
    label = np.arange(len(fp))
    label[i] = j
    assert np.array_equal(label, forest(len(fp), a, b))


def test_memory_of_the_index_does_not_grow_with_pairs():
    """Of a wide distance few pairs of nodes go early; the children of all of them at once took over 500 MB."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 1800, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base[:400] ^ sum(np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64) for _ in range(k)) for k in (3, 7, 10))]))
    cell = np.repeat([3, 9], [len(fp) - 200, 200])
    fp = np.concatenate([x[np.argsort(gray_rank(x))] for x in np.split(r.permutation(fp), [len(fp) - 200])])
    tracemalloc.start()
    try:
        i, j = gray_order_links(cell, fp, 7)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    a, b = np.nonzero((np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 7) & (cell[:, None] == cell[None, :]))
    label = np.arange(len(fp))
    label[i] = j
    assert np.array_equal(label, forest(len(fp), a, b)) and len(i) > 500 and peak < 50e6


def test_gray_rank_steps_change_one_bit():
    g = np.arange(1000, dtype=np.uint64) ^ (np.arange(1000, dtype=np.uint64) >> np.uint64(1))
    assert np.array_equal(gray_rank(g), np.arange(1000))


def test_materialised_tables_can_be_dropped(spark):
    drop_materialised(spark)
    a = materialise(spark.range(3), "a")
    assert a.count() == 3 and drop_materialised(spark) == 1 and drop_materialised(spark) == 0
    a, b = materialise(spark.range(3), "a"), materialise(spark.range(5), "b")
    assert drop_materialised(spark, keep=1) == 1 and b.count() == 5
    with tables_of_run():
        c = materialise(spark.range(7), "c")
        assert drop_materialised(spark, keep=1) == 0
        with tables_of_run():
            materialise(spark.range(2), "d")
            assert drop_materialised(spark) == 1
    assert b.count() == 5 and c.count() == 7 and drop_materialised(spark) == 2 and a is not b


def test_components_of_long_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 299), (299, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(40)) and got[300] == 299
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def five_words(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_drops_texts_of_similar_shingles(spark, docs, rows):
    r, more = np.random.default_rng(8), []
    for i in range(150):  # a changed word costs five shingles of some 240 to 260
        words = [f"w{x}" for x in r.integers(0, 1 << 20, 250)]
        for j in range(2):
            more.append((2000 + 2 * i + j, " ".join(words), "en", "src0"))
            for at in r.choice(250, 1 + i % 9, replace=False):
                words[at] = f"x{at}"
    more += [(3000 + i, " ".join(f"chain{k}" for k in range(10 * i, 10 * i + 200)), "en", "src0") for i in range(12)]
    every = [*rows, *more]
    sets = {x[0]: five_words(x[1]) for x in every}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum(sets[a] != sets[b] for a, b in near) > 60
    frame = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    got = near_duplicates(spark, frame, "")
    assert got.columns == frame.columns and sorted(x.doc_id for x in got.collect()) == sorted(set(smallest(ids, near).values()))


def test_large_components_are_compared_by_pairs_of_parts(spark):
    """A chain in which only neighbours are similar, so no link may be lost between parts."""
    rows = [(i, " ".join(f"chain{k}" for k in range(10 * i, 10 * i + 200))) for i in range(60)] + [(100 + i, f"own {i} text " * 9) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 25, 5000):
        assert sorted(r.doc_id for r in one_of_each_similar(frame, part_bytes=size).collect()) == [0, 100, 101, 102, 103, 104]


def test_similar_shingles_odd_and_empty(spark, odd, none):
    got = sorted(str(x.doc_id) for x in near_duplicates(spark, odd, "").collect())
    assert got == ["7", "7", "7", "None", "None"] and near_duplicates(spark, none, "").count() == 0


def test_simhash_odd_and_empty(odd, none):
    got = [(r.doc_id, r.component_id) for r in simhash_groups(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (None, None), (7, 7), (7, 7), (7, 7), (8, 7)], key=str)
    assert simhash_groups(none).count() == 0 and one_of_each_group(odd).count() == 5


def removed(rows, length):
    """By definition, over (doc_id, text) in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted((x[0], (x[1] or "").encode()) for x in rows):
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - length + 1):
            piece = text[s : s + length]
            gone[s : s + length] |= piece in seen
            seen.add(piece)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc_id] = (bytes(np.frombuffer(text, np.uint8)[~gone]), int(gone.sum()), runs)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_removal_matches_the_definition(docs, rows, hot, monkeypatch):
    if hot:  # tasks see the module's own limits, so every path is taken by passing the kinds through
        original = suffixes.match
        monkeypatch.setattr(suffixes, "match", lambda rows: original(rows).withColumn("kind", F.when(F.col("kind") == suffixes.OPEN, suffixes.HOT).otherwise(F.col("kind")).cast("byte")))
    for length in (100, 64) if not hot else (100,):
        want = removed(rows, length)
        got = {r.doc_id: r for r in remove_repeats(docs, length, carry=["lang", "shard"]).collect()}
        assert got.keys() == want.keys()
        for k, (kept, n, runs) in want.items():
            assert bytes(got[k].kept) == kept and len(got[k].spans) == runs and sum(s.end - s.start for s in got[k].spans) == n
        assert {r.shard for r in got.values()} == {"x"}


def test_removal_of_a_very_common_line(spark):
    line = "this very line of over a hundred bytes stands in each of the documents, whatever else there may be in it, twice"
    rows = [(i, f"{i * 7919} own start {i} {line} own end {i * i} {line}") for i in range(400)]
    want = removed(rows, 100)
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {k: v[0] for k, v in want.items()}


def test_family_keeps_first_places_and_geometric_levels():
    r = np.random.default_rng(3)
    family, seen, lost = suffixes.Family(), {}, 0
    for _ in range(40):
        text, run, doc, packed = (r.integers(0, n, 50) for n in (30, 12, 1000, 1 << 40))
        key = np.array([b"%032d" % t + int(g).to_bytes(8, "big") for t, g in zip(text, run, strict=True)], f"S{suffixes.KEY}")
        lost += len(family.add(key, doc, packed)[0])
        for x in zip(key.tolist(), doc, packed, strict=True):
            seen[x[0]] = min(seen.get(x[0], x[1:]), x[1:])
    sizes = [len(x[0]) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    key, doc, packed = family.whole()
    assert dict(zip(key.tolist(), zip(doc, packed, strict=True), strict=True)) == seen and lost == 2000 - len(seen) and key.tolist() == sorted(seen)


def test_suffix_arrays_are_in_byte_order_with_common_prefixes(docs):
    rows = suffixes.suffixes(suffixes._keyed(docs.coalesce(1), 0), 100).where("kind < 2 or kind = 3").select("key").collect()
    keys = [bytes(r.key) for r in rows]
    assert all(len(k) == suffixes.KEY for k in keys) and sum(a > b for a, b in zip(keys, keys[1:], strict=False)) <= len(keys) // 2000 + 2
    some = np.sort(np.array(keys[:500], f"S{suffixes.KEY}"))
    padded = [x.ljust(suffixes.KEY, b"\0") for x in some.tolist()]
    want = [next((i for i in range(suffixes.KEY) if a[i] != b[i]), suffixes.KEY) for a, b in zip(padded, padded[1:], strict=False)]
    assert suffixes.common(some).tolist() == [0, *want]


@pytest.mark.parametrize("hot", [False, True])
def test_levels_in_a_folder_take_batch_after_batch(spark, rows, tmp_path, hot, monkeypatch):
    line = "this very line of over a hundred bytes stands in each of the documents, whatever else there may be in it, twice"
    every = [(x[0], x[1]) for x in rows[:110]] + [(2000 + i, f"{i * 7919} own start {i} {line} own end {i * i} {line}") for i in range(150 if hot else 4)]
    np.random.default_rng(2).shuffle(every)
    batches = [every[i::5] for i in range(5)]
    index, got, sizes = suffixes.SuffixLevels(spark, str(tmp_path / "family")), {}, []
    for batch in batches:
        found = index.add(spark.createDataFrame([(int(i), t) for i, t in batch], "doc_id long, text string").coalesce(1)).collect()
        got |= {r.doc_id: (bytes(r.kept), len(r.spans)) for r in found}
        sizes.append([spark.read.parquet(p).count() for *_, p in index.levels()])
    order = [x for batch in batches for x in sorted(batch)]
    want = removed([(k, t) for k, (_, t) in enumerate(order)], 100)
    assert got == {int(i): (want[k][0], want[k][2]) for k, (i, _) in enumerate(order)}
    assert all(a >= 2 * b for s in sizes for a, b in zip(s, s[1:], strict=False)) and index.levels()[0][0] == 0 and index.levels()[-1][1] == 4


def test_removal_odd_and_empty(odd, none):
    got = [(r.doc_id, len(r.text), len(r.kept)) for r in remove_repeats(odd, whole_characters=True).collect()]
    texts = {0: (None, "one two three " * 20), 1: (7, "same text " * 30), 2: (7, "other words here " * 30), 3: (8, "same text " * 30)}
    want = {k: len(v[0]) for k, v in removed([(k, t) for k, (_, t) in texts.items()], 100).items()}
    each = [(i, len(t), want[k]) for k, (i, t) in texts.items()]
    assert sorted(got, key=str) == sorted([*each, each[1], (None, 0, 0)], key=str) and remove_repeats(none).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_removal_of_repeated_rows_is_that_of_distinct_ones(spark, parts):
    line = "this passage of over a hundred bytes stands in some of the documents, whatever else there may be in them, once"
    rows = [(1, f"own start {line} own end"), (2, "quite another text " * 12), (3, f"more {line} of it, " + "with other words than the rest " * 6), (4, f"open {line[:105]} end of it")]
    want = removed(rows, 100)
    got = remove_repeats(spark.createDataFrame(rows * 3 + rows[:1], "doc_id long, text string").repartition(parts)).collect()
    assert len(got) == 13 and all((r.doc_id, bytes(r.kept)) == (r.doc_id, want[r.doc_id][0]) for r in got)
    assert want[1][0] == rows[0][1].encode() and len(want[4][0]) < 100


def test_removal_tells_many_texts_under_one_id_apart(spark):
    """Of 3,000 texts, about 17 pairs agree in 18 bits of a digest."""
    r = np.random.default_rng(6)
    rows = [(None, " ".join(map(str, r.integers(0, 1 << 30, 12 if i % 3 else 40)))) for i in range(3000)]
    line = " ".join(map(str, r.integers(0, 1 << 30, 20)))
    rows += [(None, f"{i} {line} {i * i}") for i in range(300)] + [(5, f"alone {line}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {bytes(x.text).decode(): bytes(x.kept).decode() for x in remove_repeats(frame).collect()}
    assert all(got[t] == t for _, t in rows[:3000])
    assert sum(line in got[t] for _, t in rows[3000:3300]) == 1 and len(got[rows[-1][1]]) < 20


def test_the_smallest_id_is_not_a_null_one(spark):
    frame = spark.createDataFrame([(-(2**63), "one " * 60), (None, "two words " * 30), (3, "x")], "doc_id long, text string")
    assert {r.doc_id: r.text[:3] for r in remove_repeats(frame, 100).collect()} == {-(2**63): b"one", None: b"two", 3: b"x"}


def test_whole_characters_drops_cut_ones(spark):
    text = "ü" * 100
    got = remove_repeats(spark.createDataFrame([(1, "x" + text), (2, "ÿ" + text)], "doc_id long, text string"), whole_characters=True).collect()
    for r in got:
        bytes(r.kept).decode()


def vectors(seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(300, 64))
    near = [x[i] + 0.2 * np.sqrt(64) / np.sqrt(64) * r.normal(size=64) for i in range(0, 150)]
    return np.concatenate([x, near, x[:40], x[:5] * 3]).astype(np.float32)


def test_near_vectors_match_brute_force(spark):
    x = vectors()
    frame = spark.createDataFrame([(i, v.tolist(), "q") for i, v in enumerate(x)], "vec_id long, embedding array<float>, cell string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero((u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool))
    for cell_rows in (4096, 8):
        got = {r.vec_id: r for r in near_vectors(frame, cell_rows=cell_rows).collect()}
        want = np.bincount(a, minlength=len(x))
        found = np.array([got[i].n_links for i in range(len(x))])
        assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
        if found.sum() == want.sum():
            assert [got[i].component_id for i in range(len(x))] == forest(len(x), a, b).tolist()
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_recall_just_above_the_threshold(spark, dim):
    r = np.random.default_rng(dim)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(600, dim)), r.normal(size=(600, dim))))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = np.linspace(0.9501, 0.96, 600)[:, None]
    x = np.concatenate((a, c * a + np.sqrt(1 - c * c) * b))
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)).sum(1)
    found = np.array([n for _, n in sorted((r.vec_id, r.n_links) for r in got)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_a_hot_class_meets_in_no_task(spark):
    rows, classes = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 7 > 0 THEN id END AS k"), spark.sql("SELECT -1L AS k, 10000L AS n, 'hot' AS name UNION ALL SELECT id, 1, 'own' FROM range(0, 30000, 2)")
    got = join_classes(rows, classes, ["k"], "n")
    assert got.count() == 30_000 and got.where("name = 'hot'").count() == 10_000 and got.where("k % 2 = 0 AND name IS NULL").count() == 0 and got.where("k IS NULL AND name IS NULL").count() > 0
    far = rows.join(F.broadcast(classes.where("n * 1000 > 25000").select("k")), "k", "left_anti")
    assert far.where("k = -1").count() == 0


def test_near_vectors_that_link_with_nothing(spark):
    good = [1.0] * 64
    rows = [(1, good), (2, None), (3, [0.0] * 64), (4, [float("nan"), *good[1:]]), (5, [float("inf"), *good[1:]]), (6, [None, *good[1:]]), (7, []), (8, good[:32]), (9, good), (None, good), (9, [2.0] * 64)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 2, 1), (None, 0, None)}
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lattice_points_are_nearest():
    y = np.random.default_rng(5).normal(size=(500, 8)) * 2
    p, v = nearest_point(y), shortest_vectors()
    assert len(v) == 240 and np.allclose((v**2).sum(1), 2)
    whole = np.isclose(p, np.round(p)).all(1)
    half = np.isclose(p - 0.5, np.round(p - 0.5)).all(1)
    assert (whole | half).all() and np.allclose(p.sum(1) % 2, 0)
    assert (((y - p) ** 2).sum(1)[:, None] <= ((y[:, None] - p[:, None] - v[None]) ** 2).sum(2) + 1e-9).all()
    own, around = Lattice(64, 3, 2, 4.0, 2, 0).cells(np.eye(64))
    assert own.shape == (64, 3) and around.shape == (64, 6)


def test_near_duplicates_are_found_by_the_gray_order_index(spark, monkeypatch):
    """Without any band that meets, near copies are found all the same; sets of other words stay apart."""
    from barwright.llm import shingles

    words = [f"w{i}" for i in range(400)]
    copies = [[*words[:k], "other", *words[k + 1 :]] for k in (0, 200, 399)]
    texts = [" ".join(t) for t in (words, *copies, [f"x{i}" for i in range(400)])]
    monkeypatch.setattr(shingles, "_meetings", lambda nodes, parts: nodes.sparkSession.createDataFrame([], "a long, b long"))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicates(spark, frame, "").collect()) == [0, 4]
