"""Trees against plain learners that look at every row, node, feature and cut in loops."""

import math

import numpy as np
import pytest

from barwright.operators import trees as T
from barwright.operators.trees import Block, Boosting, Forest, Tree, Trees, blocks, first_level, quantile_edges, to_bins, uniform

NAMES = ["a", "b", "c", "d", "e"]


def table(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5)).round(2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=n) * 0.5) > 0.2).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = table()
    return spark.createDataFrame([(f"s{i % 7}", i, int(y[i]), *map(float, x[i])) for i in range(len(x))], "symbol string, bar_ts long, swing_label int, a double, b double, c double, d double, e double").repartition(5).persist()


def collected(data):
    held = data.collect()
    return Block(*(np.concatenate([getattr(b, k) for b in held]) for k in ("bins", "label", "key", "margin")))


def plain_boost(b, m, features):
    """(trees as {node: (feature, cut) or value}, margins), by the definition."""
    margin, out = b.margin.astype(float).copy(), []
    for number in range(m.rounds):
        use = uniform(b.key, m.seed, number) < m.row_share
        columns = T.drawn(features, int(m.feature_share * features), m.seed, number, 1)
        p = 1 / (1 + np.exp(-margin))
        w = np.where(b.label == 1, m.positive_weight, 1.0)
        g, h, tree = (p - b.label) * w, np.maximum(p * (1 - p), 1e-16) * w, {}

        def split(node, mine, depth, g=g, h=h, tree=tree, columns=columns):
            sg, sh = g[mine].sum(), h[mine].sum()
            best = (1e-6, None, None)
            for f in columns if depth < m.depth else []:
                for cut in range(int(b.bins[:, f].max()) + 1):
                    left = mine & (b.bins[:, f] <= cut)
                    lg, lh = g[left].sum(), h[left].sum()
                    if lh >= m.least_hessian and sh - lh >= m.least_hessian:
                        gain = lg**2 / (lh + m.l2) + (sg - lg) ** 2 / (sh - lh + m.l2) - sg**2 / (sh + m.l2)
                        if gain > best[0] + 1e-9:
                            best = gain, f, cut
            if best[1] is None:
                tree[node] = -sg / (sh + m.l2) * m.rate
                return
            tree[node] = int(best[1]), best[2]
            split(2 * node + 1, mine & (b.bins[:, best[1]] <= best[2]), depth + 1)
            split(2 * node + 2, mine & (b.bins[:, best[1]] > best[2]), depth + 1)

        split(0, use, 0)
        for i in range(len(margin)):
            node = 0
            while isinstance(tree[node], tuple):
                f, cut = tree[node]
                node = 2 * node + 1 + int(b.bins[i, f] > cut)
            margin[i] += tree[node]
        out.append(tree)
    return out, margin


def shape(tree: Tree):
    reached, out = [0], {}
    for node in reached:
        if tree.feature[node] >= 0:
            out[node] = int(tree.feature[node]), int(tree.cut[node])
            reached += [2 * node + 1, 2 * node + 2]
        else:
            out[node] = float(tree.value[node])
    return out


def same(a, b):
    return a.keys() == b.keys() and all(a[k] == b[k] if isinstance(b[k], tuple) else isinstance(a[k], float) and math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) for k in b)


@pytest.mark.parametrize("parts", [1, 3])
def test_boosting_equals_a_plain_booster(rows, parts, monkeypatch):
    monkeypatch.setattr(T, "REFRESH", 2)
    m = Boosting(rounds=5, depth=3, rate=0.3, least_hessian=2.0)
    edges = quantile_edges(rows, NAMES, bins=12)
    data = blocks(rows, NAMES, edges, parts, margin=0.3)
    assert data.getNumPartitions() == parts
    grown, (want, margin) = m.fit(data, 5), plain_boost(b := collected(data), m, 5)
    assert len(grown) == 5 and all(same(shape(t), w) for t, w in zip(grown, want, strict=True)) and sum(len(w) for w in want) > 20
    model, x = Trees.of(grown, edges), np.array(rows.select(*NAMES).collect())
    keys = {int(k): v for k, v in zip(b.key, margin, strict=True)}
    order = [r[0] for r in rows.selectExpr("xxhash64(symbol, bar_ts)").collect()]
    assert np.allclose(0.3 + model.total(x), [keys[int(np.int64(k).view(np.uint64))] for k in order])
    data.unpersist()


def plain_tree(b, m, number, features):
    n = m.weights(b, number)
    y = b.label == 1
    total = [n[~y].sum(), n[y].sum()]
    w = [sum(total) / (2 * t) for t in total]
    weight, tree = n * np.where(y, w[1], w[0]), {}
    gini = lambda rows: 2 * weight[rows & y].sum() * weight[rows & ~y].sum() / max(weight[rows].sum(), 1e-300)

    def split(node, mine, depth):
        best = (1e-12, None, None)
        if depth < m.depth and mine.sum() >= m.least_split:
            for f in m.columns(number, node, features):
                for cut in range(int(b.bins[:, f].max()) + 1):
                    left = mine & (b.bins[:, f] <= cut)
                    if left.sum() >= m.least_leaf and mine.sum() - left.sum() >= m.least_leaf:
                        fall = gini(mine) - gini(left) - gini(mine & ~left)
                        if fall > best[0] + 1e-9:
                            best = fall, f, cut
        if best[1] is None:
            tree[node] = weight[mine & y].sum() / weight[mine].sum()
            return
        tree[node] = int(best[1]), best[2]
        split(2 * node + 1, mine & (b.bins[:, best[1]] <= best[2]), depth + 1)
        split(2 * node + 2, mine & (b.bins[:, best[1]] > best[2]), depth + 1)

    split(0, n > 0, 0)
    return tree


@pytest.mark.parametrize("parts", [1, 3])
def test_forest_equals_plain_trees(rows, parts, monkeypatch):
    monkeypatch.setattr(T, "NODES_A_JOB", 7)
    m = Forest(trees=5, depth=5)
    data = blocks(rows, NAMES, quantile_edges(rows, NAMES, bins=12), parts)
    grown, b = m.fit(data, 5), collected(data)
    want = [plain_tree(b, m, k, 5) for k in range(5)]
    assert len(grown) == 5 and all(same(shape(t), w) for t, w in zip(grown, want, strict=True)) and sum(len(w) for w in want) > 50
    data.unpersist()


def test_draws():
    key = np.arange(200_000, dtype=np.uint64)
    n = Forest().weights(Block(None, None, key, None), 3)
    assert abs(n.mean() - 1) < 0.02 and abs((n == 0).mean() - math.exp(-1)) < 0.01 and abs(uniform(key, 1).mean() - 0.5) < 0.01
    assert not np.array_equal(uniform(key, 1), uniform(key, 2)) and len(T.drawn(108, 86, 1)) == 86 and len(set(T.drawn(108, 10, 4).tolist())) == 10


def test_bins_and_missing_values(rows):
    edges = [np.array([1.0, 2.0]), np.array([])]
    assert to_bins(np.array([[1.0, 5.0], [1.5, 5.0], [9.0, np.nan], [np.nan, 1.0]]), edges).tolist() == [[0, 0], [1, 0], [2, 0], [0, 0]]
    model = Trees(1, 2, [[[0, 0, 1.0, 0.0, 1.0], [1, -1, 0.0, -1.0, 0.0], [2, -1, 0.0, 1.0, 0.0]]])
    assert model.total(np.array([[1.0, 0.0], [1.1, 0.0], [np.nan, 0.0]])).tolist() == [-1.0, 1.0, -1.0] and model.total(np.zeros((0, 2))).tolist() == []
    assert model.importance("total").tolist() == model.importance("mean").tolist() == [1.0, 0.0] and Trees(1, 2, []).importance("total").tolist() == [0.0, 0.0]
    with pytest.raises(ValueError, match="bins"):
        blocks(rows, ["a"], [np.arange(300.0)], 1)


def test_first_level_is_where_trees_begin(rows):
    m = Boosting(rounds=1, depth=1, row_share=1.0, feature_share=1.0)
    edges = quantile_edges(rows, NAMES, bins=16)
    level = first_level(rows, NAMES, edges, m).collect()
    n = {r.swing_label: r["count"] for r in rows.groupBy("swing_label").count().collect()}
    data = blocks(rows, NAMES, edges, 1, margin=m.base_margin(n[0], n[1]))
    tree = m.fit(data, 5)[0]
    best = max((r for r in level if r.gain is not None), key=lambda r: r.gain)
    assert (NAMES.index(best.feature), best.bin) == (tree.feature[0], tree.cut[0]) and best.gain == pytest.approx(tree.gain[0])
    assert sum(r.n_rows for r in level) == 5 * rows.count() and abs(sum(r.gradient for r in level)) < 1e-6 * rows.count()


def test_models_learn(rows):
    edges = quantile_edges(rows, NAMES)
    data = blocks(rows, NAMES, edges, 1)
    x, y = np.array(rows.select(*NAMES).collect()), np.array([r[0] for r in rows.select("swing_label").collect()])
    boosted, wood = Trees.of(Boosting(rounds=40).fit(data, 5), edges), Trees.of(Forest(trees=30).fit(data, 5), edges)
    assert ((boosted.total(x) > 0) == y).mean() > 0.9 and ((wood.total(x) / 30 > 0.5) == y).mean() > 0.8
    assert np.argmax(wood.importance("total")) == 0 and np.isclose(boosted.importance("mean").sum(), 1)
