"""Histogram tree learners: second-order boosting, and a forest of balanced bootstraps.

Rows become small bins once. A tree is grown level by level from sums per (node, feature, bin), which tasks make of their
rows and Spark adds up; only such sums, whose size follows from the model and not from the data, reach the driver. Draws of rows
and features are hashes, so a lost task makes the same ones again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256
#: Up to so many rows are one task's: all levels, rounds or trees then need no exchange.
ROWS_A_TASK = 20_000
#: Margins are brought up to date every so many rounds; nodes of a forest whose sums one job makes.
REFRESH, NODES_A_JOB = 10, 512
SALT, FIRST, SECOND = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Cumulative probabilities of 0, 1, 2, ... draws of a row in a bootstrap, in the limit of many rows.
POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.maximum(1, np.arange(12.0))))


def uniform(key: np.ndarray, *salts: int) -> np.ndarray:
    """A number in [0, 1) for each 64-bit key, another for other salts."""
    x = np.asarray(key, np.uint64)
    for s in salts:
        x = x + np.uint64(SALT * (s + 1) % (1 << 64))
        x = (x ^ x >> np.uint64(30)) * FIRST
        x = (x ^ x >> np.uint64(27)) * SECOND
        x = x ^ x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def drawn(features: int, count: int, *salts: int) -> np.ndarray:
    """`count` of the features, in order."""
    return np.sort(np.argsort(uniform(np.arange(features, dtype=np.uint64), *salts), kind="stable")[: max(1, count)])


@dataclass
class Block:
    """Some rows: bins (rows, features), label 0 or 1, a key for draws, and the margin boosted so far."""

    bins: np.ndarray
    label: np.ndarray
    key: np.ndarray
    margin: np.ndarray


@dataclass
class Tree:
    """Nodes in heap order, children of i at 2i + 1 and 2i + 2; feature -1 is a leaf. Bins up to `cut` go left."""

    depth: int
    feature: np.ndarray = field(default=None)
    cut: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)
    gain: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.feature is None:
            n = (2 << self.depth) - 1
            self.feature, self.cut, self.value, self.gain = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            if not (inner := f >= 0).any():
                break
            at = np.where(inner, 2 * at + 1 + (bins[row, np.maximum(f, 0)] > self.cut[at]), at)
        return at


def quantile_edges(rows: DataFrame, names: list[str], bins: int = BINS, accuracy: int = 10_000) -> list[np.ndarray]:
    """Up to bins - 1 edges of every feature, from mergeable quantile sketches in one aggregation; a bin is what is over one edge and up to the next."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))  # one column for all features: a list would be sent to the driver's JVM number by number for each
    got = rows.agg(*(F.percentile_approx(c, shares, accuracy).alias(f"q{k}") for k, c in enumerate(names)), *(F.max(c).alias(f"m{k}") for k, c in enumerate(names))).first()
    out = []
    for k in range(len(names)):
        edges = np.unique(np.array(got[f"q{k}"] or [], float))
        out.append(edges[edges < (got[f"m{k}"] if got[f"m{k}"] is not None else np.inf)])
    return out


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of raw values, columns as in `edges`; missing values are in bin 0."""
    out = np.zeros(values.shape, np.uint8)
    for k, e in enumerate(edges):
        known = ~np.isnan(values[:, k])
        out[known, k] = np.searchsorted(e, values[known, k], "left")
    return out


def blocks(rows: DataFrame, names: list[str], edges: list[np.ndarray], parts: int, label: str = "swing_label", margin: float = 0.0) -> RDD:
    """An RDD of binned blocks, in `parts` partitions, kept in memory or on disk."""
    if max(len(e) for e in edges) > BINS - 1:
        raise ValueError(f"more than {BINS} bins")
    key = F.xxhash64("symbol", "bar_ts")
    flat = rows.select(key.alias("key"), F.col(label).cast("int").alias("label"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[2:]], 1)
            cells = [[to_bins(values, edges).tobytes()], [b.column(1).to_numpy(zero_copy_only=False).astype(np.int8).tobytes()], [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["bins", "label", "key"])

    def unpack(r: tuple) -> Block:
        label = np.frombuffer(bytes(r[1]), np.int8)
        return Block(np.frombuffer(bytes(r[0]), np.uint8).reshape(len(label), len(names)), label, np.frombuffer(bytes(r[2]), np.uint64), np.full(len(label), margin))

    packed = flat.coalesce(parts).mapInArrow(pack, "bins binary, label binary, key binary")
    return packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(slot: np.ndarray, cells: np.ndarray, slots: int, bins: int, *values: np.ndarray) -> np.ndarray:
    """(slots, features, bins, values): sums of each value over the rows of a slot and bin of each feature."""
    width = cells.shape[1]
    code = ((slot[:, None] * width + np.arange(width)) * bins + cells).ravel()
    return np.stack([np.bincount(code, np.repeat(v, width), slots * width * bins) for v in values], -1).reshape(slots, width, bins, len(values))


# Boosting


@dataclass(frozen=True)
class Boosting:
    """Settings: rounds, depth, step, shares of rows and features drawn for a tree, least hessian of a child, L2, weight of positives."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    least_hessian: float = 3.0
    l2: float = 1.0
    positive_weight: float = 2.0
    bins: int = BINS
    seed: int = 42

    def base_margin(self, negatives: int, positives: int) -> float:
        """The log odds of the weighted labels, where the first round starts."""
        a, b = float(negatives), self.positive_weight * positives
        return float(np.log(b / a)) if a and b else 0.0

    def gradients(self, b: Block, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(drawn rows, gradient, hessian) of the logistic loss for one tree."""
        at = np.flatnonzero(uniform(b.key, self.seed, number) < self.row_share)
        p = 1 / (1 + np.exp(-b.margin[at]))
        y, w = b.label[at].astype(float), np.where(b.label[at] == 1, self.positive_weight, 1.0)
        return at, (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w

    def histograms(self, b: Block, number: int, tree: Tree, nodes: list[int], columns: np.ndarray) -> np.ndarray:
        """Gradient and hessian sums of the asked nodes: (nodes, columns, bins, 2)."""
        at, g, h = self.gradients(b, number)
        slot_of = np.full(len(tree.feature), -1, np.int64)
        slot_of[nodes] = np.arange(len(nodes))
        slot = slot_of[tree.nodes(b.bins[at])]
        use = slot >= 0
        return _sums(slot[use], b.bins[at[use]][:, columns], len(nodes), self.bins, g[use], h[use])

    def gains(self, left: np.ndarray) -> np.ndarray:
        """The gain of a cut after each bin, from sums up to it; -inf where a child's hessian is too small."""
        total = left[:, :, -1:, :]
        right = total - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.l2)
        gain = score(left) + score(right) - score(total)
        return np.where((left[..., 1] >= self.least_hessian) & (right[..., 1] >= self.least_hessian), gain, -np.inf)

    def best(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gain, column, cut, left sums) of each node; ties go to the first column, then the lowest cut."""
        left = sums.cumsum(2)
        flat = self.gains(left).reshape(len(sums), -1)
        best = flat.argmax(1)
        column, cut = best // sums.shape[2], best % sums.shape[2]
        return flat[np.arange(len(sums)), best], column, cut, left[np.arange(len(sums)), column, cut]

    def grow(self, histograms: Callable[[Tree, list[int], np.ndarray], np.ndarray], number: int, features: int) -> Tree:
        """One tree. Of two siblings the lighter one's sums are asked for; the other's are what is left of their parent's."""
        tree, columns = Tree(self.depth), drawn(features, int(self.feature_share * features), self.seed, number, 1)
        open_, sums = [0], histograms(tree, [0], columns)
        total = sums[:, 0].sum(1)
        tree.value[0] = -total[0, 0] / (total[0, 1] + self.l2) * self.rate
        for depth in range(self.depth):
            gain, column, cut, left = self.best(sums)
            total = sums[:, 0].sum(1)
            asked, parents = [], []
            for k, node in enumerate(open_):
                if not gain[k] > 1e-6:
                    continue
                tree.feature[node], tree.cut[node], tree.gain[node] = columns[column[k]], cut[k], gain[k]
                pair = left[k], total[k] - left[k]
                for side, (g, h) in enumerate(pair):
                    tree.value[2 * node + 1 + side] = -g / (h + self.l2) * self.rate
                able = [h >= 2 * self.least_hessian for _, h in pair]
                if any(able):
                    light = int(pair[1][1] < pair[0][1])
                    asked.append(2 * node + 1 + light)
                    parents.append((k, able[light], able[1 - light]))
            if depth == self.depth - 1 or not asked:
                break
            lighter = histograms(tree, asked, columns)
            open_, kept = [], []
            for node, own, (k, mine, other) in zip(asked, lighter, parents, strict=True):
                sibling = node + 1 if node % 2 else node - 1
                if mine:
                    open_.append(node), kept.append(own)
                if other:
                    open_.append(sibling), kept.append(sums[k] - own)
            sums = np.stack(kept)
        return tree

    def fit(self, data: RDD, features: int) -> list[Tree]:
        """All rounds. Data of one partition is boosted in one task; otherwise every level is a job whose sums are added up in a tree of tasks."""
        if data.getNumPartitions() == 1:

            def alone(held: Iterator[Block]) -> Iterator[list[Tree]]:
                held, out = [replace(b, margin=b.margin.copy()) for b in held], []
                for number in range(self.rounds):
                    out.append(self.grow(lambda tree, nodes, columns, k=number: sum(self.histograms(b, k, tree, nodes, columns) for b in held), number, features))
                    for b in held:
                        b.margin += out[-1].value[out[-1].nodes(b.bins)]
                yield out

            return data.mapPartitions(alone).first()
        trees, since = [], []
        for number in range(self.rounds):
            added = list(since)

            def job(tree: Tree, nodes: list[int], columns: np.ndarray, data: RDD = data, added: list[Tree] = added, k: int = number) -> np.ndarray:
                def part(held: Iterator[Block]) -> Iterator[np.ndarray]:
                    yield sum((self.histograms(_advanced(b, added), k, tree, nodes, columns) for b in held), np.zeros((len(nodes), len(columns), self.bins, 2)))

                return data.mapPartitions(part).treeReduce(np.add)

            since.append(self.grow(job, number, features))
            trees.append(since[-1])
            if len(since) == REFRESH:
                data, old, since, added = data.map(lambda b, added=since: _advanced(b, added)).persist(StorageLevel.MEMORY_AND_DISK), data, [], []
                data.foreach(lambda b: None)
                if number >= REFRESH:
                    old.unpersist()
        if self.rounds >= REFRESH:
            data.unpersist()
        return trees


def _advanced(b: Block, trees: list[Tree]) -> Block:
    margin = b.margin.copy()
    for t in trees:
        margin += t.value[t.nodes(b.bins)]
    return replace(b, margin=margin)


# Forest


@dataclass(frozen=True)
class Forest:
    """Settings: trees, depth, least rows of a node that splits and of a leaf; roots of the features are drawn for a node."""

    trees: int = 250
    depth: int = 10
    least_split: int = 20
    least_leaf: int = 8
    bins: int = BINS
    seed: int = 42

    def weights(self, b: Block, tree: int) -> np.ndarray:
        """How often each row is in the tree's bootstrap."""
        return np.searchsorted(POISSON, uniform(b.key, self.seed, tree, 2), "right")

    def columns(self, tree: int, node: int, features: int) -> np.ndarray:
        return drawn(features, int(features**0.5), self.seed, tree, node, 3)

    def counts(self, b: Block, trees: dict[int, Tree], nodes: list[tuple[int, int]], features: int) -> np.ndarray:
        """(nodes, drawn features, bins, 3): rows, and draws of labels 0 and 1, of the asked (tree, node) pairs."""
        out, at = [], 0
        while at < len(nodes):
            number = nodes[at][0]
            mine = [n for t, n in nodes[at : at + (2 << self.depth)] if t == number]
            at += len(mine)
            n = self.weights(b, number)
            slot_of = np.full(len(trees[number].feature), -1, np.int64)
            slot_of[mine] = np.arange(len(mine))
            use = np.flatnonzero(n)
            slot = slot_of[trees[number].nodes(b.bins[use])]
            use, slot = use[slot >= 0], slot[slot >= 0]
            columns = np.stack([self.columns(number, node, features) for node in mine])
            cells, n, y = b.bins[use[:, None], columns[slot]], n[use].astype(float), b.label[use] == 1
            out.append(_sums(slot, cells, len(mine), self.bins, np.ones(len(use)), np.where(y, 0.0, n), np.where(y, n, 0.0)))
        return np.concatenate(out).astype(np.int64)

    def grow(self, counts: Callable[[dict[int, Tree], list[tuple[int, int]]], np.ndarray], numbers: range, features: int) -> list[Tree]:
        """Trees of the given numbers, level by level together. Classes weigh the same in every tree's own bootstrap."""
        trees, weight, whole = {t: Tree(self.depth) for t in numbers}, {}, {}
        open_ = [(t, 0) for t in numbers]
        for depth in range(self.depth + 1):
            following = []
            for at in range(0, len(open_), NODES_A_JOB):
                asked = open_[at : at + NODES_A_JOB]
                sums = counts(trees, asked)
                totals = sums[:, 0].sum(1)
                if not depth:
                    for (t, _), (_, *m) in zip(asked, totals.tolist(), strict=True):
                        weight[t] = [sum(m) / (2 * x) if x else 0.0 for x in m]
                        whole[t] = sum(x * w for x, w in zip(m, weight[t], strict=True))
                w = np.array([weight[t] for t, _ in asked])
                own = totals[:, 1:] * w
                share = own[:, 1] / np.maximum(own.sum(1), 1e-300)
                gain, column, cut = self.best(sums, w)
                for k, (t, node) in enumerate(asked):
                    tree = trees[t]
                    tree.value[node] = share[k]
                    if depth == self.depth or totals[k, 0] < self.least_split or not gain[k] > 1e-12:
                        continue
                    tree.feature[node], tree.cut[node] = self.columns(t, node, features)[column[k]], cut[k]
                    tree.gain[node] = gain[k] / whole[t]
                    following += [(t, 2 * node + 1), (t, 2 * node + 2)]
            open_ = following
        return [trees[t] for t in numbers]

    def falls(self, left: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The fall in weighted Gini impurity of a cut after each bin, from counts up to it; -inf where a child has too few rows."""
        right = left[:, :, -1:, :] - left

        def impurity(s: np.ndarray) -> np.ndarray:
            a, b = s[..., 1] * w[:, 0, None, None], s[..., 2] * w[:, 1, None, None]
            return 2 * a * b / np.maximum(a + b, 1e-300)

        fall = impurity(left[:, :, -1:, :]) - impurity(left) - impurity(right)
        return np.where((left[..., 0] >= self.least_leaf) & (right[..., 0] >= self.least_leaf), fall, -np.inf)

    def best(self, sums: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fall, column, cut) of each node; ties as in boosting."""
        flat = self.falls(sums.cumsum(2), w).reshape(len(sums), -1)
        best = flat.argmax(1)
        return flat[np.arange(len(sums)), best], best // sums.shape[2], best % sums.shape[2]

    def fit(self, data: RDD, features: int) -> list[Tree]:
        """All trees. Data of one partition, which is small, is sent to tasks that grow some trees each; otherwise every level of all trees is some jobs."""
        if data.getNumPartitions() == 1:
            context = data.context
            held = context.broadcast(data.collect())
            cuts = min(self.trees, 4 * context.defaultParallelism)

            def some(k: int) -> list[Tree]:
                numbers = range(self.trees * k // cuts, self.trees * (k + 1) // cuts)
                return self.grow(lambda trees, nodes: sum(self.counts(b, trees, nodes, features) for b in held.value), numbers, features)

            return [t for part in context.parallelize(range(cuts), cuts).map(some).collect() for t in part] if cuts else []

        def job(trees: dict[int, Tree], nodes: list[tuple[int, int]]) -> np.ndarray:
            asked = {t: trees[t] for t, _ in nodes}

            def part(held: Iterator[Block]) -> Iterator[np.ndarray]:
                yield sum((self.counts(b, asked, nodes, features) for b in held), np.zeros((len(nodes), max(1, int(features**0.5)), self.bins, 3), np.int64))

            return data.mapPartitions(part).treeReduce(np.add)

        return self.grow(job, range(self.trees), features)


# Use


def first_level(rows: DataFrame, names: list[str], edges: list[np.ndarray], boosting: Boosting | None = None, forest: Forest | None = None) -> DataFrame:
    """(feature, bin, n_rows, gradient, hessian, gain, fall): what the first split of both models is chosen from, over all rows.

    Nothing is drawn: every row counts once, of every feature. gain and fall are those of a cut after the bin, null where one may not
    be; bins without rows are left out.
    """
    boosting, forest = boosting or Boosting(row_share=1.0), forest or Forest()
    n = {r[0]: r[1] for r in rows.groupBy("swing_label").count().collect()}
    data = blocks(rows, names, edges, max(1, -(-sum(n.values()) // ROWS_A_TASK)), margin=boosting.base_margin(n.get(0, 0), n.get(1, 0)))

    def part(held: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((1, len(names), BINS, 5))
        for b in held:
            _, g, h = boosting.gradients(b, 0)
            total += _sums(np.zeros(len(b.label), np.int64), b.bins, 1, BINS, np.ones(len(g)), b.label == 0, b.label == 1, g, h)
        yield total

    try:
        sums = data.mapPartitions(part).treeReduce(np.add)
    finally:
        data.unpersist()
    left = sums.cumsum(2)
    weight = np.array([[sum(n.values()) / (2 * n[c]) if n.get(c) else 0.0 for c in (0, 1)]])
    gain, fall = boosting.gains(left[..., 3:])[0], forest.falls(left[..., :3], weight)[0]
    real = lambda x: float(x) if np.isfinite(x) else None
    out = [(name, b, int(sums[0, k, b, 0]), float(sums[0, k, b, 3]), float(sums[0, k, b, 4]), real(gain[k, b]), real(fall[k, b])) for k, name in enumerate(names) for b in range(len(edges[k]) + 1) if sums[0, k, b, 0]]
    return rows.sparkSession.createDataFrame(out, "feature string, bin int, n_rows long, gradient double, hessian double, gain double, fall double")


class Trees:
    """Grown trees with cuts as values, for raw features: missing values go left."""

    def __init__(self, depth: int, features: int, nodes: list[list[list]]):
        """`nodes`: for each tree its (node, feature, cut, value, gain)."""
        self.depth, self.features, self.nodes, size = depth, features, nodes, (2 << depth) - 1
        self.feature, self.cut, self.value = np.full((len(nodes), size), -1, np.int32), np.zeros((len(nodes), size)), np.zeros((len(nodes), size))
        for t, rows in enumerate(nodes):
            for node, feature, cut, value, _ in rows:
                self.feature[t, node], self.cut[t, node], self.value[t, node] = feature, cut, value

    @classmethod
    def of(cls, grown: list[Tree], edges: list[np.ndarray]) -> Trees:
        depth = grown[0].depth if grown else 0
        nodes = []
        for tree in grown:
            reached, rows = [0], []
            for node in reached:
                f = int(tree.feature[node])
                cut = float(edges[f][tree.cut[node]]) if f >= 0 and tree.cut[node] < len(edges[f]) else 0.0
                rows.append([node, f, cut, float(tree.value[node]), float(tree.gain[node])])
                reached += [2 * node + 1, 2 * node + 2] if f >= 0 else []
            nodes.append(rows)
        return cls(depth, len(edges), nodes)

    def leaves(self, x: np.ndarray, rows: int = 1024) -> Iterator[np.ndarray]:
        """(rows, trees) leaf values of some rows at a time."""
        tree = np.arange(len(self.nodes))
        for a in range(0, len(x), rows):
            part = x[a : a + rows]
            at, row = np.zeros((len(part), len(tree)), np.int64), np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[tree, at]
                at = np.where(f >= 0, 2 * at + 1 + (part[row, np.maximum(f, 0)] > self.cut[tree, at]), at)
            yield self.value[tree, at]

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([v.sum(1) for v in self.leaves(x)]) if len(x) else np.zeros(0)

    def importance(self, kind: str) -> np.ndarray:
        """Shares of the features: "total", each tree's falls in impurity made a share, then their mean; or "mean", the mean gain of a split."""
        out = np.zeros((len(self.nodes), self.features, 2))
        for t, rows in enumerate(self.nodes):
            for _, f, _, _, gain in rows:
                if f >= 0:
                    out[t, f] += gain, 1
        if kind == "total":
            each = out[..., 0]
            sums = each.sum(1, keepdims=True)
            got = (each / np.where(sums > 0, sums, 1)).mean(0) if len(each) else np.zeros(self.features)
        else:
            both = out.sum(0)
            got = both[:, 0] / np.maximum(1, both[:, 1])
        return got / got.sum() if got.sum() > 0 else got
