"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbours probed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, flat, forest, join_classes, materialise

BLOCK_ROWS = 512
#: Cells of fewer comparisons are done together, so many at once.
SMALL_CELL, PAIRS = 4096, 1 << 16


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            out.append(np.zeros(8))
            out[-1][[i, j]] = s, t
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_point(y: np.ndarray) -> np.ndarray:
    """The E8 point nearest each row: the nearer of the best in D8 and the best in D8 + (1/2, ..., 1/2)."""

    def even(x: np.ndarray) -> np.ndarray:
        f = np.round(x)
        i, k = np.arange(len(x)), np.abs(x - f).argmax(1)
        f[i, k] += np.where(f.sum(1) % 2 != 0, np.where(x[i, k] >= f[i, k], 1, -1), 0)
        return f

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Cells of unit vectors in several tables. A table projects to blocks of eight dimensions, each decoded on its own."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int):
        r = np.random.default_rng(seed)
        rows = max(8 * blocks, 1)
        self.projections = []
        for _ in range(tables):
            p = r.normal(size=(max(dim, rows), rows))
            self.projections.append(np.linalg.qr(p)[0][:dim] * scale * np.sqrt(max(dim, rows) / 64))
        self.blocks, self.probes, self.near = blocks, probes, shortest_vectors()
        self.mix = r.integers(1, 1 << 63, size=(tables, rows), dtype=np.uint64) | np.uint64(1)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell ids (rows, tables) and ids of the neighbouring cells to probe (rows, tables * probes)."""
        own, around = [], []
        for t, p in enumerate(self.projections):
            y = unit @ p
            points, gain = [], []
            for b in range(self.blocks):
                x = y[:, 8 * b : 8 * b + 8]
                points.append(nearest_point(x))
                gain.append((x - points[-1]) @ self.near.T)
            own.append(self._id(t, np.concatenate(points, 1)))
            best = np.argsort(-np.concatenate(gain, 1), axis=1, kind="stable")[:, : self.probes] if self.probes > 1 else np.concatenate(gain, 1).argmax(1)[:, None]
            for k in range(self.probes):
                at = np.concatenate(points, 1)
                for b in range(self.blocks):
                    here = best[:, k] // 240 == b
                    at[here, 8 * b : 8 * b + 8] += self.near[best[here, k] % 240]
                around.append(self._id(t, at))
        return np.stack(own, 1), np.stack(around, 1) if around else np.zeros((len(unit), 0), np.int64)

    def _id(self, t: int, points: np.ndarray) -> np.ndarray:
        h = ((points * 2).astype(np.int64).view(np.uint64) * self.mix[t]).sum(1, dtype=np.uint64) + np.uint64(t)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, tables: int = 4, blocks: int = 2, scale: float = 2.5, probes: int = 1, cell_rows: int = 4096, seed: int = 23) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector, linked at `cosine` or more in double precision.

    Vectors equal in every component are one class: the class is indexed once and counts as many links as it
    has members. Candidates share a cell in some table, or one's cell is among the other's probed
    neighbours; every candidate is verified, so no link is below `cosine`, and recall against brute force is
    tested to be over 0.98 just above it. A pair found in several cells is counted in one of them, so what comes out is a
    count and a reach per vector and cell, never the pairs. A cell of over `cell_rows` rows is dealt in parts, each pair of
    parts a task's share. A class is sent tables * (1 + probes) times; larger `scale` or more `blocks` make smaller
    cells, for more vectors, and want more tables or probes.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; so do vectors of
    different lengths with each other. Null ids link with nothing and have a null component. Repeated ids are separate
    vectors with that id. An empty table gives no rows; other columns are ignored.
    """
    kind = "double" if dict(vectors.dtypes)["embedding"] == "array<double>" else "float"
    dtype = np.dtype("<f8" if kind == "double" else "<f4")
    e = F.col("embedding").cast(f"array<{kind}>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(~bad, F.lit(False)) & F.col("vec_id").isNotNull(), e).alias("embedding"))
    key = [F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.size("embedding"), F.lit(k))).alias(f"k{k}") for k in (1, 2)]
    rows = rows.select("vec_id", "embedding", *key)
    classes = materialise(rows.where("embedding is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.first("embedding").alias("embedding")), "vector-classes")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                column = part.column(0)
                sizes = np.diff(np.asarray(column.offsets))
                values = np.asarray(column.flatten())
                begin = np.cumsum(sizes) - sizes
                for dim in np.unique(sizes).tolist():
                    chosen = np.flatnonzero(sizes == dim)
                    x = values[begin[chosen][:, None] + np.arange(dim)]
                    if dim not in lattices:
                        lattices[dim] = Lattice(dim, tables, blocks, scale, probes, seed + dim)
                    signature = np.concatenate(lattices[dim].cells(_unit(x.astype(float))), 1)
                    raw, ids = x.astype(dtype), pa.array(chosen)
                    columns = [part.column(1).take(ids), part.column(2).take(ids), _binary(raw), _binary(signature), pa.ListArray.from_arrays(np.arange(len(chosen) + 1, dtype=np.int32) * signature.shape[1], pa.array(signature.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, ["rep", "members", "vector", "signature", "cells"])

    signed = materialise(classes.select("embedding", "rep", "members").mapInArrow(sign, "rep long, members long, vector binary, signature binary, cells array<long>"), "vector-cells")
    spread = signed.select("rep", "members", "vector", "signature", F.posexplode("cells").alias("pos", "cell"))
    hot = signed.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts"))
    hot = materialise(hot, "hot-cells")  # a written table: Spark knows its size and broadcasts it while it is small
    spread = spread.join(hot, "cell", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.xxhash64(F.col("cell"), F.least(j, F.col("part")), F.greatest(j, F.col("part"))).alias("cell"), (j == F.col("part")).alias("alone")))
    spread = spread.withColumn("share", F.explode(F.when(F.col("parts").isNull(), F.array(F.struct("cell", F.lit(True).alias("alone")))).otherwise(pairs)))
    spread = spread.select("share.cell", "share.alone", F.coalesce("part", F.lit(-1)).alias("part"), "pos", "rep", "members", "vector", "signature")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0] == batch.column(0)[-1]:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            cell = rows["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], "left"))
            yield compare(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    def compare(rows: pa.Table) -> pa.RecordBatch:
        """Links of whole cells: per class that has any, the members it links to here and the smallest class it reaches."""
        size = np.diff(flat(rows["vector"].chunk(0))[1])
        parts = [_links(rows.filter(pa.array(size == s)), dtype, cosine, tables, probes) for s in np.unique(size)]
        rep, n, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        classes, which = np.unique(np.concatenate((rep, a, b)), return_inverse=True)
        linked = np.bincount(which[: len(rep)], weights=n, minlength=len(classes)).astype(np.int64)
        reach = forest(len(classes), which[len(rep) : len(rep) + len(a)], which[len(rep) + len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(classes), pa.array(linked), pa.array(classes[reach])], ["rep", "n", "low"])

    found = materialise(spread.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(verify, "rep long, n long, low long"), "vector-links")
    beyond = found.groupBy("rep").agg(F.sum("n").alias("beyond"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    named = classes.select("k1", "k2", "rep", "members").join(beyond, "rep", "left").join(parts, "rep", "left")
    named = materialise(named.select("k1", "k2", "members", (F.col("members") - 1 + F.coalesce("beyond", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")), "vector-groups")
    out = join_classes(rows.select("vec_id", "k1", "k2"), named, ["k1", "k2"], "members")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = x.shape[1] * x.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(x))])


def _links(rows: pa.Table, dtype: np.dtype, cosine: float, tables: int, probes: int) -> tuple[np.ndarray, ...]:
    """(class, members of a class it links to) and (a, b) links, of whole cells of vectors of one length, sorted by cell."""
    rows = rows.combine_chunks()
    cell, rep, pos, part, members = (rows[c].to_numpy() for c in ("cell", "rep", "pos", "part", "members"))
    alone = rows["alone"].to_numpy()
    x = _unit(flat(rows["vector"].chunk(0))[0].view(dtype).reshape(len(rep), -1).astype(float))
    signature = flat(rows["signature"].chunk(0))[0].view("<i8").reshape(len(rep), -1)
    own, around = signature[:, :tables], signature[:, tables:].reshape(len(rep), tables, probes)
    probe, at = pos >= tables, np.where(pos < tables, pos, (pos - tables) // max(1, probes))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def counted_here(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of verified pairs (row, row of an own cell), those whose one place to be counted is this cell.

        That is the first table where they share a cell; else the first where one probes the other's,
        by the smaller of the two if both do. In a cell dealt in parts, rows of one part meet in its own share.
        """
        same = own[u] == own[v]
        shared = np.where(same.any(1), same.argmax(1), tables)
        forth, back = ((around[a] == own[b][:, :, None]).any(2) for a, b in ((u, v), (v, u)))
        either = forth | back
        first = np.where(either.any(1), either.argmax(1), tables)
        i = np.arange(len(u))
        first_forth, first_back = (np.where(first < tables, d[i, np.minimum(first, tables - 1)], False) for d in (forth, back))
        mine = first_forth & (~first_back | (rep[u] < rep[v]))
        return np.where(probe[u], (shared == tables) & (first == at[u]) & mine, shared == at[u])

    def take(u: np.ndarray, v: np.ndarray) -> None:
        keep = counted_here(u, v)
        if keep.any():
            out.append((u[keep], v[keep]))

    begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(begin, len(cell)))
    owners = np.add.reduceat(~probe, begin)
    small = (size * owners <= SMALL_CELL) & (size > 1) & (owners > 0)
    # rows of a cell, its own ones first
    order = np.lexsort((probe, np.repeat(np.arange(len(begin)), size)))
    b, s, o = begin[small], size[small], owners[small]
    count = s * o
    ends = np.cumsum(count)
    first = 0
    while first < len(count):
        done = max(first + 1, int(np.searchsorted(ends, ends[first] - count[first] + PAIRS, "right")))
        c = count[first:done]
        g = np.repeat(np.arange(first, done), c)
        k = np.arange(len(g)) - np.repeat(np.cumsum(c) - c, c)
        u, v = order[b[g] + k // o[g]], order[b[g] + k % o[g]]
        use = np.where(probe[u], rep[u] != rep[v], rep[u] < rep[v]) & (alone[u] | (part[u] != part[v]))
        u, v = u[use], v[use]
        near = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
        take(u[near], v[near])
        first = done
    for g in np.flatnonzero(~small & (size > 1) & (owners > 0)).tolist():
        left, right = order[begin[g] : begin[g] + size[g]], order[begin[g] : begin[g] + owners[g]]
        for i in range(0, len(left), BLOCK_ROWS):
            for j in range(0, len(right), BLOCK_ROWS):
                u, v = np.nonzero(x[left[i : i + BLOCK_ROWS]] @ x[right[j : j + BLOCK_ROWS]].T >= cosine)
                u, v = left[i : i + BLOCK_ROWS][u], right[j : j + BLOCK_ROWS][v]
                use = np.where(probe[u], rep[u] != rep[v], rep[u] < rep[v]) & (alone[u] | (part[u] != part[v]))
                take(u[use], v[use])
    none = np.zeros(0, np.int64)
    u, v = (np.concatenate([none, *(p[i] for p in out)]) for i in (0, 1))
    return np.concatenate((rep[u], rep[v])), np.concatenate((members[v], members[u])), rep[u], rep[v]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
