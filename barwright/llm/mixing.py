"""Mixing sources to target weights over a domain-language-source tree, in DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, materialise

NONE = "(none)"
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    default = F.lit(int(known.get("*", 1)))
    named = [F.lit(x) for k, v in known.items() if k != "*" for x in (k, int(v))]
    return (F.coalesce(F.create_map(*named)[F.col(level)], default) if named else default).cast("long")


def _share(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Split each parent's `budget` over its children by weight `w`, none above its `cap`.

    Children are ordered by how soon they fill up (cap / w). One is full if it can't take its share of what the
    fuller ones leave; what it can't take goes to its siblings, by weight. Left-over single tokens go to the
    first children that have room, by name.
    """
    near = Window.partitionBy(*(parents or [F.lit(0)])).orderBy(F.try_divide(F.col("cap"), F.col("w")), level)
    before, after, all_ = near.rowsBetween(Window.unboundedPreceding, -1), near.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*(parents or [F.lit(0)]))
    out = children.where("w > 0").withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("w").over(after))
    out = out.withColumn("full", F.expr("cast(cap as decimal(38,0)) * open <= cast(w as decimal(38,0)) * (budget - taken)"))
    out = out.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0))).withColumn("wide", F.sum(F.when(~F.col("full"), F.col("w"))).over(all_))
    out = out.withColumn("got", F.expr("case when full then cap else cast(cast(w as decimal(38,0)) * left div wide as bigint) end"))
    out = out.withColumn("odd", F.col("left") - F.sum(F.when(~F.col("full"), F.col("got"))).over(all_))
    name = Window.partitionBy(*parents, "full").orderBy(level)
    out = out.withColumn("got", F.col("got") + F.when(~F.col("full") & (F.row_number().over(name) <= F.col("odd")), 1).otherwise(0))
    return out.select(*parents, level, "cap", F.col("got").cast("long").alias("budget"))


def budgets(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], tokens: Column, budget_share: float, max_epochs: int) -> DataFrame:
    """One row per leaf: its path, tokens it has, tokens budgeted."""
    names = list(levels)
    leaves = docs.select(*(c.alias(k) for k, c in levels.items()), tokens.alias("tokens")).groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    return _propagate(leaves, names, weights, budget_share, max_epochs)


def _propagate(leaves: DataFrame, names: list[str], weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int) -> DataFrame:
    """A cap counts only what leaves can give whose whole path has weight, so a shortage below a node reaches its siblings."""
    live = functools.reduce(lambda a, b: a & b, (_weight(level, weights) > 0 for level in names))
    able = F.coalesce(F.sum(F.when(live, F.col("tokens"))), F.lit(0)) * max_epochs
    caps = [leaves.groupBy(*names[: i + 1]).agg(able.alias("cap"), F.sum("tokens").alias("all")) for i in range(len(names))]
    given = None
    for i, level in enumerate(names):
        children = caps[i].withColumn("w", _weight(level, weights))
        if given is None:  # the root's budget, no more than everything below it can give
            all_ = Window.partitionBy(F.lit(0))
            whole = F.floor(F.sum("all").over(all_) * F.lit(budget_share))
            children = children.withColumn("budget", F.least(whole.cast("long"), F.sum("cap").over(all_)))
        else:
            children = children.join(given.drop("cap"), names[:i])
        given = _share(children, names[:i], level)
    return given.join(leaves, names).select(*names, "tokens", "budget")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], tokens: Column | None = None, budget_share: float = 1.0, max_epochs: int = 4, seed: int = 17, cells: int = 3) -> DataFrame:
    """The documents that meet the budgets, with an `epoch` column; a document may come once per epoch.

    `levels` name the tree's levels from the top, as strings of a document; `weights[level][name]` is a whole number
    (0: leave out; "*": all others; default 1). The budget is `budget_share` of all tokens. It goes down the tree
    by weight, never above what a subtree's leaves with weight can give in `max_epochs` passes; a child's shortage goes to its siblings
    and, only if they are all full, to its parent's siblings. A leaf takes whole epochs, then of one more the
    longest prefix, in the order of md5(seed:epoch:doc_id), that fits its budget.

    The order of a leaf is cut into 16^`cells` cells by its hash; only the cell that holds the budget's end is
    sorted, one row per place, so no leaf is gathered in one task, nor rows that repeat an id. Leaf rows are a written table, so Spark knows its size and broadcasts it
    while it is small; the documents are then not shuffled at all.

    Null names are "(none)". Null and empty texts have 0 tokens; a leaf of nothing else has no budget and gives no
    rows. Null doc_ids share one place in the order, as repeated rows do, and are taken together or not at all. An
    empty table gives an empty result. The names epoch and mix_* are taken; input columns of those names are left out.
    """
    keep = [c for c in docs.columns if c != "epoch" and not c.startswith("mix_")]
    docs, names = docs.select(*keep), [f"mix_{k}" for k in levels]
    tokens = word_count() if tokens is None else tokens
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keys = {f"mix_{k}": F.coalesce(c.cast("string"), F.lit(NONE)) for k, c in levels.items()}
    narrow = checkpointed(docs.select(F.col("doc_id"), *(c.alias(k) for k, c in keys.items()), tokens.alias("mix_tokens")))
    leaves = narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"))
    plan = _propagate(leaves, names, {f"mix_{k}": v for k, v in weights.items()}, budget_share, max_epochs)
    plan = plan.withColumn("mix_whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("mix_rest", F.col("budget") - F.col("mix_whole") * F.col("tokens"))
    plan = materialise(plan.select(*names, "mix_whole", "mix_rest").coalesce(1), "mix-plan")
    order = lambda: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mix_whole").cast("string"), id_).cast("binary"))
    rows = narrow.join(plan.where("mix_rest > 0"), names).withColumn("mix_u", order()).withColumn("mix_cell", F.substring("mix_u", 1, cells))
    filled = rows.groupBy(*names, "mix_cell").agg(F.sum("mix_tokens").alias("n"), F.first("mix_rest").alias("mix_rest"))
    filled = filled.withColumn("upto", F.sum("n").over(Window.partitionBy(*names).orderBy("mix_cell")))
    edge = filled.where("upto > mix_rest").groupBy(*names).agg(F.min(F.struct("mix_cell", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select(*names, "e.mix_cell", F.col("e.before").alias("before"))
    inside = rows.join(edge, [*names, "mix_cell"]).groupBy(*names, "mix_u").agg(F.sum("mix_tokens").alias("mix_tokens"), F.first("mix_rest").alias("mix_rest"), F.first("before").alias("before"))
    inside = inside.withColumn("upto", F.sum("mix_tokens").over(Window.partitionBy(*names).orderBy("mix_u")) + F.col("before"))
    inside = inside.where("upto <= mix_rest").groupBy(*names).agg(F.max("mix_u").alias("mix_last"))
    ends = materialise(plan.join(edge.withColumnRenamed("mix_cell", "mix_edge").drop("before"), names, "left").join(inside, names, "left").coalesce(1), "mix-ends")
    out = docs.withColumns(keys).join(ends, names).withColumn("mix_u", order())
    part = (F.col("mix_rest") > 0) & (F.col("mix_edge").isNull() | (F.substring("mix_u", 1, cells) < F.col("mix_edge")) | (F.coalesce(F.col("mix_u") <= F.col("mix_last"), F.lit(False))))
    out = out.withColumn("mix_times", F.col("mix_whole") + part.cast("long")).where("mix_times > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("mix_times") - 1).cast("int")))).select(*keep, "epoch")
