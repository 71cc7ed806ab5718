"""Consensus trees: splits are counted by Spark, compatible ones chosen greedily for each group of trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.newick import Node, render, splits
from strandweave.plans.durable import durable

METHODS = ("mre", "mr", "ml", "strict")


def censored(weight: Column, trees: Column, method: str = "mre", fraction: float = 0.5) -> Column:
    """Whether a split's support lets it in: mr above half, ml above `fraction`, strict all, mre any."""
    match method:
        case "mr":
            return weight * 2 > trees
        case "ml":
            return weight > trees * fraction
        case "strict":
            return weight == trees
        case "mre":
            return F.lit(True)
    raise ValueError(f"one of {METHODS}")


def compatible(a: frozenset[str] | set[str], b: frozenset[str] | set[str], everyone: int | None = None) -> bool:
    """Disjoint, one within the other, or (unrooted, of `everyone` tips) together all tips."""
    return a.isdisjoint(b) or a <= b or b <= a or (everyone is not None and len(a | b) == everyone)


def compatible_masks(a: Column, b: Column, full: Column | None = None) -> Column:
    """compatible() for splits as BIGINT bitmaps."""
    both = a.bitwiseAND(b)
    ok = (both == 0) | (both == a) | (both == b)
    return ok if full is None else ok | (a.bitwiseOR(b) == full)


def split_support(trees: DataFrame, group: str) -> DataFrame:
    """(group, split, weight, n_trees, length) of trees (group, newick): weights added up, lengths averaged, trivial splits left out."""
    s = splits(trees, group, trivial=False)
    return s.groupBy(group, "split").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_trees"), F.avg("length").alias("length"))


def compatible_splits(a: Column, b: Column, tips: Column) -> Column:
    """compatible() of splits as arrays of tips, of `tips` tips in all; of rooted trees with a null number of tips."""
    both = F.size(F.array_intersect(a, b))
    return (both == 0) | (both == F.size(a)) | (both == F.size(b)) | F.coalesce(F.size(a) + F.size(b) - both == tips, F.lit(False))


def chosen_splits(support: DataFrame, group: str) -> DataFrame:
    """(group, split, weight) of a table (group, split, weight, tips): splits by falling support, ties by their tips, that are compatible with all chosen before.

    A group's splits, which are at most its trees times their branches, meet in one row; they are walked there by an expression. A null number of tips is for rooted trees."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("split").alias("s"))))
    rows = support.groupBy(group).agg(order.alias("_order"), F.first("tips").alias("_tips"))
    fits = lambda kept, x: F.forall(kept, lambda y: compatible_splits(y["s"], x["s"], F.col("_tips")))
    none = F.array().cast("array<struct<w:double,s:array<string>>>")
    kept = F.aggregate("_order", none, lambda kept, x: F.when(fits(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select(group, F.explode(kept).alias("_k")).select(group, F.col("_k.s").alias("split"), (-F.col("_k.w")).alias("weight"))


def assemble(table: dict[tuple[str, ...], float], names: list[str]) -> Node:
    """The tree of nested or disjoint splits; lengths are the table's values, also of single tips that are in it."""
    root = Node(children=[Node(n, table.get((n,))) for n in names])
    where = dict.fromkeys(names, root)
    for s in sorted((x for x in table if len(x) > 1), key=lambda x: (-len(x), x)):
        up, inside = where[s[0]], set(s)
        part = [c for c in up.children if inside.issuperset(c.tips())]
        n = Node(None, table[s], part)
        up.children = [*[c for c in up.children if not any(c is p for p in part)], n]
        where |= dict.fromkeys(s, n)
    # a split that holds all but the first tip is that tip's own branch
    for c in list(root.children):
        rest = tuple(sorted(set(names) - {c.name or ""}))
        if not c.children and rest in table:
            inner = next(x for x in root.children if x.children and tuple(sorted(x.tips())) == rest)
            c.length = (c.length or 0.0) + table[rest]
            root.children = [c, *inner.children]
    return root


def consensus_trees(trees: DataFrame, group: str, method: str = "mre", fraction: float = 0.5, rooted: bool = False) -> DataFrame:
    """(group, newick, n_trees): one consensus for each group of trees (group, newick); interior lengths are supports, tips' are the number of trees.

    All trees of a group must have the same tips. Per group only the splits' supports, not the trees, meet in one task. Empty groups don't occur."""
    trees = durable(trees.select(group, "newick"))  # they are read three times and may be dear to make
    tips = splits(trees, group).where(F.size("split") == 1).groupBy(group).agg(F.collect_set(F.col("split")[0]).alias("_tips"))
    n = trees.where("newick is not null").groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("newick").alias("_one"))
    support = split_support(trees, group).join(n, group).where(censored(F.col("weight"), F.col("_n"), method, fraction))
    everyone = F.lit(None).cast("int") if rooted else F.size("_tips") + 1  # the first tip's own split is that of all others
    chosen = chosen_splits(support.join(tips, group).select(group, "split", "weight", everyone.alias("tips")), group)
    rows = n.join(tips, group).select(group, "_n", "_one", F.lit(None).cast("array<string>").alias("split"), F.lit(0.0).alias("weight")).unionByName(chosen.join(n, group).select(group, "_n", "_one", "split", "weight"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        from strandweave.operators.newick import parse

        count, names = int(p["_n"].iloc[0]), sorted(parse(p["_one"].iloc[0])[0].tips())
        kept = {tuple(s): float(w) for s, w in zip(p.split, p.weight, strict=True) if s is not None}
        root = assemble(kept | {(x,): float(count) for x in names}, names)
        return pd.DataFrame([(p[group].iloc[0], render(root, 2), count)], columns=[group, "newick", "n_trees"])

    return rows.groupBy(group).applyInPandas(run, f"{group} {dict(trees.dtypes)[group]}, newick string, n_trees bigint")


def split_listing(trees: DataFrame, group: str, method: str = "mre", fraction: float = 0.5, rooted: bool = False) -> DataFrame:
    """(group, split, weight, included): every split of a group's trees with its support, and whether the consensus has it."""
    trees = durable(trees.select(group, "newick"))
    support = split_support(trees, group).select(group, "split", "weight")
    chosen = splits(consensus_trees(trees, group, method, fraction, rooted), group, trivial=False).select(group, "split", F.lit(True).alias("included"))
    return support.join(chosen, [group, "split"], "left").fillna(False, ["included"])
