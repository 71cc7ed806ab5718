"""Distances between trees, paths within them and the quality of their fit, as joins of their splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.formulas import LEAST_DISTANCE, fit_weight


def pair_ids(ids: DataFrame, scheme: str, others: DataFrame | None = None) -> DataFrame:
    """(id1, id2) of trees numbered from 0 in `id`: adjacent (0,1), (2,3), …; corresponding: equal ids of two tables. A lone last tree has no pair."""
    a = ids.select(F.col("id").alias("id1"))
    match scheme:
        case "adjacent":
            return a.where("id1 % 2 = 0").join(ids.select(F.col("id").alias("id2")), F.col("id2") == F.col("id1") + 1)
        case "corresponding":
            return a.join((others or ids).select(F.col("id").alias("id2")), F.col("id1") == F.col("id2"))
    raise ValueError("adjacent or corresponding")


def split_distance(splits: DataFrame, pairs: DataFrame, key: str = "id", split: str = "split", length: str = "length") -> DataFrame:
    """(id1, id2, rf BIGINT, branch_score DOUBLE) for pairs of trees, from their distinct splits (key, split, length).

    rf: splits that only one of them has; branch_score: root of the summed squared differences of lengths, a missing split having length 0."""
    left = pairs.join(splits.select(F.col(key).alias("id1"), F.col(split).alias("s"), F.col(length).alias("l")), "id1").select("id1", "id2", "s", F.col("l").alias("a"), F.lit(None).cast("double").alias("b"))
    right = pairs.join(splits.select(F.col(key).alias("id2"), F.col(split).alias("s"), F.col(length).alias("l")), "id2").select("id1", "id2", "s", F.lit(None).cast("double").alias("a"), F.col("l").alias("b"))
    each = left.unionByName(right).groupBy("id1", "id2", "s").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.groupBy("id1", "id2").agg(F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("bigint")).alias("rf"), F.sqrt(F.sum(_square(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).alias("branch_score"))


def all_distances(splits: DataFrame, group: str, key: str = "id", split: str = "split", length: str = "length") -> DataFrame:
    """(group, id1, id2, rf BIGINT, branch_score DOUBLE) of all pairs id1 < id2 of a group's trees, also of those that have no split in common; of two files of trees, give each its own range of ids.

    Every pair is a row of the result and is joined with the splits of its two trees; ids must be of one group each. A tree without splits has no row in the table and no pair."""
    ids = splits.select(group, key).distinct()
    pairs = ids.select(group, F.col(key).alias("id1")).join(ids.select(group, F.col(key).alias("id2")), group).where("id1 < id2")
    return split_distance(splits, pairs.select("id1", "id2"), key, split, length).join(pairs, ["id1", "id2"]).select(group, "id1", "id2", "rf", "branch_score")


def path_lengths(splits: DataFrame, pairs: DataFrame, group: str = "panel") -> DataFrame:
    """(group, s1, s2, path) for pairs (group, s1, s2) of tips: the summed lengths of those splits (group, split, length) of the group's tree that have one of both on either side.

    A pair that no split parts, as in a tree without branches, has path 0; pairs of groups without a tree have no row."""
    apart = F.array_contains("split", F.col("s1")) != F.array_contains("split", F.col("s2"))
    return pairs.select(group, "s1", "s2").join(splits.select(group, "split", "length"), group).groupBy(group, "s1", "s2").agg(F.sum(F.when(apart, F.col("length")).otherwise(0.0)).alias("path"))


def fit_report(splits: DataFrame, distances: DataFrame, k: int, group: str = "panel") -> DataFrame:
    """(group, n_samples, ss, percent_sd) of a group's tree (group, split, length) and its distances (group, s1, s2, d), each pair once: the weighted sum of squares over ordered pairs and the average percent
    standard deviation, 0 of two samples."""
    d = F.greatest(F.col("d"), F.lit(LEAST_DISTANCE))
    j = distances.select(group, "s1", "s2", "d").join(path_lengths(splits, distances, group), [group, "s1", "s2"])
    g = j.groupBy(group).agg((2 * F.sum(fit_weight(F.col("d"), k) * _square(d - F.col("path")))).alias("ss"), (2 * F.count(F.lit(1))).alias("_ordered"))
    n = F.round((1 + F.sqrt(1 + 4 * F.col("_ordered"))) / 2).cast("bigint")  # n (n - 1) ordered pairs
    return g.select(group, n.alias("n_samples"), "ss", F.when(F.col("_ordered") > 2, 100 * F.sqrt(F.col("ss") / (F.col("_ordered") - 2))).otherwise(0.0).alias("percent_sd"))


def _square(x: Column) -> Column:
    return x * x
