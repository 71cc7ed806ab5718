"""Tip lengths from coverage, read length and error rate, their average, and the p_h curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.formulas import kmer_coverage, tip_length


def tip_table(tip_info: DataFrame) -> DataFrame:
    """(panel, spname, coverage, readlength, errorrate): complete rows, one a sample; where copies differ, the whole row with the smallest coverage, then read length, then error rate."""
    t = tip_info.dropna(subset=["spname", "coverage", "readlength", "errorrate"])
    return t.groupBy("panel", "spname").agg(F.min(F.struct("coverage", "readlength", "errorrate")).alias("r")).select("panel", "spname", "r.*")


def tip_lengths(tips: DataFrame, k: int) -> DataFrame:
    """(panel, spname, l, tip, tip_filtered): tip lengths of samples whose reads are at least k long, without and with a filter of single k-mers."""
    c, r, e = F.col("coverage"), F.col("readlength"), F.col("errorrate")
    return tips.where((r >= k) & (c > 0)).select("panel", "spname", kmer_coverage(c, r, k).alias("l"), tip_length(c, r, e, k).alias("tip"), tip_length(c, r, e, k, True).alias("tip_filtered"))


def tip_average(lengths: DataFrame, totals: DataFrame, value: str = "tip", ordered_pairs: bool = True) -> DataFrame:
    """(panel, n_samples, tip_ave): over a panel's pairs, the tip of the sample with fewer k-mers, added up and divided by n(n-1), or by half of it.

    A sample's tip counts once for each sample after it in the order of k-mers, so no pairs are formed. Ties by name."""
    t = lengths.join(totals, (lengths.panel == totals.panel) & (lengths.spname == totals["sample"])).select(lengths.panel, "spname", value, "ntotal")
    w = W.partitionBy("panel")
    later = t.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("after", F.col("n") - F.row_number().over(w.orderBy("ntotal", "spname")))
    g = later.groupBy("panel").agg(F.max("n").alias("n_samples"), F.sum(F.col(value) * F.col("after")).alias("total"))
    pairs = F.col("n_samples") * (F.col("n_samples") - 1) / (1 if ordered_pairs else 2)
    return g.where("n_samples > 1").select("panel", "n_samples", (F.col("total") / pairs).alias("tip_ave"))


def copies(count: Column, coverage: Column) -> Column:
    """How often a k-mer occurs in its genome: its count over the coverage, rounded, at least 1. As BIGINT; no upper bound."""
    return F.greatest(F.lit(1), F.round(count / coverage)).cast("bigint")


def copy_bins(held: DataFrame, *keys: str) -> DataFrame:
    """(keys, copies, n BIGINT): how many k-mers of (keys, copies) occur so often."""
    return held.groupBy(*keys, "copies").agg(F.count(F.lit(1)).alias("n"))


def ph_curve(abundances: DataFrame, k: Column, size: Column, gc: Column, d: float = 0.1, q: str = "q") -> DataFrame:
    """Adds ph, the expected share of k-mers whose sharing is homoplasy, to rows with q ARRAY<DOUBLE>, the shares of k-mers that occur 1, 2, … times in a genome."""
    shared = F.exp(-k * d)
    g, same = size - k + 1, 2 * F.pow(0.5 - gc + gc * gc, k)
    once = 1 - F.pow(1 - same, g)
    total = lambda base: F.aggregate(F.transform(F.col(q), lambda x, i: F.pow(base, i + 1) * x), F.lit(0.0), lambda a, x: a + x)
    ph1 = 1 - total(1 - shared)
    ph2 = (1 - shared) * once
    ph3 = 0.5 * shared * total(once)
    return abundances.withColumn("ph", ph1 + (1 - ph1) * ph2 + (1 - ph1) * (1 - ph2) * ph3)


def ph_of_groups(groups: DataFrame, keys: list[str], k: int, gc: float, d: float = 0.1) -> DataFrame:
    """(keys, size, ph): ph_curve() of a table (keys, copies, n) of how many k-mers occur so often in a genome, however often that is."""
    size = F.sum("n").over(W.partitionBy(*keys))
    shared = F.exp(F.lit(-k * d))
    once = 1 - F.pow(F.lit(1 - 2 * (0.5 - gc + gc * gc) ** k), F.col("size") - k + 1)
    t = groups.withColumn("size", size).withColumn("once", once)
    total = lambda base: F.sum(F.pow(base, F.col("copies")) * F.col("n") / F.col("size"))
    g = t.groupBy(*keys, "size", "once").agg(total(1 - shared).alias("a"), total(F.col("once")).alias("b"))
    ph1, ph2, ph3 = 1 - F.col("a"), (1 - shared) * F.col("once"), 0.5 * shared * F.col("b")
    return g.select(*keys, "size", (ph1 + (1 - ph1) * ph2 + (1 - ph1) * (1 - ph2) * ph3).alias("ph"))
