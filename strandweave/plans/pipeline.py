"""Whole analyses: reads or count tables to distances, trees and supported trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import formulas
from strandweave.operators import bootstrap, consensus, counting, sharing, treefit
from strandweave.operators.sharing import distances_of


def panel_trees(distances: DataFrame, k: int, options: treefit.Options | None = None) -> DataFrame:
    """(panel, newick, ss, percent_sd)."""
    return treefit.fit_trees(distances, "panel", k, options)


def reads_to_counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(panel, sample, kmer, cnt) of reads (sample, seq) as one panel."""
    return counting.count_kmers(reads, k, least).select(F.lit("all").alias("panel"), "sample", "kmer", "cnt")


def phylogeny(counts: DataFrame, k: int, options: treefit.Options | None = None) -> DataFrame:
    """(panel, newick, ss, percent_sd) of a table (panel, sample, kmer, cnt)."""
    return panel_trees(distances_of(sharing.pair_shares(counts), k), k, options)


def supported_phylogeny(counts: DataFrame, k: int, replicates: int = 100, seed: int = 1, method: str = "mre") -> DataFrame:
    """(panel, newick, n_trees): consensus of trees of resampled tables."""
    patterns = sharing.patterns(counts)
    return consensus.consensus_trees(bootstrap.bootstrap_trees(patterns, replicates, seed, k), "panel", method)


def genome_sizes(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(sample, genome_size DOUBLE) of reads (sample, seq): bases over the coverage that the mean count of the k-mers implies. Samples whose mean read is shorter than k have no row."""
    c = counting.count_kmers(reads, k, least).groupBy("sample").agg(F.sum("cnt").alias("kmers"), F.count(F.lit(1)).alias("kinds"))
    t = counting.read_statistics(reads).join(c, "sample")
    size = formulas.genome_size(F.col("total_bp"), F.col("kmers"), F.col("kinds"), F.col("mean_len"), k)
    return t.where(F.col("mean_len") >= k).select("sample", size.alias("genome_size"))
