"""python -m strandweave COMMAND: counts, distances, trees and bootstraps over folders of reads or tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.dense import row_numbers
from strandweave.operators import bootstrap, consensus, counting, merging, newick, sharing, tips, treedist, treefit
from strandweave.plans import pipeline
from strandweave.plans.durable import planning
from strandweave.sources.fastx import read_fastx
from strandweave.sources.tables import phylip_lines, read_counts, read_tip_info, read_trees, write_counts


COMMANDS = {
    "count": "k-mers of each sample",
    "histogram": "how many k-mers of each sample have each count",
    "singletons": "k-mers that one sample only holds, over k",
    "stats": "reads, bases, lengths and GC of each sample",
    "distance": "distance matrix",
    "phylogeny": "tree",
    "bootstrap": "consensus of the trees of resampled tables",
    "consensus": "consensus of a file of trees",
    "treedist": "distances between trees that follow one another in a file",
    "genomesize": "genome sizes by the k-mers' mean count",
    "merge": "k-mer tables (tab-separated, a file or folder each, parted by commas) merged by --rules",
    "tip": "tip lengths of a file of tip information",
    "trim": "a file of trees with tips shortened by --by",
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        c = sub.add_parser(name, help=text)
        c.add_argument("-d", "--data", required=True, help="folder of FASTA or FASTQ files, a folder a sample; a Parquet table (panel, sample, kmer, cnt); or a file of trees")
        c.add_argument("-o", "--out", required=True, help="folder to write")
        c.add_argument("-k", type=int, default=25, help="k-mer length")
        c.add_argument("-n", type=int, default=1, help="smallest count of a k-mer that is kept")
        c.add_argument("--replicates", type=int, default=100)
        c.add_argument("--seed", type=int, default=1)
        c.add_argument("--method", choices=consensus.METHODS, default="mre")
        c.add_argument("--fraction", type=float, default=0.5, help="support that method ml asks for")
        c.add_argument("--outgroup", help="tip at which trees are hung up")
        c.add_argument("--by", type=float, default=0.0)
        c.add_argument("--rules", default="", help="a letter of A, N, E, O, T for each table of a merge; T for all by default")
        c.add_argument("-s", "--plan", action="store_true", help="only show the plan")
    return p


def _counts(spark: SparkSession, data: str, k: int, least: int) -> DataFrame:
    if data.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(data).select("panel", "sample", "kmer", "cnt").where(f"cnt >= {least}")
    return pipeline.reads_to_counts(read_fastx(spark, data), k, least)


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The table that a command writes."""
    if a.command == "stats":
        return counting.read_statistics(read_fastx(spark, a.data))
    if a.command == "genomesize":
        return pipeline.genome_sizes(read_fastx(spark, a.data), a.k, a.n)
    if a.command == "merge":
        inputs = [read_counts(spark, p) for p in a.data.split(",")]
        return merging.merge_tables(inputs, ["kmer"], "cnt", a.rules or "T" * len(inputs), default=0)
    if a.command == "tip":
        return tips.tip_lengths(tips.tip_table(read_tip_info(spark, a.data).withColumn("panel", F.lit("all"))), a.k).drop("panel")
    if a.command in ("consensus", "treedist", "trim"):
        trees = read_trees(spark, a.data).withColumn("grp", F.lit("all"))
        if a.command == "consensus":
            return consensus.consensus_trees(trees, "grp", a.method, a.fraction)
        if a.command == "trim":
            return newick.trimmed(trees, a.by, "tree_id")
        numbered = row_numbers(trees, "tree_id").select(F.col("_row").alias("id"), "newick")
        return treedist.split_distance(newick.splits(numbered, "id"), treedist.pair_ids(numbered, "adjacent"))
    counts = _counts(spark, a.data, a.k, a.n)
    match a.command:
        case "count":
            return counts.select("sample", "kmer", "cnt")
        case "histogram":
            return counting.abundance(counts)
        case "singletons":
            return sharing.singletons(counts, a.k)
        case "distance":
            return phylip_lines(pipeline.distances_of(sharing.pair_shares(counts), a.k))
        case "phylogeny":
            return pipeline.phylogeny(counts, a.k, treefit.Options(outgroup=a.outgroup))
    patterns = sharing.patterns(counts)
    return consensus.consensus_trees(bootstrap.bootstrap_trees(patterns, a.replicates, a.seed, a.k), "panel", a.method, a.fraction)


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("strandweave").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    if a.plan:
        with planning():  # nothing runs
            result(spark, a).explain("formatted")
        return
    out = result(spark, a)
    if a.command == "count":
        write_counts(out, a.out)
        counting.diversity(out).write.mode("overwrite").parquet(f"{a.out}.diversity")
    else:
        out.write.mode("overwrite").parquet(a.out)
