"""Counting k-mers per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.kmers import complexity, decode_2bit, explode_kmers, usable_codes, well_mixed

#: Fixed value: counts saturate here.
CAP = 16383


def distinct_reads(reads: DataFrame) -> DataFrame:
    """(read_id, sample, seq) of reads with a sample and an id, each once. Copies whose sequences differ are reads by themselves. Nothing is sorted: the rows are combined by hash."""
    return reads.where("sample is not null and read_id is not null").select("read_id", "sample", "seq").distinct()


def count_kmers(reads: DataFrame, k: int, least: int = 1, cap: int = CAP, special: bool | None = None, with_complexity: bool = False, limit: int | None = None, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample, kmer, cnt BIGINT[, complexity]): canonical k-mers of reads (sample, seq), counted, saturated at `cap` and filtered.

    weight: a column of whole numbers, as often does a read count. by: columns that keep counts apart besides the sample. least: smallest count kept. special: True keeps well-mixed k-mers, False the others, None all. limit: the first k-mers of each sample in order. k from 3 to 63.
    Counting is one shuffle of map-side sums, so a sample that holds a third of all reads is spread over all tasks. Reads without a k-mer add nothing.
    """
    if not 3 <= k <= 63:
        raise ValueError("k must be from 3 to 63")
    keys = (*by, "sample")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    t = explode_kmers(reads.where("sample is not null"), "seq", k, *keys, *([weight] if weight else [])).groupBy(*keys, "kmer").agg(F.least(n, F.lit(cap)).cast("bigint").alias("cnt"))
    if least > 1:
        t = t.where(F.col("cnt") >= least)
    if special is not None:
        t = t.where(well_mixed("kmer", k) if special else ~well_mixed("kmer", k))
    if limit is not None:
        t = t.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("kmer"))).where(F.col("_n") <= limit).drop("_n")
    return t.withColumn("complexity", complexity("kmer", k)) if with_complexity else t


def summed_counts(kmer_t: DataFrame, cap: int = CAP) -> DataFrame:
    """(panel, sample, kmer, cnt): counts of the usable rows of a table of counts by file and day, added up and saturated.

    Rows with the same rec_id count once, a null cnt adds nothing. The k-mer is held even if its sum is 0."""
    once = usable_codes(kmer_t, "panel", "sample", "rec_id", "cnt").groupBy("panel", "sample", "code", "rec_id").agg(F.max("cnt").alias("cnt"))
    sums = once.groupBy("panel", "sample", "code").agg(F.least(F.coalesce(F.sum("cnt"), F.lit(0)), F.lit(cap)).cast("bigint").alias("cnt"))
    return sums.select("panel", "sample", decode_2bit("code", 21).alias("kmer"), "cnt")


def diversity(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, ntotal BIGINT): distinct k-mers of a table with one row for each sample and k-mer."""
    return counts.groupBy(*(keys or ("sample",))).agg(F.count(F.lit(1)).alias("ntotal"))


def abundance(counts: DataFrame, most: int = 10000) -> DataFrame:
    """(sample, multiplicity BIGINT, n BIGINT): how many k-mers of a sample have each count up to `most`."""
    return counts.where(F.col("cnt") <= most).groupBy("sample", F.col("cnt").alias("multiplicity")).agg(F.count(F.lit(1)).alias("n"))


def read_statistics(reads: DataFrame) -> DataFrame:
    """(sample, n_reads, total_bp, min_len, max_len, mean_len, gc): G+C over letters other than N, upper case counted only; mean_len is a whole number. Null sequences add nothing."""
    s = F.col("seq")
    n = lambda b: F.sum(F.length(s) - F.length(F.replace(s, F.lit(b), F.lit(""))))
    t = reads.where("seq is not null").groupBy("sample").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length(s)).cast("bigint").alias("total_bp"), F.min(F.length(s)).cast("bigint").alias("min_len"), F.max(F.length(s)).cast("bigint").alias("max_len"), n("G").alias("g"), n("C").alias("c"), n("N").alias("x"))
    mean = F.floor(F.col("total_bp") / F.col("n_reads")).cast("bigint")
    return t.select("sample", "n_reads", "total_bp", "min_len", "max_len", mean.alias("mean_len"), F.when(F.col("total_bp") > F.col("x"), (F.col("g") + F.col("c")) / (F.col("total_bp") - F.col("x"))).alias("gc"))
