"""Shared and total k-mer tables, numbers of shared k-mers of pairs, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.formulas import distance
from strandweave.plans.durable import durable

#: Patterns that are multiplied together.
TILE = 2048
#: Numbers of 63 bits that hold a k-mer's samples, and names of samples (some 50 bytes each) that are broadcast.
WORDS, BROADCAST = 16, 100_000


def shared_table(counts: DataFrame, least: int = 2) -> DataFrame:
    """Rows of a table (panel, sample, kmer, cnt) whose k-mer at least `least` samples of the panel hold: the T rule. One shuffle and no join-back."""
    g = counts.groupBy("panel", "kmer").agg(F.collect_list(F.struct("sample", "cnt")).alias("held")).where(F.size("held") >= least)
    return g.select("panel", "kmer", F.explode("held").alias("h")).select("panel", F.col("h.sample").alias("sample"), "kmer", F.col("h.cnt").alias("cnt"))


def total_table(counts: DataFrame) -> DataFrame:
    """The O rule: (panel, kmer, n_samples, cnt) of every k-mer."""
    return counts.groupBy("panel", "kmer").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("cnt").alias("cnt"))


def wide_matrix(counts: DataFrame, columns: list[str], column: str = "sp", default: int = 0) -> DataFrame:
    """(panel, kmer, one column for each name): the count matrix of each panel, absent = default."""
    return counts.groupBy("panel", "kmer").pivot(column, columns).agg(F.first("cnt")).fillna(default, columns)


def sample_places(samples: DataFrame) -> tuple[DataFrame, int, bool]:
    """(panel, _names) of (panel, sample): each panel's samples in order, computed once; the most samples of a panel, at least 1; whether all are few enough to be broadcast."""
    names = samples.select("panel", "sample").where("sample is not null").distinct()
    known = durable(names.groupBy("panel").agg(F.array_sort(F.collect_list("sample")).alias("_names")))
    most = known.agg(F.max(F.size("_names")), F.sum(F.size("_names"))).first()
    return known, most[0] or 1, (most[1] or 0) <= BROADCAST


def patterns(held: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(panel, pattern ARRAY<STRING>, n): how many k-mers of a panel exactly the samples of the pattern hold, from (panel, sample, kmer), repeated or not. Rows with a null sample are left out.

    One shuffle of what each task has combined: a k-mer's samples are bits of whole numbers, which are put together by hash aggregation, and names again only once
    k-mers are counted. Panels of more than WORDS x 63 samples are put together as arrays of names. There are far fewer patterns than k-mers, so all that comes after is small.
    samples: (panel, sample) of all rows, if these are to be had for less than from `held`; others do no harm."""
    known, most, few = sample_places(held if samples is None else samples)
    words = range(-(-most // 63))
    if len(words) > WORDS:
        return held.where("sample is not null").groupBy("panel", "kmer").agg(F.array_sort(F.collect_set("sample")).alias("pattern")).groupBy("panel", "pattern").agg(F.count(F.lit(1)).alias("n"))
    place = known.select(F.col("panel").alias("_panel"), F.posexplode("_names").alias("_i", "_sample"))
    near = F.broadcast(place) if few else place
    rows = held.join(near, F.col("panel").eqNullSafe(F.col("_panel")) & (F.col("sample") == F.col("_sample")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_i") % 63)
    masks = rows.groupBy("panel", "kmer").agg(*[F.bit_or(F.when(F.floor(F.col("_i") / 63) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_m{w}") for w in words])
    counted = masks.groupBy("panel", *[f"_m{w}" for w in words]).agg(F.count(F.lit(1)).alias("n"))
    held_by = lambda x, i: F.call_function("shiftrightunsigned", F.element_at(F.array(*[f"_m{w}" for w in words]), (F.floor(i / 63) + 1).cast("int")), (i % 63).cast("int")).bitwiseAND(1) == 1
    back = known.select(F.col("panel").alias("_panel"), "_names")
    return counted.join(F.broadcast(back) if few else back, F.col("panel").eqNullSafe(F.col("_panel"))).select("panel", F.filter("_names", held_by).alias("pattern"), "n")


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted product X'WX of each panel's 0/1 patterns in a batch, as its upper triangle."""
    for b in batches:
        held = b.column(1).flatten().dictionary_encode()
        if not len(held):
            continue
        names = held.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        names = pa.array([names[i] for i in order], pa.string())
        panel = b.column(0).dictionary_encode(null_encoding="encode")
        code, n = panel.indices.to_numpy(), b.column(2).to_numpy()
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy())
        col = rank[held.indices.to_numpy()]
        by = np.argsort(code[row], kind="stable")
        row, col = row[by], col[by]
        ends = np.r_[np.flatnonzero(np.diff(code[row])) + 1, len(row)]
        for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True):
            at, c = np.unique(col[lo:hi], return_inverse=True)
            i, j, cells = _product(row[lo:hi], c, n, len(at))
            which = pa.array(np.full(len(cells), code[row[lo]]))
            yield pa.RecordBatch.from_arrays([panel.dictionary.take(which), names.take(pa.array(at[i])), names.take(pa.array(at[j])), pa.array(cells)], ["panel", "s1", "s2", "n"])


def _product(row: np.ndarray, col: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells above 0 of the upper triangle of X'WX, from the ones of X in order of rows; TILE rows are multiplied at a time, as doubles while these are exact."""
    total = np.zeros((width, width), np.int64)
    own, r = np.unique(row, return_inverse=True)
    for k in range(0, len(own), TILE):
        lo, hi = np.searchsorted(r, (k, k + TILE))
        w = weight[own[k : k + TILE]]
        x = np.zeros((len(w), width), np.float64 if w.sum(dtype=np.float64) < 2.0**52 else np.int64)
        x[r[lo:hi] - k, col[lo:hi]] = 1
        total += (x.T @ (x * w[:, None])).astype(np.int64)
    i, j = np.nonzero(np.triu(total))
    return i, j, total[i, j]


def pair_shares(held: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(panel, s1, s2, nshare BIGINT) of pairs s1 <= s2 of one panel that share a k-mer; s1 = s2 gives the sample's own number. From (panel, sample, kmer), repeated or not."""
    return pattern_shares(patterns(held, samples))


def pattern_shares(counted: DataFrame) -> DataFrame:
    """pair_shares() of patterns()."""
    cells = counted.mapInArrow(_gram, "panel string, s1 string, s2 string, n bigint")
    return cells.groupBy("panel", "s1", "s2").agg(F.sum("n").alias("nshare"))


def distances_of(shares: DataFrame, k: int) -> DataFrame:
    """(panel, s1, s2, nshare, n1, n2, d) of all pairs s1 < s2 of a panel's samples, from pair_shares(); pairs that share nothing are at distance 1.

    The panel's samples are those with a row s1 = s2. A panel of one sample has no pair."""
    shares = durable(shares)  # a row a pair, read three times
    own = shares.where("s1 = s2")
    n = lambda s, c: own.select("panel", F.col("s1").alias(s), F.col("nshare").alias(c))
    pairs = n("s1", "n1").join(n("s2", "n2"), "panel").where("s1 < s2").join(shares.where("s1 < s2"), ["panel", "s1", "s2"], "left")
    return pairs.withColumn("nshare", F.coalesce("nshare", F.lit(0).cast("bigint"))).select("panel", "s1", "s2", "nshare", "n1", "n2", distance(F.col("nshare"), F.col("n1"), F.col("n2"), k).alias("d"))


def singletons(counts: DataFrame, k: int) -> DataFrame:
    """(panel, sample, n): whole number of (k-mers of the sample that no other sample of its panel holds) / k."""
    alone = F.sum((F.col("n_samples") == 1).cast("bigint"))
    total = counts.groupBy("panel", "kmer").agg(F.count(F.lit(1)).alias("n_samples"), F.collect_list("sample").alias("samples"))
    return total.select("panel", F.explode("samples").alias("sample"), "n_samples").groupBy("panel", "sample").agg(F.floor(alone / k).cast("bigint").alias("n"))


def singletons_of_totals(counts: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(panel, sample, n): singletons by published totals (panel, sample, ntotal): whole number of (ntotal - k-mers of the sample that another of its panel holds) / k, at least 0.

    A sample without a total, or with a null one, has no row; one that shares nothing has its whole total. Totals occur once a sample."""
    shared = shared_table(counts).groupBy("panel", "sample").agg(F.count(F.lit(1)).alias("_shared"))
    rest = F.col("ntotal") - F.coalesce("_shared", F.lit(0))
    return totals.where("ntotal is not null").select("panel", "sample", "ntotal").join(shared, ["panel", "sample"], "left").select("panel", "sample", F.floor(F.greatest(rest, F.lit(0)) / k).cast("bigint").alias("n"))


def published_totals(table: DataFrame) -> DataFrame:
    """(panel, sample, ntotal BIGINT) of a published table (pos, panel, sample, ntotal): of a sample's rows that have a total the last in the table's order."""
    t = table.where("panel is not null and sample is not null and ntotal is not null")
    return t.groupBy("panel", "sample").agg(F.max_by("ntotal", "pos").cast("bigint").alias("ntotal"))


def published_matrix(table: DataFrame, cells: list[str], *keys: str) -> DataFrame:
    """(keys, cells): one whole row for each key of a matrix that was exported more than once: the one with the fewest missing cells, of these that with the smallest cells in order. Rows with a null key are left out."""
    missing = reduce(Column.__add__, [F.col(c).isNull().cast("int") for c in cells])
    best = F.min(F.struct(missing.alias("_m"), *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in cells])).alias("b")
    return table.dropna(subset=list(keys)).groupBy(*keys).agg(best).select(*keys, *[F.when(F.col(f"b.{c}") >= 0, F.col(f"b.{c}")).alias(c) for c in cells])


def share_matrix(shares: DataFrame, columns: list[str]) -> DataFrame:
    """(panel, sample, one column for each sp): the symmetric matrix of a panel's shares, its diagonal the samples' own numbers, 0 where nothing is shared."""
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    both = shares.select("panel", F.col("s1").alias("sample"), short("s2").alias("sp"), "nshare").unionByName(shares.where("s1 <> s2").select("panel", F.col("s2").alias("sample"), short("s1").alias("sp"), "nshare"))
    return both.groupBy("panel", "sample").pivot("sp", columns).agg(F.first("nshare")).fillna(0, columns)
