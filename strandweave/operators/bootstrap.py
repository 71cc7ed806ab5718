"""Bootstraps: reads, table rows and parametric; replicates run in parallel.

A table's rows matter only through the set of samples that hold them, so resampling rows with replacement is a multinomial draw over the numbers of rows
of each presence pattern: a replicate costs as much as there are patterns, whatever the number of k-mers. The draw is made over blocks of patterns first and within
each block then, so that no task ever has all patterns of a wide panel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dense import row_numbers
from strandweave.functions.formulas import distance, distance_error
from strandweave.functions.kmers import encode_2bit, explode_kmers
from strandweave.operators.counting import count_kmers
from strandweave.operators.newick import parse, split_table
from strandweave.operators.sharing import WORDS, _product, distances_of, pattern_shares, patterns, sample_places
from strandweave.operators.treefit import Options, fit_tree, fit_trees
from strandweave.plans.durable import durable, spread


#: Patterns of a panel that a task draws from and multiplies together, about.
BLOCK = 4096


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and key only, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) * F.lit(2.0**-53)


def normal(seed: int, *key: Column) -> Column:
    """A standard normal number that depends on the seed and key only."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *key))) * F.cos(2 * np.pi * uniform(seed + 1_000_003, *key))


def subsample(reads: DataFrame, m: int, seed: int, key: str = "read_id") -> DataFrame:
    """m reads without replacement, all if there are no more: those with the smallest hashes of key and seed.

    The hash up to which reads are taken is found from counts of its leading bits, twice 65,536 numbers on the driver; only reads that share its first 32 bits are ever ordered in one task."""
    h = reads.withColumn("_u", F.xxhash64(F.lit(seed), F.col(key)))
    bits = lambda skip: F.shiftrightunsigned("_u", 48 - skip).bitwiseAND(65535)
    rest, edge, taken = h, m, None
    for skip in (0, 16):
        cut = None
        for b, n in sorted((r[0], r[1]) for r in rest.groupBy(bits(skip).alias("b")).count().collect()):
            if n > edge:
                cut = b
                break
            edge -= n
        below = rest if cut is None else rest.where(bits(skip) < cut)
        taken = below if taken is None else taken.unionByName(below)
        if cut is None or not edge:
            return taken.drop("_u")
        rest = rest.where(bits(skip) == cut)
    return taken.unionByName(rest.orderBy("_u", key).limit(edge)).drop("_u")


def bootstrap_reads(reads: DataFrame, seed: int, by: str = "file", key: str = "read_id", replicates: int | None = None) -> DataFrame:
    """Each file's reads drawn as often as it has reads, with replacement: the drawn reads with `draws`, the times they came. Null files are one file.

    With replicates, so many resamples, told apart by a column `replicate` from 1."""
    numbered, keys, drawn = _draws(reads, seed, by, key, replicates)
    return numbered.join(drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws")), "_row").drop("_row")


def _draws(reads: DataFrame, seed: int, by: str, key: str, replicates: int | None) -> tuple[DataFrame, list[str], DataFrame]:
    """The reads with their number in order as _row; the columns of a draw, [replicate,] _row; a row a draw."""
    numbered = row_numbers(reads.withColumn(by, F.coalesce(by, F.lit(""))), by, key)
    span = numbered.groupBy(by).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows, keys = numbered.select(by, "_row"), ["_row"]
    if replicates is not None:
        rows, keys = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))), ["replicate", "_row"]
    return numbered, keys, rows.join(span, by).select(*keys[:-1], (F.col("_first") + F.floor(uniform(seed, *map(F.col, keys)) * F.col("_n"))).cast("bigint").alias("_row"))


def read_bootstrap_patterns(reads: DataFrame, replicates: int, seed: int, k: int, least: int = 1, by: str = "file", key: str = "read_id") -> DataFrame:
    """patterns() of the k-mers of resampled reads (key, panel, sample, by, seq), of which each replicate draws each file's; a replicate of a panel is a panel of its own,
    named by _named(). least: smallest count of a k-mer that is kept. Reads with a null sample are drawn but hold nothing.

    Which replicates drew a read of which sample are bits of whole numbers, so that a read's k-mers are made and shuffled once for all replicates whose bits WORDS x 63 places of a panel's
    samples hold, and a replicate costs as much as there are patterns. With least above 1, or of panels of more than WORDS x 63 samples, each replicate's k-mers are counted by themselves."""
    known, most, few = sample_places(reads)
    span = min(replicates, WORDS * 63 // most)
    if least > 1 or not span:
        counts = count_kmers(bootstrap_reads(reads, seed, by, key, replicates), k, least, weight="draws", by=("panel", "replicate"))
        return patterns(counts.select(_name("panel", "replicate"), "sample", "kmer"))
    numbered, _, drawn = _draws(reads, seed, by, key, replicates)
    place = known.select(F.col("panel").alias("_panel"), F.posexplode("_names").alias("_i", "_sample"))
    near = F.broadcast(place) if few else place
    placed = durable(numbered.join(near, F.col("panel").eqNullSafe(F.col("_panel")) & (F.col("sample") == F.col("_sample"))).select("panel", "_i", "_row", "seq"))
    parts = [_block_patterns(placed, drawn, known.hint("broadcast") if few else known, r, min(span, replicates + 1 - r), most, k) for r in range(1, replicates + 1, span)]
    return reduce(DataFrame.unionByName, parts)


def _name(panel: str, replicate: str) -> Column:
    return F.to_json(F.struct(F.col(panel).alias("panel"), F.col(replicate).alias("replicate"))).alias("panel")


def _block_patterns(placed: DataFrame, drawn: DataFrame, known: DataFrame, first: int, span: int, most: int, k: int) -> DataFrame:
    """read_bootstrap_patterns() of the replicates first, …, first + span - 1: bit i x span + j is sample i's in replicate first + j."""
    m = [f"_m{w}" for w in range(-(-most * span // 63))]
    bit = F.col("_i") * span + F.col("replicate") - first
    once = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 63).cast("int"))
    per_read = drawn.where(F.col("replicate").between(first, first + span - 1)).distinct().join(placed.select("_row", "_i"), "_row")
    per_read = per_read.groupBy("_row").agg(*[F.bit_or(F.when(F.floor(bit / 63) == w, once).otherwise(F.lit(0).cast("bigint"))).alias(x) for w, x in enumerate(m)])
    kmers = explode_kmers(placed.join(per_read, "_row"), "seq", k, "panel", *m)
    if k <= 31:
        kmers = kmers.withColumn("kmer", encode_2bit("kmer"))
    joint = kmers.groupBy("panel", "kmer").agg(*[F.bit_or(x).alias(x) for x in m]).groupBy("panel", *m).agg(F.count(F.lit(1)).alias("n"))
    each = joint.withColumn("replicate", F.explode(F.sequence(F.lit(first), F.lit(first + span - 1)))).join(known.withColumnRenamed("panel", "_panel"), F.col("panel").eqNullSafe(F.col("_panel")))
    held_at = lambda i: i * span + F.col("replicate") - first
    holds = lambda x, i: F.call_function("shiftrightunsigned", F.element_at(F.array(*m), (F.floor(held_at(i) / 63) + 1).cast("int")), (held_at(i) % 63).cast("int")).bitwiseAND(1) == 1
    held = each.select(_name("panel", "replicate"), F.filter("_names", holds).alias("pattern"), "n").where(F.size("pattern") > 0)
    return held.groupBy("panel", "pattern").agg(F.sum("n").alias("n"))


def _named(trees: DataFrame, *more: str | Column) -> DataFrame:
    of = F.from_json("panel", "panel string, replicate int")
    return trees.select(of["panel"].alias("panel"), of["replicate"].alias("replicate"), *more, "newick")


def read_bootstrap_trees(reads: DataFrame, replicates: int, seed: int, k: int, tables: int = 1, least: int = 1, by: str = "file", key: str = "read_id", options: Options | None = None) -> DataFrame:
    """(panel, replicate, resampled, newick) of reads (key, panel, sample, by, seq): both stages of the nonparametric bootstrap.

    resampled = 0: the tree of a replicate's resampled reads. 1 to `tables`: trees of that replicate's table of k-mers, resampled with as many rows as it has."""
    each = durable(read_bootstrap_patterns(reads, replicates, seed, k, least, by, key))
    first = _named(fit_trees(distances_of(pattern_shares(each), k), "panel", k, options), F.lit(0).alias("resampled"))
    second = bootstrap_trees(each, tables, seed + 1, k, thin=False, options=options).withColumnRenamed("replicate", "resampled")
    return first.unionByName(_named(second, "resampled"))


def _blocks(patterns: DataFrame) -> DataFrame:
    """(panel, pattern, n, block): the patterns in blocks of some BLOCK a panel, by their hash; computed once."""
    t = durable(patterns.where("panel is not null and n > 0").select("panel", "pattern", "n"))
    most = t.groupBy("panel").count().agg(F.max("count")).first()[0] or 0
    return t.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(max(1, -(-most // BLOCK)))).cast("int"))


def _drawn(blocks: DataFrame, replicates: int, seed: int, k: int | None) -> DataFrame:
    """(panel, replicate, block, pattern, n, _m): blocks with the number of rows that each replicate draws from each block, a multinomial draw over the blocks' totals."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        n = p["_n"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, int(p.replicate.iloc[0]), hash_of(p.panel.iloc[0])])
        return p.assign(_m=rng.multinomial(int(n.sum()) // (k or 1), n / n.sum()))[["panel", "replicate", "block", "_m"]]

    reps = blocks.groupBy("panel", "block").agg(F.sum("n").alias("_n")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draws = reps.groupBy("panel", "replicate").applyInPandas(run, "panel string, replicate int, block int, _m bigint").where("_m > 0")
    return spread(blocks.join(draws, ["panel", "block"]), "panel", "replicate", "block")


def _within(p: pd.DataFrame, seed: int) -> pd.DataFrame:
    """A block's patterns with the times each is drawn: a multinomial draw within the block, so that with the draw over blocks it is one over all."""
    p = p.sort_values("pattern", key=lambda c: c.map(lambda x: "\x00".join(x)))
    n = p.n.to_numpy(np.int64)
    rng = np.random.default_rng([seed, int(p.replicate.iloc[0]), hash_of(p.panel.iloc[0]), int(p.block.iloc[0])])
    p = p.assign(n=rng.multinomial(int(p["_m"].iloc[0]), n / n.sum()))
    return p[p.n > 0]


def pattern_weights(patterns: DataFrame, replicates: int, seed: int, k: int | None = None) -> DataFrame:
    """(panel, replicate, pattern, n): rows of a shared or total table drawn with replacement, as many as it has, or rows / k if k is given.

    No task has more than a block of a panel's patterns. Rows with a null panel are left out."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return _within(p, seed)[["panel", "replicate", "pattern", "n"]]

    return _drawn(_blocks(patterns), replicates, seed, k).groupBy("panel", "replicate", "block").applyInPandas(run, "panel string, replicate int, pattern array<string>, n bigint")


def resampled_shares(patterns: DataFrame, replicates: int, seed: int, k: int, thin: bool = True, poisson: bool = True, totals: DataFrame | None = None) -> DataFrame:
    """(panel, replicate, s1, s2, nshare): pair_shares() of resampled tables; see bootstrap_trees()."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = _within(p, seed)
        names = sorted({s for x in p.pattern for s in x})
        place = {s: i for i, s in enumerate(names)}
        row = np.repeat(np.arange(len(p)), p.pattern.map(len).to_numpy(np.int64))
        col = np.array([place[s] for x in p.pattern for s in x], np.int64)
        i, j, cells = _product(row, col, p.n.to_numpy(np.int64), len(names))
        who = np.array(names, object)
        return pd.DataFrame({"panel": p.panel.iloc[0] if len(p) else None, "replicate": p.replicate.iloc[0] if len(p) else 0, "s1": who[i], "s2": who[j], "nshare": cells}, columns=["panel", "replicate", "s1", "s2", "nshare"])

    def alone(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = [int(np.random.default_rng([seed, r, hash_of(g), hash_of(s)]).poisson(m)) if m else 0 for g, r, s, m in zip(p.panel, p.replicate, p["sample"], p["mean"], strict=True)]
            yield pd.DataFrame({"panel": p.panel, "replicate": p.replicate, "s1": p["sample"], "s2": p["sample"], "nshare": np.array(n, np.int64)})

    schema = "panel string, replicate int, s1 string, s2 string, nshare bigint"
    blocks = _blocks(patterns)
    drawn = _drawn(blocks.where(F.size("pattern") > 1) if poisson else blocks, replicates, seed, k if thin else None)
    cells = drawn.groupBy("panel", "replicate", "block").applyInPandas(run, schema)
    held = blocks.select("panel", "n", F.size("pattern").alias("_held"), F.explode("pattern").alias("sample"))
    single = F.sum(F.when(F.col("_held") == 1, F.col("n")).otherwise(0))
    own = held.groupBy("panel", "sample").agg(single.alias("_single"), (F.sum("n") - single).alias("_shared"))
    if totals is not None:
        own = own.join(totals.select("panel", "sample", "ntotal"), ["panel", "sample"], "left").withColumn("_single", F.greatest(F.coalesce(F.col("ntotal") - F.col("_shared"), F.col("_single")), F.lit(0)))
    mean = F.col("_single") / (k if thin else 1) if poisson else F.lit(0.0)
    reps = own.select("panel", "sample", mean.cast("double").alias("mean"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    every = cells.unionByName(reps.mapInPandas(alone, schema))  # the samples' own rows also keep those that a replicate drew nothing of
    return every.groupBy("panel", "replicate", "s1", "s2").agg(F.sum("nshare").alias("nshare"))


def hash_of(text: str | None) -> int:
    """The same in every process, unlike hash()."""
    h = 1469598103934665603
    for b in (text or "").encode():
        h = (h ^ b) * 1099511628211 % (1 << 63)
    return h


def bootstrap_trees(patterns: DataFrame, replicates: int, seed: int, k: int, thin: bool = True, poisson: bool = True, options: Options | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(panel, replicate, newick): trees of resampled tables. thin draws rows / k; poisson adds Poisson(single / k) to each sample's total for the k-mers that only it holds,
    which are left out of the resampling. totals: published totals (panel, sample, ntotal), by which single is what a total has beyond the shared k-mers, and not what the table has;
    samples without one keep the table's. Patterns are drawn and multiplied in blocks; only a replicate's matrix of samples meets in one task. A panel of one sample has no tree."""
    shares = resampled_shares(patterns, replicates, seed, k, thin, poisson, totals)
    each = shares.select(F.to_json(F.struct("panel", "replicate")).alias("panel"), "s1", "s2", "nshare")
    return _named(fit_trees(distances_of(each, k), "panel", k, options))


def pair_errors(pairs: DataFrame, tips: DataFrame, k: int, filtered: bool = False) -> DataFrame:
    """(panel, s1, s2, d, n, se) of pairs (panel, s1, s2, nshare, n1, n2) whose samples have a row in tips."""
    t = lambda i: tips.select("panel", *[F.col(c).alias(f"{c}{i}") for c in ("spname", "coverage", "readlength", "errorrate")])
    j = pairs.join(t(1).withColumnRenamed("spname1", "s1"), ["panel", "s1"]).join(t(2).withColumnRenamed("spname2", "s2"), ["panel", "s2"])
    first = F.col("n1") <= F.col("n2")
    pick = lambda c, a: F.when(first == a, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    of = lambda a: tuple(pick(c, a) for c in ("coverage", "readlength", "errorrate"))
    j = j.withColumn("d", distance(F.col("nshare"), F.col("n1"), F.col("n2"), k)).withColumn("n", F.least("n1", "n2"))
    return j.where(F.least("readlength1", "readlength2") >= k).select("panel", "s1", "s2", "d", "n", distance_error(F.col("d"), F.col("n"), of(True), of(False), k, filtered).alias("se"))


def parametric_distances(errors: DataFrame, replicates: int, seed: int, *keep: str) -> DataFrame:
    """(panel, replicate, s1, s2, d, keep): distances with normal noise of their standard error, at least 0."""
    r = errors.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    noise = normal(seed, F.col("panel"), F.col("replicate"), F.col("s1"), F.col("s2"))
    return r.select("panel", "replicate", "s1", "s2", F.greatest(F.lit(0.0), F.col("d") + F.col("se") * noise).alias("d"), *keep)


def cophenetic(newick: str, names: list[str]) -> np.ndarray:
    """Lengths of the paths between the tips of a tree, in the order of names."""
    d = np.zeros((len(names),) * 2)
    for side, length in split_table(parse(newick)[0]).items():
        held = np.isin(names, side)
        d += length * (held[:, None] != held[None, :])
    return d


def shared_path_covariance(d: np.ndarray, pairs: list[tuple[int, int]], n: np.ndarray, k: int) -> np.ndarray:
    """Covariance of pair distances: w / (k^2 sqrt(n1 n2)), with w from the length of the path that two pairs share."""
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    own = d[a, b]
    cross = d[np.ix_(a, a)] + d[np.ix_(a, b)] + d[np.ix_(b, a)] + d[np.ix_(b, b)]
    shared = np.maximum(0, 0.5 * (2 * (own[:, None] + own[None, :]) - cross))
    w = np.exp(shared * k) - 1 + sum(2 * (np.exp(shared * m) - 1) for m in range(1, k))
    return w / (k * k * np.sqrt(np.outer(n, n)))


def with_correlated_noise(names: list[str], d: np.ndarray, n: np.ndarray, k: int, rng: np.random.Generator, options: Options | None = None) -> np.ndarray:
    """d with normal noise, at least 0: by the lower Cholesky factor of the covariance over the paths of the tree that is fitted to d."""
    o = options or Options()
    paths = cophenetic(fit_tree(names, d, k, replace(o, decimals=max(12, o.decimals)))[0], names)
    every = list(combinations(range(len(names)), 2))
    if not every:
        return d.copy()
    i, j = (np.array(x) for x in zip(*every, strict=True))
    cov = shared_path_covariance(paths, every, n[i, j], k)
    values, vectors = np.linalg.eigh(cov)  # rounding may leave it slightly indefinite
    low = np.linalg.cholesky(vectors @ np.diag(np.maximum(values, 1e-12 * max(values.max(), 1e-12))) @ vectors.T + 1e-15 * np.eye(len(cov)))
    x = np.zeros_like(d)
    x[i, j] = x[j, i] = np.maximum(0, d[i, j] + low @ rng.standard_normal(len(cov)))
    return x


def parametric_trees(pairs: DataFrame, replicates: int, seed: int, k: int, options: Options | None = None) -> DataFrame:
    """(panel, replicate, newick) from (panel, s1, s2, d, n, se), in two stages a replicate: parametric_distances() stand for the reads' error, and to these comes
    the correlated noise of evolution, of which the covariance is that of the paths of the tree fitted to them. Without a column se the reads have no error."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*p.s1, *p.s2})
        place = {s: i for i, s in enumerate(names)}
        d, n = np.ones((len(names),) * 2), np.ones((len(names),) * 2)
        i, j = p.s1.map(place).to_numpy(), p.s2.map(place).to_numpy()
        d[i, j] = d[j, i] = p.d
        n[i, j] = n[j, i] = p.n
        np.fill_diagonal(d, 0)
        rng = np.random.default_rng([seed, int(p.replicate.iloc[0]), hash_of(p.panel.iloc[0])])
        x = with_correlated_noise(names, d, n, k, rng, options)
        return pd.DataFrame([(p.panel.iloc[0], p.replicate.iloc[0], fit_tree(names, x, k, options)[0])], columns=["panel", "replicate", "newick"])

    errors = pairs if "se" in pairs.columns else pairs.withColumn("se", F.lit(0.0))
    reps = parametric_distances(errors, replicates, seed, "n")
    return spread(reps, "panel", "replicate").groupBy("panel", "replicate").applyInPandas(run, "panel string, replicate int, newick string")
