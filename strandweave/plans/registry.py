"""Queries over the given tables for every operator of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions import formulas
from strandweave.functions.dense import dense_ids
from strandweave.functions.kmers import canonical, complexity, decode_2bit, encode_2bit, reverse_complement, usable_codes
from strandweave.operators import bootstrap, consensus, counting, merging, newick, rejects, sharing, tips, treedist, treefit
from strandweave.plans.durable import durable
from strandweave.plans.pipeline import distances_of, genome_sizes, panel_trees
from strandweave.sources import tables
from strandweave.streaming.counts import counts_table, stream_counts, stream_reads

Query = Callable[[SparkSession, str], DataFrame]

K, SEED, REPLICATES = 21, 7, 5
SPS = [f"sp{i}" for i in range(1, 11)]
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
CONTROL = "ctrl_mix"
GC, DISTANCE = 0.38, 0.1


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _reads(s: SparkSession, d: str) -> DataFrame:
    return counting.distinct_reads(_t(s, d, "seq_reads"))


def _drawn(s: SparkSession, d: str) -> DataFrame:
    """The reads as a resample draws them: each none, one or two times."""
    return _reads(s, d).withColumn("draws", F.pmod("read_id", F.lit(3)))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return counting.summed_counts(_t(s, d, "kmer_t"))


def _held(s: SparkSession, d: str) -> DataFrame:
    """(panel, sample, kmer BIGINT), repeated: who holds what needs no counts."""
    return usable_codes(_t(s, d, "kmer_t"), "panel", "sample").withColumnRenamed("code", "kmer")


def _merged(rules: str, *keys: str, **more) -> Query:
    """Merge of each panel's ten samples; the control, which belongs to no panel's ten, is none of the inputs."""

    def q(s: SparkSession, d: str) -> DataFrame:
        number = F.when(F.col("sample").startswith(F.concat("panel", F.lit(".sp"))), F.element_at(F.split("sample", r"\.sp"), -1).try_cast("int"))
        return merging.merge_long(_counts(s, d).withColumn("number", number), ["panel", "kmer"], "cnt", "number", rules, **more)

    return q


def _lane(s: SparkSession, d: str, i: int) -> DataFrame:
    return _t(s, d, "kmer_t").where(F.col("sample").isNotNull() & F.col("kmer").isNotNull() & F.col("file").contains(f"lane{i}"))


def _shares(s: SparkSession, d: str) -> DataFrame:
    return sharing.pair_shares(_held(s, d), _t(s, d, "kmer_t"))


def _distances(s: SparkSession, d: str) -> DataFrame:
    return distances_of(_shares(s, d), K)


def _masks(s: SparkSession, d: str) -> DataFrame:
    """(panel, split BIGINT, weight): presence patterns as bitmaps of sp1 to sp10, turned to the side without sp1, at least two samples on either side."""
    bits = F.aggregate(F.transform("pattern", lambda x: F.pow(F.lit(2.0), F.element_at(F.split(x, r"\.sp"), -1).cast("int") - 1).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    side = F.when(F.col("m").bitwiseAND(1) == 1, 1023 - F.col("m")).otherwise(F.col("m"))
    panels = _held(s, d).where(F.col("sample").startswith(F.concat("panel", F.lit(".sp"))))  # the control is alone in its panel, so it has no split
    p = sharing.patterns(panels).select("panel", bits.alias("m"), "n").select("panel", side.alias("split"), "n")
    return p.where(F.bit_count("split").between(2, 8)).groupBy("panel", "split").agg(F.sum("n").alias("weight"))


def _compatibility(s: SparkSession, d: str) -> DataFrame:
    t = durable(_masks(s, d))
    j = t.select("panel", F.col("split").alias("a")).join(t.select("panel", F.col("split").alias("b")), "panel").where("a < b")
    return j.withColumn("ok", consensus.compatible_masks(F.col("a"), F.col("b"), F.lit(1023)))


def _censored(s: SparkSession, d: str) -> DataFrame:
    t = _masks(s, d).withColumn("trees", F.sum("weight").over(W.partitionBy("panel")))
    w, n = F.col("weight"), F.col("trees")
    return t.select("panel", "split", "weight", "trees", consensus.censored(w, n, "mr").alias("mr"), consensus.censored(w, n, "ml", 0.05).alias("ml"), consensus.censored(w, n, "strict").alias("strict"))


def _mask_trees(s: SparkSession, d: str) -> DataFrame:
    """(id, split, length): each panel's weighted splits; panels are numbered in order of their names."""
    t = durable(_masks(s, d)).withColumn("length", F.col("weight") / F.sum("weight").over(W.partitionBy("panel")))
    return t.join(dense_ids(t, "panel", "id"), "panel").select("id", "split", "length")


def _tree_distance(scheme: str) -> Query:
    def q(s: SparkSession, d: str) -> DataFrame:
        t = _mask_trees(s, d)
        t2 = t.where("length >= 0.01") if scheme == "corresponding" else t
        pairs = treedist.pair_ids(t.select("id").distinct(), scheme)
        if scheme == "corresponding":  # each tree against its own well-supported splits
            both = t.withColumn("id", F.col("id") * 2).unionByName(t2.withColumn("id", F.col("id") * 2 + 1))
            pairs = pairs.select((F.col("id1") * 2).alias("id1"), (F.col("id2") * 2 + 1).alias("id2"))
            t = both
        return treedist.split_distance(t, pairs).withColumn("branch_score", F.round("branch_score", 9))

    return q


def _fitted_distance(scheme: str) -> Query:
    """Distances of resampled trees of one panel, with their replicates: of all pairs, of those that follow one another, or of each with the panel's fitted tree (replicate 0)."""

    def q(s: SparkSession, d: str) -> DataFrame:
        t = _boot(s, d)
        if scheme == "corresponding":
            t = t.unionByName(_trees(s, d).select("panel", F.lit(0).alias("replicate"), "newick"))
        t = durable(t)
        span = REPLICATES + REPLICATES % 2 + 2  # even, so that no pair of neighbours is of two panels
        numbered = durable(t.join(dense_ids(t, "panel", "p"), "panel").select("panel", "replicate", "newick", (F.col("p") * span + F.col("replicate") - (0 if scheme == "corresponding" else 1)).alias("id")))
        splits = newick.splits(numbered, "panel", "id")
        if scheme == "all":
            out = treedist.all_distances(splits, "panel").drop("panel")
        else:
            pairs = treedist.pair_ids(numbered, "adjacent") if scheme == "adjacent" else numbered.where("replicate > 0").select((F.col("id") - F.col("replicate")).alias("id1"), F.col("id").alias("id2"))
            out = treedist.split_distance(splits, pairs.select("id1", "id2"))
        of = lambda i: numbered.select(F.col("id").alias(f"id{i}"), *(["panel"] if i == 1 else []), F.col("replicate").alias(f"replicate{i}"))
        return out.withColumn("branch_score", F.round("branch_score", 9)).join(of(1), "id1").join(of(2), "id2").drop("id1", "id2")

    return q


def _genome_size(s: SparkSession, d: str) -> DataFrame:
    return genome_sizes(_reads(s, d), K).withColumn("genome_size", F.round("genome_size", 4))


def _tips(s: SparkSession, d: str) -> DataFrame:
    return tips.tip_table(_t(s, d, "tip_info"))


def _tip_lengths(s: SparkSession, d: str) -> DataFrame:
    return tips.tip_lengths(_tips(s, d), K)


def _totals(s: SparkSession, d: str) -> DataFrame:
    return counting.diversity(_counts(s, d), "panel", "sample")


def _copies(s: SparkSession, d: str) -> DataFrame:
    """(panel, sample, copies): how often a k-mer occurs in its genome, by its count as a multiple of the sample's coverage."""
    c = _counts(s, d).join(_tips(s, d).select("panel", F.col("spname").alias("sample"), "coverage"), ["panel", "sample"]).where("coverage > 0")
    return c.select("panel", "sample", tips.copies(F.col("cnt"), F.col("coverage")).alias("copies"))


def _bins(s: SparkSession, d: str) -> DataFrame:
    return tips.copy_bins(_copies(s, d), "panel", "sample")


def _errors(filtered: bool) -> Query:
    return lambda s, d: bootstrap.pair_errors(_distances(s, d), _tips(s, d), K, filtered).select("panel", "s1", "s2", F.round("d", 9).alias("d"), F.round("se", 9).alias("se"))


def _trees(s: SparkSession, d: str) -> DataFrame:
    return panel_trees(_distances(s, d), K)


def _trimmed(s: SparkSession, d: str) -> DataFrame:
    by = tips.tip_average(_tip_lengths(s, d), _totals(s, d))
    return newick.trimmed(_trees(s, d).join(by, "panel"), "tip_ave", "panel", "tip_ave")


def _patterns(s: SparkSession, d: str) -> DataFrame:
    return sharing.patterns(_held(s, d), _t(s, d, "kmer_t"))


def _boot(s: SparkSession, d: str) -> DataFrame:
    return bootstrap.bootstrap_trees(_patterns(s, d), REPLICATES, SEED, K)


def _user_trees(s: SparkSession, d: str) -> DataFrame:
    """Lengths of each panel's resampled topologies, fitted to the panel's own distances."""
    return treefit.fit_user_trees(_distances(s, d), _boot(s, d).withColumnRenamed("replicate", "tree"), "panel", K)


def _noisy(s: SparkSession, d: str, filtered: bool = False) -> DataFrame:
    e = bootstrap.pair_errors(_distances(s, d), _tips(s, d), K, filtered)
    return bootstrap.parametric_distances(e, REPLICATES, SEED)


def _noisy_trees(s: SparkSession, d: str) -> DataFrame:
    n = _noisy(s, d).withColumn("key", F.concat_ws("#", "panel", "replicate"))
    f = treefit.fit_trees(n, "key", K)
    return f.select(F.split("key", "#")[0].alias("panel"), F.split("key", "#")[1].cast("int").alias("replicate"), "newick")


def _read_trees(s: SparkSession, d: str) -> DataFrame:
    r = _t(s, d, "seq_reads").where(F.col("read_id").isNotNull() & F.col("sample").contains(".")).select("read_id", "sample", "file", "seq").distinct()
    return bootstrap.read_bootstrap_trees(r.withColumn("panel", F.substring_index("sample", ".", 1)), REPLICATES, SEED, K)


def _stream(s: SparkSession, d: str) -> DataFrame:
    schema = "sample string, file string, read_id bigint, name string, comment string, seq string, qual string"
    return counts_table(stream_counts(stream_reads(s, f"{d}/seq_reads.parquet", schema), K, once=True))


def queries() -> dict[str, Query]:
    c, r = _counts, _reads
    round9 = lambda df, *cols: df.withColumns({x: F.round(x, 9) for x in cols})
    return {
        # sources and loading
        "p6_found": lambda s, d: rejects.rejects(_t(s, d, "sequence_raw"), _t(s, d, "seq_reads")),
        "p6_loaded": lambda s, d: rejects.loaded(_t(s, d, "sequence_raw"), _t(s, d, "seq_reads")),
        # k-mers of reads
        "kmer_counts": lambda s, d: counting.count_kmers(r(s, d), K),
        "kmer_counts_wide_k": lambda s, d: counting.count_kmers(r(s, d), 33),
        "kmer_diversity": lambda s, d: counting.diversity(counting.count_kmers(r(s, d), K)),
        "kmer_counts_weighted": lambda s, d: counting.count_kmers(_drawn(s, d), K, weight="draws"),
        "kmer_filter_n2": lambda s, d: counting.count_kmers(_drawn(s, d), K, least=2, weight="draws"),
        "kmer_special_filter": lambda s, d: counting.count_kmers(r(s, d), K, special=True),
        "kmer_special_filter_inverse": lambda s, d: counting.count_kmers(r(s, d), K, special=False),
        "kmer_complexity": lambda s, d: counting.count_kmers(r(s, d), K).select("kmer").distinct().withColumn("complexity", complexity("kmer", K)),
        "kmer_limit": lambda s, d: counting.count_kmers(r(s, d), K, limit=100),
        "kmer_histogram": lambda s, d: counting.abundance(c(s, d)),
        "kmer_stream": _stream,
        "read_stats": lambda s, d: round9(counting.read_statistics(r(s, d)), "gc"),
        "gc_content": lambda s, d: round9(counting.read_statistics(r(s, d)).select("sample", "gc"), "gc"),
        "genome_size": _genome_size,
        "canonical_kmers": lambda s, d: _t(s, d, "kmer_t").where("kmer is not null").select(canonical(F.upper("kmer")).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")),
        "fasta_records": lambda s, d: tables.fasta_text(_t(s, d, "seq_reads").select("read_id", "name", "comment", "seq").distinct()),
        "revcomp": lambda s, d: _t(s, d, "seq_reads").where("seq is not null").select("read_id", "seq").distinct().select("read_id", reverse_complement(F.upper("seq")).alias("rc")),
        "kmer_codes": lambda s, d: c(s, d).select("kmer").distinct().withColumn("code", encode_2bit("kmer")).withColumn("back", decode_2bit("code", K)),
        # tables of k-mers
        "shared_kmer_table": lambda s, d: sharing.shared_table(c(s, d)),
        "total_kmer_table": lambda s, d: sharing.total_table(c(s, d)),
        "kmer_matrix_wide": lambda s, d: sharing.wide_matrix(c(s, d).withColumn("sp", F.element_at(F.split("sample", r"\."), -1)), [*SPS, CONTROL]),
        "kmer_presence": lambda s, d: merging.present(c(s, d), 2).select("panel", "sample", "kmer", "present"),
        "published_totals": lambda s, d: sharing.published_totals(_t(s, d, "kmer_wc")),
        "singletons_published": lambda s, d: sharing.singletons_of_totals(c(s, d), sharing.published_totals(_t(s, d, "kmer_wc")), K),
        "singletons": lambda s, d: sharing.singletons(c(s, d), K),
        # merges
        "merge_all_A": _merged("A" * 10),
        "merge_none_N": _merged("A" + "N" * 9),
        "merge_any_O": _merged("O" * 9 + "E"),
        "merge_two_T": _merged("T" * 10),
        "merge_optional_E": _merged("A" + "E" * 9),
        "merge_marks": _merged("E" * 10, default=0, marks=True),
        "merge_case_insensitive": lambda s, d: merging.merge_tables([_lane(s, d, i) for i in (1, 2, 3)], ["kmer"], "cnt", "AAE", "c"),
        "merge_numeric": lambda s, d: merging.merge_tables([_t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").alias("v")), _t(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))], ["k"], "v", "AA", "n"),
        "merge_enum": lambda s, d: merging.merge_tables([_t(s, d, "orders").where(F.col("o_orderstatus") == x).select("o_custkey", "o_orderpriority", "o_orderkey") for x in "OF"], ["o_custkey", "o_orderpriority"], "o_orderkey", "EE", "ne", order=PRIORITIES),
        "merge_descending_order": lambda s, d: _merged("T" * 10)(s, d).orderBy(*merging.sort_order(["kmer", "panel"], "Ss")),
        "merge_paired_rows": lambda s, d: merging.merge_long(_t(s, d, "lineitem").withColumn("number", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2)), ["l_suppkey"], "l_extendedprice", "number", "AA", paired=True),
        "merge_one_to_many": lambda s, d: merging.merge_rows(_tips(s, d).select("panel", F.col("spname").alias("sample"), "coverage"), c(s, d), ["panel", "sample"]).groupBy("panel", "sample", "coverage").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt")),
        # pairs and distances
        "pair_shared_counts": lambda s, d: _shares(s, d).where("s1 < s2"),
        "distance_matrix": lambda s, d: round9(_distances(s, d), "d"),
        "fit_weights": lambda s, d: _distances(s, d).select("panel", "s1", "s2", F.round(formulas.fit_weight(F.col("d"), K), 9).alias("w")),
        "nshare_matrix": lambda s, d: sharing.share_matrix(_shares(s, d), [*SPS, CONTROL]),
        "published_shares": lambda s, d: sharing.published_matrix(_t(s, d, "test_nshare"), SPS, "panel", "row_no"),
        "coverage_bins": _bins,
        "ph_curve": lambda s, d: round9(tips.ph_of_groups(_bins(s, d), ["panel", "sample"], K, GC, DISTANCE), "ph"),
        # tips and errors
        "tip_lengths": lambda s, d: round9(_tip_lengths(s, d), "l", "tip", "tip_filtered"),
        "tip_average": lambda s, d: round9(tips.tip_average(_tip_lengths(s, d), _totals(s, d)), "tip_ave"),
        "parametric_se": _errors(False),
        "parametric_se_filtered": _errors(True),
        # splits
        "splits_frequency": _masks,
        "split_compatibility": _compatibility,
        "consensus_censor": _censored,
        "tree_distance_adjacent": _tree_distance("adjacent"),
        "tree_distance_corresponding": _tree_distance("corresponding"),
        "tree_distance_all": lambda s, d: treedist.all_distances(_mask_trees(s, d).withColumn("grp", F.lit("all")), "grp").select("id1", "id2", "rf", F.round("branch_score", 9).alias("branch_score")),
        "fitted_tree_distance_adjacent": _fitted_distance("adjacent"),
        "fitted_tree_distance_corresponding": _fitted_distance("corresponding"),
        "fitted_tree_distance_all": _fitted_distance("all"),
        # trees, by iteration or at random: tested in tests/
        "tree_fit": _trees,
        "tree_fit_evolution": lambda s, d: panel_trees(_distances(s, d), K, treefit.Options(evolution=True)),
        "tree_fit_jumbled": lambda s, d: panel_trees(_distances(s, d), K, treefit.Options(everywhere=True, jumbles=3, seed=SEED)),
        "tree_fit_negative": lambda s, d: panel_trees(_distances(s, d), K, treefit.Options(negative=True)),
        "tree_user_lengths": _user_trees,
        "tree_rerooted": lambda s, d: newick.rerooted(_trees(s, d).withColumn("tip", F.concat("panel", F.lit(".sp5"))), "tip", "panel"),
        "tree_edges": lambda s, d: newick.edges(_trees(s, d), "panel"),
        "tree_splits": lambda s, d: newick.splits(_trees(s, d), "panel"),
        "tree_paths": lambda s, d: round9(treedist.path_lengths(newick.splits(_trees(s, d), "panel"), _distances(s, d)), "path"),
        "tree_fit_report": lambda s, d: round9(treedist.fit_report(newick.splits(_trees(s, d), "panel"), _distances(s, d), K), "ss", "percent_sd"),
        "tip_trim": _trimmed,
        "tree_tip_problems": lambda s, d: newick.tip_problems(_boot(s, d), "panel", "replicate"),
        "consensus_listing": lambda s, d: consensus.split_listing(_boot(s, d), "panel"),
        "table_bootstrap": _boot,
        "table_bootstrap_full": lambda s, d: bootstrap.bootstrap_trees(_patterns(s, d), REPLICATES, SEED, K, thin=False, poisson=False),
        "table_bootstrap_published": lambda s, d: bootstrap.bootstrap_trees(_patterns(s, d), REPLICATES, SEED, K, totals=sharing.published_totals(_t(s, d, "kmer_wc"))),
        "bootstrap_table_weights": lambda s, d: bootstrap.pattern_weights(_patterns(s, d), REPLICATES, SEED),
        "consensus_tree": lambda s, d: consensus.consensus_trees(_boot(s, d), "panel"),
        "consensus_majority": lambda s, d: consensus.consensus_trees(_boot(s, d), "panel", "mr"),
        "consensus_fraction": lambda s, d: consensus.consensus_trees(_boot(s, d), "panel", "ml", 0.7),
        "consensus_strict": lambda s, d: consensus.consensus_trees(_boot(s, d), "panel", "strict"),
        "read_subsample": lambda s, d: bootstrap.subsample(r(s, d), 1000, SEED),
        "read_bootstrap": lambda s, d: bootstrap.bootstrap_reads(_t(s, d, "seq_reads").dropDuplicates(["read_id"]).select("read_id", "sample", "file", "seq"), SEED),
        "read_bootstrap_trees": _read_trees,
        "read_bootstrap_consensus": lambda s, d: consensus.consensus_trees(_read_trees(s, d).where("resampled > 0"), "panel"),
        "parametric_distances": _noisy,
        "parametric_distances_filtered": lambda s, d: _noisy(s, d, True),
        "parametric_bootstrap": _noisy_trees,
        "parametric_bootstrap_correlated": lambda s, d: bootstrap.parametric_trees(bootstrap.pair_errors(_distances(s, d), _tips(s, d), K), REPLICATES, SEED, K),
    }


# --- SQL -----------------------------------------------------------------------------------------------------------------------------------

_C = "least(upper(kmer), reverse(translate(upper(kmer), 'ACGT', 'TGCA')))"
_CNT = f"""u as (select panel, sample, rec_id, {_C} as kmer, max(cnt) as cnt from kmer_t where sample is not null and regexp_full_match(upper(kmer), '[ACGT]{{21}}') group by all),
c as (select panel, sample, kmer, least(coalesce(sum(cnt), 0), 16383)::bigint as cnt from u group by all)"""
_READS = "r as (select distinct read_id, sample, seq from seq_reads where sample is not null and read_id is not null)"


def _kmers(k: int, times: str = "1") -> str:
    return f"""{_READS}, runs as (select sample, {times} as m, unnest(regexp_split_to_array(translate(seq, 'acgt', 'ACGT'), '[^ACGT]+')) as run from r),
w as (select sample, m, substr(run, i::int, {k}) as f from (select sample, m, run, unnest(range(1, length(run) - {k - 2})) as i from runs where length(run) >= {k})),
t as (select sample, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) as kmer, least(sum(m), 16383)::bigint as cnt from w group by all)"""


_SPECIAL = " and ".join([f"length(kmer) - length(replace(kmer, '{b}', '')) between 2 and {K // 2}" for b in "ACGT"]) + " and not regexp_matches(kmer, 'A{5}|C{5}|G{5}|T{5}')"
_G = f"{_CNT}, g as (select panel, kmer, " + ", ".join(f"max(cnt) filter (where sample = panel || '.sp{i}') as v{i}" for i in range(1, 11)) + " from c group by all)"
_HAS = "(" + " + ".join(f"(v{i} is not null)::int" for i in range(1, 11)) + ")"
_IN = f"{_CNT}, h as (select * from c)"
_PAIR = f"""{_IN}, n as (select panel, sample, count(*) as n from h group by all),
p as (select a.panel, a.sample as s1, b.sample as s2, count(*) as nshare from h a join h b on a.panel = b.panel and a.kmer = b.kmer and a.sample < b.sample group by all)"""
_DIST = f"""{_PAIR}, e as (select p.panel, s1, s2, nshare, x.n as n1, y.n as n2, -ln(nshare::double / least(x.n, y.n)) / {K} as d from p join n x on x.panel = p.panel and x.sample = s1 join n y on y.panel = p.panel and y.sample = s2)"""
_TIP = "ti as (select panel, spname, r.coverage as coverage, r.readlength as readlength, r.errorrate as errorrate from (select panel, spname, min({'coverage': coverage, 'readlength': readlength, 'errorrate': errorrate}) as r from tip_info where spname is not null and coverage is not null and readlength is not null and errorrate is not null group by all))"
_WC = "wc as (select panel, sample, max_by(ntotal, pos)::bigint as ntotal from kmer_wc where panel is not null and sample is not null and ntotal is not null group by all)"
_L = f"(coverage / readlength * (readlength - {K} + 1))"


def _stats(src: str) -> str:
    """Adds l, q, pu, pf (present and correct, unfiltered and filtered) and art to a table with coverage, readlength and errorrate."""
    return f"""l1 as (select *, {_L} as l, pow(1 - errorrate, {K}) as q from {src}),
l2 as (select *, 1 - exp(-l) as pr, 1 - (1 + l) * exp(-l) as prf, l * (1 - q) as art from l1),
l3 as (select *, pr * (1 - (exp(-l * q) - exp(-l)) / pr) as pu, prf * (1 - (exp(-l * q) - (1 + l) * exp(-l)) / prf - q * l * exp(-l * q) / prf) as pf from l2)"""


_TIPS = f"{_TIP}, {_stats(f'(select * from ti where readlength >= {K} and coverage > 0)')}, tl as (select panel, spname, l, 0.5 / {K} * ln((pu + art) / (pu * pu)) as tip, 0.5 / {K} * ln(1 / pf) as tip_filtered from l3)"


def _se(filtered: bool) -> str:
    p, more, art = ("pf", "0", "0") if filtered else ("pu", f"(xl * (1 - pow(1 - xe / 3, {K} * d)))", "xart")
    return f"""with {_DIST}, {_TIP}, {_stats(f'(select * from ti where readlength >= {K})')},
j as (select e.*, case when n1 <= n2 then a.{p} else b.{p} end as xp, case when n1 <= n2 then b.{p} else a.{p} end as yp, case when n1 <= n2 then a.l else b.l end as xl, case when n1 <= n2 then a.errorrate else b.errorrate end as xe,
  case when n1 <= n2 then a.art else b.art end as xart, case when n1 <= n2 then a.readlength else b.readlength end as xr, least(n1, n2)::double as nn from e join l3 a on a.panel = e.panel and a.spname = s1 join l3 b on b.panel = e.panel and b.spname = s2),
m as (select *, nn * exp(-{K} * d) as kept, xp * yp as both_, {more} as more, {art} as art_, list_sum([m / {K}::double * greatest(0, 2 * (xr - {2 * K} + m + 1) / (xr - {K} + 1)) for m in range(1, {K})]) as ow from j),
v as (select *, kept * (both_ + more) as ms, kept * (both_ * (1 - both_) + more) as vs, nn * (xp + art_) as mt, nn * (xp * (1 - xp) * (1 + (xr - {K}) / xl) + art_ * (1 + ow)) as vt from m)
select panel, s1, s2, round(d, 9) as d, round(2 * sqrt(ln(1 + vs / (ms * ms)) + ln(1 + vt / (mt * mt))) / {K}, 9) as se from v"""


_MASK = f"""{_IN}, b as (select panel, kmer, sum(1 << (split_part(sample, '.sp', 2)::int - 1))::bigint as m from h where starts_with(sample, panel || '.sp') group by all),
s as (select panel, case when m & 1 = 1 then 1023 - m else m end as split from b), f as (select panel, split, count(*) as weight from s where bit_count(split) between 2 and 8 group by all)"""
_MTREE = f"""{_MASK}, t7 as (select panel, split, weight / sum(weight) over (partition by panel) as length from f),
ids as (select panel, row_number() over (order by panel) - 1 as id from (select distinct panel from t7)), mt as (select id, split, length from t7 join ids using (panel))"""
_CMP = """x as (select id1, id2, s, max(a) as a, max(b) as b from y group by all)
select id1, id2, sum((a is null or b is null)::int)::bigint as rf, round(sqrt(sum((coalesce(a, 0) - coalesce(b, 0)) ** 2)), 9) as branch_score from x group by all"""
_FLD = """(?:(?:"[^"]*")+|[^",]*)"""
_FIVE = ",".join([_FLD] * 5)


def _capture(n: int) -> str:
    f = "case when starts_with({x}, '\"') then replace({x}[2:-2], '\"\"', '\"') else {x} end"
    return f.format(x="regexp_extract(x, '^" + ",".join(f"({_FLD})" if i == n else _FLD for i in range(5)) + "$', 1)")


_RAW = f"""raws as (select distinct raw_id, raw from sequence_raw), x0 as (select raw_id, case when ends_with(coalesce(raw, ''), chr(13)) then left(raw, length(raw) - 1) else coalesce(raw, '') end as x from raws),
x1 as (select *, regexp_full_match(x, '{_FLD}(?:,{_FLD})*') as okq, regexp_full_match(x, '{_FIVE}') as okc from x0),
x2 as (select *, {", ".join(f"case when okc then {_capture(i)} end as f{i}" for i in range(5))} from x1),
x3 as (select *, case when not okq then 'quoting' when not okc then 'columns' when not regexp_full_match(f0, '[0-9]+') or length(ltrim(f0, '0')) > 19 or (length(ltrim(f0, '0')) = 19 and ltrim(f0, '0') > '9223372036854775807') then 'read_id'
 when f1 = '' then 'name' when not regexp_full_match(f3, '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]+') then 'seq' when f4 <> '' and (length(f4) <> length(f3) or not regexp_full_match(f4, '[!-~]+')) then 'qual' end as reason from x2),
s3 as (select distinct read_id, name, comment, seq, qual, case when seq is null or not regexp_full_match(seq, '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]+') then 'seq' when qual <> '' and (length(qual) <> length(seq) or not regexp_full_match(qual, '[!-~]+')) then 'qual' end as reason from seq_reads)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "p6_found": f"with {_RAW} select distinct 'sequence_raw' as src, raw_id as row_id, reason from x3 where reason is not null union all select distinct 'seq_reads', read_id, reason from s3 where reason is not null",
        "p6_loaded": f"with {_RAW} select 'sequence_raw' as src, f0::bigint as read_id, f1 as name, f2 as comment, f3 as seq, nullif(f4, '') as qual from x3 where reason is null union all select distinct 'seq_reads', read_id, name, comment, seq, nullif(qual, '') from s3 where reason is null",
        "kmer_counts": f"with {_kmers(K)} select * from t",
        "kmer_counts_wide_k": f"with {_kmers(33)} select * from t",
        "kmer_diversity": f"with {_kmers(K)} select sample, count(*) as ntotal from t group by all",
        "kmer_filter_n2": f"with {_kmers(K, 'read_id % 3')} select * from t where cnt >= 2",
        "kmer_counts_weighted": f"with {_kmers(K, 'read_id % 3')} select * from t",
        "kmer_special_filter": f"with {_kmers(K)} select * from t where {_SPECIAL}",
        "kmer_special_filter_inverse": f"with {_kmers(K)} select * from t where not ({_SPECIAL})",
        "kmer_complexity": f"with {_kmers(K)}, k as (select distinct kmer from t) select kmer, len(list_distinct(flatten([[substr(kmer, i::int, n::int) for i in range(1, {K + 2} - n)] for n in range(1, {K + 1})])))::int as complexity from k",
        "kmer_limit": f"with {_kmers(K)} select sample, kmer, cnt from (select *, row_number() over (partition by sample order by kmer) as n from t) where n <= 100",
        "kmer_histogram": f"with {_CNT} select sample, cnt as multiplicity, count(*) as n from c where cnt <= 10000 group by all",
        "kmer_stream": f"with {_kmers(K)} select * from t",
        "read_stats": f"with {_READS} select sample, count(*) as n_reads, sum(length(seq))::bigint as total_bp, min(length(seq)) as min_len, max(length(seq)) as max_len, (sum(length(seq)) // count(*))::bigint as mean_len, round(sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / nullif(sum(length(replace(seq, 'N', ''))), 0), 9) as gc from r where seq is not null group by sample",
        "gc_content": f"with {_READS} select sample, round(sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / nullif(sum(length(replace(seq, 'N', ''))), 0), 9) as gc from r where seq is not null group by sample",
        "genome_size": f"with {_kmers(K)}, k as (select sample, sum(cnt) as kmers, count(*) as kinds from t group by all), b as (select sample, sum(length(seq)) as bp, sum(length(seq)) // count(*) as ml from r where seq is not null group by sample) select sample, round(bp / (kmers / kinds * ml / (ml - {K} + 1)), 4) as genome_size from b join k using (sample) where ml >= {K}",
        "canonical_kmers": f"select {_C} as kmer, count(*) as n from kmer_t where kmer is not null group by 1".replace("'ACGT', 'TGCA'", "'ACGTU', 'TGCAA'"),
        "fasta_records": "select '>' || coalesce(name, '') || case when comment <> '' then ' ' || comment else '' end || chr(10) || seq as value from (select distinct read_id, name, comment, seq from seq_reads) where seq <> ''",
        "revcomp": "select distinct read_id, reverse(translate(upper(seq), 'ACGTU', 'TGCAA')) as rc from (select distinct read_id, seq from seq_reads where seq is not null)".replace("select distinct read_id, reverse", "select read_id, reverse"),
        "kmer_codes": f"with {_CNT} select distinct kmer, list_sum([(strpos('ACGT', substr(kmer, i::int, 1)) - 1)::bigint << (2 * (21 - i))::int for i in range(1, 22)])::bigint as code, kmer as back from c",
        "shared_kmer_table": f"with {_CNT}, s as (select panel, kmer from c group by all having count(*) >= 2) select panel, sample, kmer, cnt from c semi join s using (panel, kmer)",
        "total_kmer_table": f"with {_CNT} select panel, kmer, count(*) as n_samples, sum(cnt)::bigint as cnt from c group by all",
        "kmer_matrix_wide": f"with {_IN} select panel, kmer, " + ", ".join(f"coalesce(max(cnt) filter (where sample = panel || '.{x}'), 0) as {x}" for x in SPS) + f", coalesce(max(cnt) filter (where sample = '{CONTROL}'), 0) as {CONTROL} from h group by all",
        "kmer_presence": f"with {_CNT} select panel, sample, kmer, (cnt >= 2)::int as present from c",
        "singletons": f"with {_CNT}, k as (select panel, kmer, count(*) as n from c group by all) select panel, sample, (sum((n = 1)::int) // {K})::bigint as n from c join k using (panel, kmer) group by panel, sample",
        "merge_all_A": f"with {_G} select * from g where {_HAS} = 10",
        "merge_none_N": f"with {_G} select * from g where {_HAS} = 1 and v1 is not null",
        "merge_any_O": f"with {_G} select * from g where {_HAS} - (v10 is not null)::int >= 1",
        "merge_two_T": f"with {_G} select * from g where {_HAS} >= 2",
        "merge_optional_E": f"with {_G} select * from g where v1 is not null",
        "merge_marks": f"with {_G} select panel, kmer, " + ", ".join(f"coalesce(v{i}, 0) as v{i}, v{i} is not null as b{i}" for i in range(1, 11)) + f" from g where {_HAS} > 0",
        "merge_case_insensitive": "with k as (select lower(kmer) as kmer, " + ", ".join(f"max(cnt) filter (where contains(file, 'lane{i}')) as v{i}, bool_or(contains(file, 'lane{i}')) as b{i}" for i in (1, 2, 3)) + " from kmer_t where sample is not null and kmer is not null group by 1) select kmer, v1, v2, v3 from k where b1 and b2",
        "merge_numeric": "select o_orderkey::double as k, max(o_totalprice) as v1, max(l_quantity) as v2 from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey",
        "merge_enum": "select o_custkey::double as o_custkey, nullif(list_position([" + ", ".join(f"'{p}'" for p in PRIORITIES) + "], o_orderpriority), 0)::int as o_orderpriority, max(o_orderkey) filter (where o_orderstatus = 'O') as v1, max(o_orderkey) filter (where o_orderstatus = 'F') as v2 from orders where o_orderstatus in ('O', 'F') group by 1, 2",
        "merge_descending_order": f"with {_G} select * from g where {_HAS} >= 2",
        "merge_paired_rows": "with r as (select l_suppkey, l_returnflag as f, l_extendedprice as v, row_number() over (partition by l_suppkey, l_returnflag order by l_extendedprice desc) as i from lineitem) select a.l_suppkey, a.v as v1, b.v as v2 from r a join r b on a.l_suppkey = b.l_suppkey and a.i = b.i and a.f = 'A' and b.f = 'R'",
        "merge_one_to_many": f"with {_CNT}, {_TIP} select c.panel, sample, coverage, count(*) as n, sum(cnt)::bigint as cnt from ti join c on ti.panel = c.panel and spname = sample group by all",
        "pair_shared_counts": f"with {_PAIR} select * from p",
        "distance_matrix": f"with {_DIST} select panel, s1, s2, nshare, n1, n2, round(d, 9) as d from e",
        "fit_weights": f"with {_DIST} select panel, s1, s2, round(exp(-{K} * greatest(d, 1e-6)) / (1 - exp(-{K} * greatest(d, 1e-6))), 9) as w from e",
        "nshare_matrix": f"with {_PAIR}, z as (select panel, s1 as sample, s2 as o, nshare from p union all select panel, s2, s1, nshare from p union all select panel, sample, sample, n from n) select panel, sample, " + ", ".join(f"coalesce(max(nshare) filter (where o = panel || '.{x}'), 0) as {x}" for x in SPS) + f", coalesce(max(nshare) filter (where o = '{CONTROL}'), 0) as {CONTROL} from z group by all",
        "published_shares": "with o as (select *, row_number() over (partition by panel, row_no order by " + " + ".join(f"({x} is null)::int" for x in SPS) + ", " + ", ".join(f"coalesce({x}, -1)" for x in SPS) + ") as r from test_nshare where panel is not null and row_no is not null) select panel, row_no, " + ", ".join(SPS) + " from o where r = 1",
        "published_totals": f"with {_WC} select * from wc",
        "singletons_published": f"with {_CNT}, {_WC}, k as (select panel, kmer, count(*) as n from c group by all), x as (select panel, sample, count(*) as m from c join k using (panel, kmer) where n > 1 group by all) select wc.panel, wc.sample, (greatest(ntotal - coalesce(m, 0), 0) // {K})::bigint as n from wc left join x on x.panel = wc.panel and x.sample = wc.sample",
        "coverage_bins": f"with {_CNT}, {_TIP} select c.panel, sample, greatest(1, round(cnt / coverage))::bigint as copies, count(*) as n from c join ti on ti.panel = c.panel and spname = sample where coverage > 0 group by all",
        "ph_curve": f"""with {_CNT}, {_TIP}, k as (select c.panel, sample, greatest(1, round(cnt / coverage)) as x from c join ti on ti.panel = c.panel and spname = sample where coverage > 0),
z as (select panel, sample, count(*) as size, exp(-{K} * {DISTANCE}) as e, 2 * pow(0.5 - {GC} + {GC} * {GC}, {K}) as same from k group by all),
y as (select z.panel, z.sample, any_value(size) as size, any_value(e) as e, 1 - avg(pow(1 - e, x)) as ph1, any_value((1 - e) * (1 - pow(1 - same, size - {K} + 1))) as ph2, any_value(0.5 * e) * avg(pow(1 - pow(1 - same, size - {K} + 1), x)) as ph3 from k join z using (panel, sample) group by all)
select panel, sample, size, round(ph1 + (1 - ph1) * ph2 + (1 - ph1) * (1 - ph2) * ph3, 9) as ph from y""",
        "tip_lengths": f"with {_TIPS} select panel, spname, round(l, 9) as l, round(tip, 9) as tip, round(tip_filtered, 9) as tip_filtered from tl",
        "tip_average": f"with {_CNT}, {_TIPS}, n as (select panel, sample, count(*) as n from c group by all), j as (select tl.panel, spname, tip, n from tl join n on n.panel = tl.panel and sample = spname), w as (select *, count(*) over (partition by panel) as m, row_number() over (partition by panel order by n, spname) as i from j) select panel, max(m) as n_samples, round(sum(tip * (m - i)) / (max(m) * (max(m) - 1)), 9) as tip_ave from w where m > 1 group by panel",
        "parametric_se": _se(False),
        "parametric_se_filtered": _se(True),
        "splits_frequency": f"with {_MASK} select * from f",
        "split_compatibility": f"with {_MASK} select x.panel, x.split as a, y.split as b, (x.split & y.split) in (0, x.split, y.split) or (x.split | y.split) = 1023 as ok from f x join f y on x.panel = y.panel and x.split < y.split",
        "consensus_censor": f"with {_MASK}, n as (select *, sum(weight) over (partition by panel)::bigint as trees from f) select panel, split, weight, trees, weight * 2 > trees as mr, weight > trees * 0.05::double as ml, weight = trees as strict from n",
        "tree_distance_adjacent": f"with {_MTREE}, pr as (select a.id as id1, b.id as id2 from (select distinct id from mt) a join (select distinct id from mt) b on b.id = a.id + 1 and a.id % 2 = 0), y as (select id1, id2, split as s, length as a, null::double as b from pr join mt on id = id1 union all select id1, id2, split, null, length from pr join mt on id = id2), {_CMP}",
        "tree_distance_all": f"with {_MTREE}, i as (select distinct id from mt), pr as (select a.id as id1, b.id as id2 from i a join i b on a.id < b.id), y as (select id1, id2, split as s, length as a, null::double as b from pr join mt on id = id1 union all select id1, id2, split, null, length from pr join mt on id = id2), {_CMP}",
        "tree_distance_corresponding": f"with {_MTREE}, y as (select id * 2 as id1, id * 2 + 1 as id2, split as s, length as a, null::double as b from mt union all select id * 2, id * 2 + 1, split, null, length from mt where length >= 0.01), {_CMP}",
    }
    return out
