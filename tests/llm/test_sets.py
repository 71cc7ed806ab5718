"""Distinct counts, overlaps, co-occurrence, frequencies and heavy items against brute force, with dirty rows."""

import math
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import cooccur, distinct, frequency, heavy, overlap

PAIR = str.maketrans("ACGT", "TGCA")
# the last columns clash with names that the operators use
SCHEMA = "rec_id bigint, panel string, sample string, file string, kmer string, cnt int, count_day date, loaded_at timestamp, h string, item string, term string, sketch string, hash string, amount string, sid string"
DAY = date(2009, 1, 5)


def canonical(k):
    return min(k, k.translate(PAIR)[::-1])


def make(seed=3, samples=12, per=400, days=6):
    rnd = random.Random(seed)
    kmer = lambda: "".join(rnd.choice("ACGT") for _ in range(21))
    shared = [kmer() for _ in range(150)]
    pools = {p: [kmer() for _ in range(250)] for p in ("p0", "p1", "controls")}
    rows, rec = [], 0
    for i in range(samples):
        panel = "controls" if i == 0 else f"p{i % 2}"
        name = "ctrl" if i == 0 else f"{panel}.sp{i}"
        n = per * 8 if i == 0 else per
        for _ in range(n):
            rec += 1
            k = rnd.choice(shared) if rnd.random() < 0.4 else rnd.choice(pools[panel]) if rnd.random() < 0.6 else kmer()
            k = k.translate(PAIR)[::-1] if rnd.random() < 0.3 else k
            k = k.lower() if rnd.random() < 0.1 else k
            cnt = None if rnd.random() < 0.03 else min(16383, int(rnd.paretovariate(0.7)))
            rows.append((rec, panel, name, "f", k, cnt, DAY + timedelta(days=rnd.randrange(days) * 12), datetime(2009, 1, 1)))
    rows += [(*r[:7], datetime(2009, 2, 2)) for r in rnd.sample(rows, 200)]
    rows += [(*r[:7], datetime(2009, 2, 2)) for r in rows[:1] * 3000]  # a group of copies
    bad = [("N" * 21), "ACGT", None, "", shared[0] + "\n", shared[0][:-1] + "-", "A" * 5000]
    rows += [(rec + 1 + i, "p0", "p0.sp2", "f", k, 5, DAY, None) for i, k in enumerate(bad)]
    rows += [(rec + 100, "p0", None, "f", shared[0], 9000, DAY, None), (rec + 101, None, "p0.sp2", "f", shared[1], 1, None, None)]
    rnd.shuffle(rows)
    return [(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def usable(rows):
    seen = {}
    for r in rows:
        k = (r[4] or "").upper()
        if r[2] is not None and len(k) == 21 and set(k) <= set("ACGT"):
            seen[r[0]] = (r[1], r[2], canonical(k), r[5], r[6])
    return list(seen.values())


def held(rows):
    s = defaultdict(set)
    for _, sample, k, _, _ in usable(rows):
        s[sample].add(k)
    return s


# --- distinct counts


def test_repeated_days(table, rows, empty, monkeypatch):
    by = defaultdict(lambda: defaultdict(set))
    for _, s, k, _, d in usable(rows):
        if d:
            by[s][d].add(k)
    want = set()
    for s, days in by.items():
        for d, ks in days.items():
            old = set().union(*(x for e, x in days.items() if d - timedelta(days=30) <= e < d))
            if 2 * len(ks - old) < len(ks):
                want.add((d.isoformat(), s))
    assert want
    assert {tuple(r) for r in distinct.repeated_days(table).collect()} == want
    assert {tuple(r) for r in distinct.repeated_days(table, m=16).collect()} == want  # nearly everything in doubt
    monkeypatch.setattr(distinct, "BROADCAST", 0)
    assert {tuple(r) for r in distinct.repeated_days(table, m=16).collect()} == want
    assert distinct.repeated_days(empty).count() == 0


def test_estimates_are_unbiased_within_their_error(spark):
    n, m = 20_000, 400
    df = spark.range(n * 40).select((F.col("id") % 40).alias("g"), F.xxhash64("id").alias("h"))
    e = [r.n_est for r in distinct.estimates(distinct.merge_sketches(distinct.build_sketches(df, ["g"], "h", m), ["g"]), ["g"], m).collect()]
    assert abs(np.mean(e) / n - 1) < 4 / np.sqrt(m * 40)
    assert 0.7 < np.std(e) / n * np.sqrt(m - 2) < 1.35


def test_merging_is_the_sketch_of_the_union(spark):
    a, b = spark.range(3000).select(F.lit(1).alias("g"), F.xxhash64("id").alias("h")), spark.range(1000, 9000).select(F.lit(1).alias("g"), F.xxhash64("id").alias("h"))
    build = lambda x: distinct.build_sketches(x, ["g"], "h", 64)
    apart = distinct.merge_sketches(build(a).unionByName(build(b.repartition(7))), ["g"]).first().sketch
    assert apart == distinct.merge_sketches(build(spark.range(9000).select(F.lit(1).alias("g"), F.xxhash64("id").alias("h"))), ["g"]).first().sketch


def test_rollup(table, rows, empty):
    exact = defaultdict(set)
    for p, s, k, _, d in usable(rows):
        for key in (("all",), ("sample", s), ("panel", p), ("day", d), ("panel_day", p, d)):
            if None not in key:
                exact[key].add(k)
    got = {}
    for r in distinct.distinct_rollup(table).collect():
        got[(r.level, *[x for x in (r.panel, r["sample"], r.count_day) if x is not None])] = r
    assert got.keys() == exact.keys()
    far = [abs(got[k].n_est / len(v) - 1) / got[k].rse for k, v in exact.items()]
    assert max(far) < 4.5
    assert all(r.n_low < r.n_est < r.n_high for r in got.values())
    assert distinct.distinct_rollup(empty).count() == 0


# --- overlaps and co-occurrence


def test_overlaps(table, rows, empty):
    s = held(rows)
    want = {(a, b, len(s[a] & s[b]), len(s[a]), len(s[b])) for a in s for b in s if a < b and s[a] & s[b]}
    got = overlap.sample_overlaps(table)
    assert {(r.s1, r.s2, r.shared, r.n1, r.n2) for r in got.collect()} == want
    assert {(r.s1, r.s2) for r in overlap.sample_overlaps(table, 48).collect()} == {(a, b) for a, b, n, x, y in want if 100 * n >= 48 * min(x, y)}
    assert overlap.sample_overlaps(empty).count() == 0


def test_products_across_blocks_chunks_and_flushes(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, c) for i in range(600) for c in rnd.sample(range(600), rnd.choice([1, 1, 2, 3, 90]))] + [(7, c) for c in range(600)] + [(None, 1), (1, None), (1, 1), (1, 1)]
    sets = defaultdict(set)
    for i, c in rows:
        if i is not None and c is not None:
            sets[c].add(i)
    items = np.array(sorted({r for r in rows if None not in r}))
    monkeypatch.setattr(overlap, "CHUNK", 500)
    monkeypatch.setattr(overlap, "HELD", 2)
    import pyarrow as pa

    parts = [pa.RecordBatch.from_arrays([pa.array(items[i : i + 97, 0]), pa.array(items[i : i + 97, 1].astype(np.int32))], ["a", "b"]) for i in range(0, len(items), 97)]
    blocks = pa.Table.from_batches(overlap._products(iter(parts))).sort_by([("bi", "ascending"), ("bj", "ascending")])
    got = {(r["i"], r["j"]): r["n"] for b in overlap._sums(iter(blocks.to_batches())) for r in b.to_pylist()}
    assert got == {(i, j): n for i in sets for j in sets if i <= j and (n := len(sets[i] & sets[j]))}
    df = spark.createDataFrame(rows, "item bigint, col int")
    assert {(r.i, r.j): r.n for r in overlap.pair_counts(df, "item", "col").collect()} == got


def test_cooccurrence(table, rows, empty, monkeypatch):
    monkeypatch.setattr(cooccur, "CHUNK", 50)
    rec, n = defaultdict(set), defaultdict(set)
    for p, s, k, _, _ in usable(rows):
        if p:
            rec[p, k].add(s)
            n[p].add(k)
    both, own = Counter(), Counter()
    for (p, _), ss in rec.items():
        own.update((p, x) for x in ss)
        both.update((p, a, b) for a in ss for b in ss if a < b)
    got = {(r.panel, r.s1, r.s2): r for r in cooccur.sample_cooccurrence(table).collect()}
    assert {k: r.n12 for k, r in got.items()} == dict(both)
    for (p, a, b), r in got.items():
        assert (r.n1, r.n2, r.n) == (own[p, a], own[p, b], len(n[p]))
        o = np.array([[r.n12, r.n1 - r.n12], [r.n2 - r.n12, r.n - r.n1 - r.n2 + r.n12]], float)
        e = np.outer(o.sum(1), o.sum(0)) / o.sum()
        g = 2 * sum(x * np.log(x / y) for x, y in zip(o.ravel(), e.ravel(), strict=True) if x)
        assert abs(abs(r.llr) - g) < 1e-6
        assert (r.llr < -1e-9) <= (r.lift < 1)
        assert abs(r.p_value - math.erfc(math.sqrt(abs(r.llr) / 2))) <= 1.3e-7 * r.p_value
        assert r.significant == (r.lift >= 1 and math.erfc(math.sqrt(g / 2)) <= cooccur.LEVEL)
    want = {k for k, r in got.items() if 100 * r.n12 * r.n >= 175 * r.n1 * r.n2}
    assert {(r.panel, r.s1, r.s2) for r in cooccur.more_than_chance(cooccur.sample_cooccurrence(table)).collect()} == want
    assert cooccur.sample_cooccurrence(empty).count() == 0
    first = {tuple(r) for r in cooccur.sample_cooccurrence(table).collect()}
    for name, value in (("WIDE", 2), ("HELD", 20), ("BROADCAST", 0)):
        with monkeypatch.context() as m:
            m.setattr(cooccur, name, value)
            assert {tuple(r) for r in cooccur.sample_cooccurrence(table).collect()} == first


def test_level_of_significance():
    assert abs(cooccur.critical_value(0.05) - 3.841459) < 1e-6
    assert abs(cooccur.critical_value(0.001) - 10.827566) < 1e-6


def test_wide_records_and_nulls(spark):
    rows = [("g", "r", f"i{j:03d}") for j in range(300)] + [("g", "q", "i000"), (None, "r", "i1"), ("g", None, "i1"), ("g", "r", None)]
    got = cooccur.cooccurrence(spark.createDataFrame(rows * 2, "grp string, rec string, item string"))
    assert got.count() == 300 * 299 // 2
    assert {(r.n12, r.n) for r in got.select("n12", "n").distinct().collect()} == {(1, 2)}


# --- frequencies and heavy items


def sums(rows):
    total, who = Counter(), defaultdict(set)
    for _, s, k, c, _ in usable(rows):
        total[k] += c or 0
        who[k].add(s)
    return total, who


def test_frequencies(table, rows, empty):
    total, who = sums(rows)
    n = len(held(rows))
    mark = lambda k: "rare" if len(who[k]) == 1 and total[k] <= 1 else "common" if 2 * len(who[k]) >= n else None
    got = {r.kmer: (r.occurrences, r.records, r.mark) for r in frequency.kmer_frequencies(table).collect()}
    assert got == {k: (total[k], len(who[k]), mark(k)) for k in who}
    assert {m for *_, m in got.values()} == {"rare", "common", None}
    assert frequency.kmer_frequencies(empty).count() == 0


def test_terms_with_nulls_and_any_number_of_parts(spark, monkeypatch):
    rows = [("a", "r1", 1, 1), ("a", "r1", 1, 1), ("a", "r1", 2, None), ("a", "r1", 3, None), ("a", "r2", None, 5), (None, "r", 1, 6), ("b", None, 1, 7), ("c", "r1", None, 8)]
    df = spark.createDataFrame(rows, "w string, r string, n int, id int")
    for parts, chunk in ((1, 400_000), (16, 1), (None, 3)):
        monkeypatch.setattr(frequency, "CHUNK", chunk)
        got = {r.term: (r.occurrences, r.records) for r in frequency.term_frequencies(df.repartition(2), "w", "r", "n", "id", parts).collect()}
        assert got == {"a": (6, 2), "c": (0, 1)}


def test_heaviest(table, rows, empty):
    total, _ = sums(rows)
    want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:20]
    got = heavy.heaviest_kmers(table).collect()
    assert sorted((r.kmer, r.total) for r in got) == sorted(want)
    assert heavy.heaviest_kmers(empty).count() == 0


def test_even_amounts_are_asked_of_the_sketch(spark, monkeypatch):
    df = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("i"), F.when(F.col("id") < 3, 4).otherwise(3).alias("n"), F.col("id").alias("d"))
    want = {("k0", 4), ("k1", 4), ("k2", 4), ("k10", 3), ("k100", 3)}
    first = heavy.heaviest(df, "i", "n", "d", 5).collect()
    assert {(r["item"], r.total) for r in first} == want
    monkeypatch.setattr(heavy, "MOST", 1 << 14)
    assert sorted(heavy.heaviest(df, "i", "n", "d", 5).collect()) == sorted(first)


def test_listed_candidates_are_those_of_the_sketch(table, rows, monkeypatch):
    first = heavy.heaviest_kmers(table).collect()
    for name in ("MAX_BROADCAST", "MOST"):
        with monkeypatch.context() as m:
            m.setattr(heavy, name, 10)
            assert sorted(heavy.heaviest_kmers(table).collect()) == sorted(first)
    rnd = np.random.default_rng(1)
    sketch = np.rint(rnd.normal(0, 30, (len(heavy.LEVELS), heavy.DEPTH, heavy.WIDTH)))
    h = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    for x in h[:40]:
        for i, bits in enumerate(heavy.LEVELS):
            for r in range(heavy.DEPTH):
                at, sign = heavy.slots(np.array([x >> np.uint64(64 - bits)]), bits, r)
                sketch[i, r, at] += sign * 5000
    p = heavy.heavy_prefixes(sketch, 3000.0)
    assert len(p) >= 40
    assert (heavy.is_heavy(sketch, 3000.0, h) == np.isin(h >> np.uint64(64 - heavy.LEVELS[-1]), p)).all()


def test_few_items_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 2, 1), ("b", 2, 2), ("c", None, 3), ("d", -5, 4), (None, 9, 5), ("e", 7, None), ("e", 7, None)], "i string, n int, d int")
    got = {r["item"]: r.total for r in heavy.heaviest(df, "i", "n", "d", 3).collect()}
    assert got == {"e": 14, "a": 2, "b": 2}


def test_rollup_by_sample_and_day(table, rows):
    exact = defaultdict(set)
    for _, s, k, _, d in usable(rows):
        if d is not None:
            exact[s, d].add(k)
    got = {(r["sample"], r.count_day): r for r in distinct.distinct_rollup(table, sample_days=True).where("level = 'sample_day'").collect()}
    assert got.keys() == exact.keys()
    assert max(abs(got[k].n_est / len(v) - 1) / got[k].rse for k, v in exact.items()) < 4.5
