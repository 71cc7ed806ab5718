"""Queries run on the miniature tables and agree with their SQL."""

import os

import pytest

import __spark_entry__ as entry
from strandweave.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
NAMES = ["kmer_counts", "distance_matrix", "merge_two_T", "tip_lengths", "parametric_se", "splits_frequency", "tree_distance_adjacent", "p6_found", "p6_loaded", "singletons", "kmer_counts_weighted", "kmer_filter_n2", "merge_marks", "merge_paired_rows", "merge_case_insensitive", "published_shares", "singletons_published", "coverage_bins", "ph_curve", "split_compatibility", "tree_distance_all", "nshare_matrix"]


def cells(rows, order):
    norm = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted(([norm(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    got = registry.queries()[name](spark, D)
    want = con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert cells([tuple(r) for r in got.collect()], [got.columns.index(c) for c in cols]) == cells(want.fetchall(), [want.columns.index(c) for c in cols])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["tree_fit", "consensus_tree", "parametric_bootstrap_correlated", "tip_trim"])
def test_iterative(spark, name):
    assert registry.queries()[name](spark, D).count() > 0


def test_copies_have_no_cap(spark):
    from collections import Counter, defaultdict

    coverage = {(r.panel, r.spname): r.coverage for r in registry._tips(spark, D).collect() if r.coverage and r.coverage > 0}
    held = defaultdict(Counter)
    for r in registry._counts(spark, D).collect():
        if c := coverage.get((r.panel, r["sample"])):
            held[r.panel, r["sample"]][max(1, int(r.cnt / c + 0.5))] += 1
    got = {(r.panel, r["sample"], r.copies): r.n for r in registry.queries()["coverage_bins"](spark, D).collect()}
    assert got == {(*key, x): n for key, h in held.items() for x, n in h.items()}
    assert max(x for _, _, x in got) > 1000
    ph = {(r.panel, r["sample"]): (r.size, r.ph) for r in registry.queries()["ph_curve"](spark, D).collect()}
    assert ph.keys() == held.keys()
    for key, h in held.items():
        size, e = sum(h.values()), 2.718281828459045**-2.1
        once = 1 - (1 - 2 * (0.5 - 0.38 + 0.38**2) ** 21) ** (size - 20)
        ph1 = 1 - sum((1 - e) ** x * n for x, n in h.items()) / size
        ph2, ph3 = (1 - e) * once, 0.5 * e * sum(once**x * n for x, n in h.items()) / size
        assert ph[key][0] == size
        assert abs(ph[key][1] - (ph1 + (1 - ph1) * ph2 + (1 - ph1) * (1 - ph2) * ph3)) < 2e-9


def test_no_merged_row_and_no_split_is_left_out(spark):
    held = {}
    for r in registry._counts(spark, D).collect():
        if ".sp" in r["sample"]:
            held.setdefault((r.kmer, r.panel), set()).add(r["sample"])
    rows = registry.queries()["merge_descending_order"](spark, D).collect()
    assert sorted((r.kmer, r.panel) for r in rows) == sorted(k for k, who in held.items() if len(who) > 1)
    kmers = [r.kmer for r in rows]
    assert kmers == sorted(kmers, reverse=True)
    by = {}
    for r in registry._masks(spark, D).collect():
        by.setdefault(r.panel, []).append(r.split)
    got = {(r.panel, r.a, r.b): r.ok for r in registry.queries()["split_compatibility"](spark, D).collect()}
    assert max(map(len, by.values())) > 12
    assert got == {(p, x, y): x & y in (0, x, y) or x | y == 1023 for p, m in by.items() for x in m for y in m if x < y}


def test_distances_of_fitted_trees(spark):
    from strandweave.operators.newick import parse, split_table

    q = registry.queries()
    tables = {(r.panel, r.replicate): split_table(parse(r.newick)[0]) for r in q["table_bootstrap"](spark, D).collect()}
    tables |= {(r.panel, 0): split_table(parse(r.newick)[0]) for r in q["tree_fit"](spark, D).collect()}
    panels = {p for (p, _), t in tables.items() if t}  # the control is a tree of one tip, without a branch
    n = registry.REPLICATES
    pairs = {"adjacent": [(i, i + 1) for i in range(1, n, 2)], "corresponding": [(0, i) for i in range(1, n + 1)], "all": [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]}
    for scheme, want in pairs.items():
        got = {(r.panel, r.replicate1, r.replicate2): r for r in q[f"fitted_tree_distance_{scheme}"](spark, D).collect()}
        assert got.keys() == {(p, *x) for p in panels for x in want}
        for (p, i, j), r in got.items():
            x, y = tables[p, i], tables[p, j]
            assert r.rf == len(x.keys() ^ y.keys())
            assert abs(r.branch_score - sum((x.get(k, 0) - y.get(k, 0)) ** 2 for k in x.keys() | y.keys()) ** 0.5) < 1e-8


def test_complexity(spark):
    got = {r.kmer: r.complexity for r in registry.queries()["kmer_complexity"](spark, D).collect()}
    some = sorted(got)[:: max(1, len(got) // 200)]
    assert all(got[k] == len({k[i:j] for i in range(21) for j in range(i + 1, 22)}) for k in some)


def test_no_sample_is_left_out(spark):
    control = registry.CONTROL
    wide = registry.queries()["kmer_matrix_wide"](spark, D)
    assert wide.where(f"{control} > 0").count() == registry._counts(spark, D).where(f"sample = '{control}' and cnt > 0").count() > 0
    assert [r[control] for r in registry.queries()["nshare_matrix"](spark, D).where(f"sample = '{control}'").collect()] == [registry._counts(spark, D).where(f"sample = '{control}'").count()]
