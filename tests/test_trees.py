"""Formulas, Newick text, fits, consensus and distances of trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import formulas
from strandweave.operators import consensus as C
from strandweave.operators import newick as N
from strandweave.operators import tips, treedist
from strandweave.operators import treefit as T
from strandweave.plans import pipeline


def test_distance_goldens(spark):
    rows = [("sp1,sp10", 24379, 165116, 165245, 0.090935), ("sp1,sp2", 3882, 165116, 166000, 0.178564), ("none", 0, 5, 6, 1.0)]
    got = spark.createDataFrame(rows, "p string, s bigint, a bigint, b bigint, d double").select("d", formulas.distance(F.col("s"), F.col("a"), F.col("b"), 21).alias("x")).collect()
    assert all(abs(r.d - r.x) < 2e-4 for r in got)
    w = lambda d: spark.range(1).select(formulas.fit_weight(F.lit(d), 21)).first()[0]
    assert abs(w(0.049627) - 0.544858) < 1e-4
    assert abs(w(0.178564) - 0.024088) < 1e-5
    assert w(0.0) == w(1e-7)


def test_tip_goldens(spark):
    rows = [("p", "sp1", 3.95, 76.0, 0.01), ("p", "sp8", 8.99, 76.0, 0.01), ("p", "sp10", 11.68, 76.0, 0.01), ("p", "short", 3.0, 20.0, 0.01), ("p", "none", None, 76.0, 0.01)]
    other = [("p", "two", 3.0, 90.0, 0.02), ("p", "two", 4.0, 80.0, 0.01)]  # copies that differ: a whole row counts
    whole = tips.tip_table(spark.createDataFrame(other, "panel string, spname string, coverage double, readlength double, errorrate double"))
    assert [tuple(r) for r in whole.collect()] == other[:1]
    t = tips.tip_table(spark.createDataFrame([*rows, rows[0]], "panel string, spname string, coverage double, readlength double, errorrate double"))
    got = {r.spname: r for r in tips.tip_lengths(t, 21).collect()}
    assert got.keys() == {"sp1", "sp8", "sp10"}
    assert abs(got["sp1"].l - 2.9105) < 1e-4
    for name, plain, filtered in (("sp1", 0.013734, 0.009112), ("sp8", 0.019592, 0.000720), ("sp10", 0.023128, 0.000179)):
        assert abs(got[name].tip - plain) < 1e-6
        assert abs(got[name].tip_filtered - filtered) < 1e-6
    totals = spark.createDataFrame([("p", "sp1", 5), ("p", "sp8", 7), ("p", "sp10", 9)], "panel string, sample string, ntotal bigint")
    ave = tips.tip_average(tips.tip_lengths(t, 21), totals).first().tip_ave
    assert abs(ave - (2 * got["sp1"].tip + got["sp8"].tip) / 6) < 1e-12


def test_newick_reads_and_writes():
    root, weight = N.parse("((a_b:1.5e-1,'c d':-.25)x:2,[a [nested] note]e:1)[0.5];")
    assert weight == 0.5
    assert root.tips() == ["a b", "c d", "e"]
    assert N.render(root, 2) == "((a_b:0.15,c_d:-0.25)x:2.00,e:1.00);"
    assert N.parse(N.render(root, 9))[0].tips() == root.tips()
    assert N.count_tips("(a,b,(c,d));") == 4
    for bad in ("(a,b", "a,b);", "", "(a,b))", "[x"):
        with pytest.raises(ValueError):
            N.parse(bad)
    deep = "(" * 5000 + "a" + ",b)" * 5000 + ";"
    assert len(N.parse(deep)[0].tips()) == 5001


def test_splits_and_rerooting():
    t = "((a:1,b:2):0.5,(c:1,d:1):0.5);"
    s = N.split_table(N.parse(t)[0])
    assert s == {("c", "d"): 1.0, ("b",): 2.0, ("c",): 1.0, ("d",): 1.0, ("b", "c", "d"): 1.0}
    for tip in "abcd":
        r = N.reroot(N.parse(t)[0], tip)
        assert r.children[0].name == tip
        assert N.split_table(r) == s
    with pytest.raises(ValueError):
        N.reroot(N.parse(t)[0], "z")
    assert N.split_table(N.trim_tips(N.parse(t)[0], 0.25))[("b",)] == 1.75


def random_tree(rng, n):
    nodes = [N.Node(f"t{i:02d}", float(rng.uniform(0.01, 0.1))) for i in range(n)]
    while len(nodes) > 3:
        i, j = sorted(rng.choice(len(nodes), 2, replace=False))
        b, a = nodes.pop(j), nodes.pop(i)
        nodes.append(N.Node(None, float(rng.uniform(0.01, 0.1)), [a, b]))
    return N.Node(children=nodes)


def matrix(root, names):
    d = np.zeros((len(names), len(names)))
    for s, x in N.split_table(root).items():
        m = np.array([n in s for n in names])
        d += x * (m[:, None] != m[None, :])
    return d


@pytest.mark.parametrize("n", [3, 4, 6, 9, 12])
@pytest.mark.parametrize("options", [T.Options(), T.Options(jumbles=2, everywhere=True), T.Options(negative=True)])
def test_additive_matrices_give_their_tree(n, options):
    root = random_tree(np.random.default_rng(n), n)
    names = [f"t{i:02d}" for i in range(n)]
    text, ss, _ = T.fit_tree(names, matrix(root, names), 21, options)
    a, b = N.split_table(root), N.split_table(N.parse(text)[0])
    assert a.keys() == b.keys()
    assert ss < 1e-6
    assert max(abs(a[k] - b[k]) for k in a) < 1e-4


def test_fit_of_small_groups_user_trees_and_evolution():
    d = np.array([[0, 0.2], [0.2, 0]])
    assert T.fit_tree(["a", "b"], d, 21)[0] == "(a:0.10000,b:0.10000);"
    assert T.fit_tree(["a"], d[:1, :1], 21)[0] == "a;"
    root = random_tree(np.random.default_rng(5), 6)
    names = [f"t{i:02d}" for i in range(6)]
    text, ss, _ = T.fit_tree(names, matrix(root, names), 21, user_tree=N.render(root))
    assert ss < 1e-6
    assert N.split_table(N.parse(text)[0]).keys() == N.split_table(root).keys()
    text, _, _ = T.fit_tree(names, matrix(root, names), 21, T.Options(evolution=True))
    assert N.split_table(N.parse(text)[0]).keys() == N.split_table(root).keys()
    rng = np.random.default_rng(1)
    noise = rng.uniform(0, 0.2, (8, 8))
    text, ss, _ = T.fit_tree([f"x{i}" for i in range(8)], np.triu(noise, 1) + np.triu(noise, 1).T, 21)
    assert min(N.split_table(N.parse(text)[0]).values()) >= 0


def test_non_negative_least_squares():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, y = rng.normal(size=(15, 6)), rng.normal(size=15)
        x = T.non_negative(a.T @ a, a.T @ y)
        slope = a.T @ y - a.T @ a @ x
        assert (x >= 0).all()
        assert np.abs(slope[x > 1e-9]).max(initial=0) < 1e-8
        assert slope.max() < 1e-8


def test_consensus_of_three_and_two(spark):
    one, two = "((a,b),(c,d),e);", "((a,c),(b,d),e);"
    trees = spark.createDataFrame([("g", one)] * 3 + [("g", two)] * 2 + [("h", one)] * 4 + [("g", None)], "grp string, newick string")
    found = lambda m, g: set(N.split_table(N.parse(next(r.newick for r in C.consensus_trees(trees, "grp", m).collect() if r.grp == g))[0], trivial=False))
    want = set(N.split_table(N.parse(one)[0], trivial=False))
    assert found("mre", "g") == found("mr", "g") == want
    assert found("strict", "g") == set()
    assert found("strict", "h") == want
    r = {x.grp: x for x in C.consensus_trees(trees, "grp").collect()}
    assert r["g"].n_trees == 5
    assert ":3.00" in r["g"].newick


def test_compatible(spark):
    s = lambda *x: frozenset(x)
    assert C.compatible(s(1), s(2))
    assert C.compatible(s(1, 2), s(1, 2, 3))
    assert not C.compatible(s(1, 2), s(2, 3))
    assert C.compatible(s(1, 2), s(2, 3), 3)
    row = spark.createDataFrame([(3, 6)], "a bigint, b bigint").select(C.compatible_masks(F.col("a"), F.col("b")).alias("x"), C.compatible_masks(F.col("a"), F.col("b"), F.lit(7)).alias("y")).first()
    assert (row.x, row.y) == (False, True)


def test_tree_distances(spark):
    ts = spark.createDataFrame([(0, "((a:1,b:1):2,(c:1,d:1):0,e:1);"), (1, "((a:1,b:1):2,(c:1,d:1):0,e:1);"), (2, "((a:1,b:1):2,c:1,(d:1,e:1):1);"), (3, "((a:1,c:1):1,b:1,(d:1,e:1):1);"), (4, "(a,b,(c,(d,e)));")], "id int, newick string")
    got = {(r.id1, r.id2): r for r in treedist.split_distance(N.splits(ts, "id"), treedist.pair_ids(ts, "adjacent")).collect()}
    assert set(got) == {(0, 1), (2, 3)}
    assert (got[0, 1].rf, got[0, 1].branch_score) == (0, 0.0)
    assert got[2, 3].rf == 2
    assert abs(got[2, 3].branch_score - 5**0.5) < 1e-12
    same = treedist.split_distance(N.splits(ts, "id"), treedist.pair_ids(ts, "corresponding"))
    assert {r.rf for r in same.collect()} == {0}
    assert N.edges(ts, "id").where("is_tip").count() == 25


def test_phylogeny_of_counts(spark):
    rows = [("p", s, f"k{i}", 1) for s, ks in {"a": range(0, 90), "b": range(10, 100), "c": range(50, 150), "d": range(60, 160)}.items() for i in ks]
    c = spark.createDataFrame(rows, "panel string, sample string, kmer string, cnt int")
    t = pipeline.phylogeny(c, 21).first()
    assert ("c", "d") in N.split_table(N.parse(t.newick)[0])
    s = pipeline.supported_phylogeny(c, 21, replicates=5).first()
    assert s.n_trees == 5
    assert sorted(N.parse(s.newick)[0].tips()) == list("abcd")
    assert pipeline.phylogeny(c.where("panel = 'none'"), 21).count() == 0


def test_all_distances_and_problems(spark):
    ts = spark.createDataFrame([("g", 0, "((a,b),(c,d),e);"), ("g", 1, "((a,b),c,(d,e));"), ("g", 10, "((a,c),(b,d),e);"), ("h", 2, "(a,a,b);"), ("h", 3, "(a,b,c);"), ("h", 4, None)], "grp string, id int, newick string")
    s = N.splits(ts.where("grp = 'g'"), "id")
    assert {(r.id1, r.id2): r.rf for r in treedist.all_distances(s.withColumn("g", F.lit(1)), "g").collect()} == {(0, 1): 2, (0, 10): 4, (1, 10): 4}
    apart = spark.createDataFrame([("g", 0, "x", 2.0), ("g", 1, "y", 1.0), ("g", 1, "z", 2.0), ("h", 2, "x", 5.0)], "g string, id int, split string, length double")
    assert [(r.g, r.id1, r.id2, r.rf, r.branch_score) for r in treedist.all_distances(apart, "g").collect()] == [("g", 0, 1, 3, 3.0)]
    assert {(r.id, r.name, r.problem) for r in N.tip_problems(ts, "grp", "id").collect()} == {(2, "a", "repeated"), (2, "c", "missing")}
    listing = {tuple(r.split): (r.weight, r.included) for r in C.split_listing(ts.where("id < 2"), "grp").collect()}
    assert listing[("c", "d", "e")] == (2.0, True)
    assert sorted(x for _, x in listing.values()) == [False, True, True]


def test_user_trees_and_outgroups(spark):
    names, text = "abcde", "((a:1,b:2):1,(c:1,d:3):2,e:1);"
    path = {("a", "b"): 3, ("a", "c"): 5, ("a", "d"): 7, ("a", "e"): 3, ("b", "c"): 6, ("b", "d"): 8, ("b", "e"): 4, ("c", "d"): 4, ("c", "e"): 4, ("d", "e"): 6}
    d = spark.createDataFrame([("g", *p, x / 100) for p, x in path.items()], "panel string, s1 string, s2 string, d double")
    given = [("g", 1, "((a,b),(c,d),e);"), ("g", 2, "((a,c),(b,d),e);"), ("g", 3, "(a,b,c);"), ("g", 4, None), ("g", 5, "(a,a,b,c,d,e);"), ("none", 6, text)]
    fits = {r.tree: r for r in T.fit_user_trees(d, spark.createDataFrame(given, "panel string, tree int, newick string"), "panel", 21).collect()}
    assert set(fits) == {1, 2, 3, 5}
    assert fits[3].newick is None and fits[5].ss is None
    assert fits[1].ss < 1e-9 < fits[2].ss
    want = N.split_table(N.parse(text)[0])
    assert all(abs(x * 100 - want[s]) < 1e-2 for s, x in N.split_table(N.parse(fits[1].newick)[0]).items())

    trees = spark.createDataFrame([(1, text, "d"), (2, text, "x"), (3, text, None), (4, None, "a"), (5, f"{text[:-1]};", "a")], "id int, newick string, tip string")
    hung = {r.id: r.newick for r in N.rerooted(trees, "tip", "id").collect()}
    assert [hung[i] for i in (2, 3, 4)] == [None] * 3
    for i, tip in ((1, "d"), (5, "a")):
        root = N.parse(hung[i])[0]
        assert root.children[0].name == tip
        assert N.split_table(root) == want
        assert sorted(root.tips()) == list(names)
    assert N.rerooted(trees.limit(0), "tip", "id").count() == 0


def test_paths_and_reports_are_those_of_the_fit(spark):
    from strandweave.operators.bootstrap import cophenetic

    rnd = random.Random(6)
    names = [f"s{i}" for i in range(7)]
    rows = [(g, a, b, 0.05 + rnd.random() / 10) for g in "pq" for i, a in enumerate(names) for b in names[i + 1 :]] + [("two", "a", "b", 0.2)]
    d = spark.createDataFrame(rows, "panel string, s1 string, s2 string, d double")
    trees = T.fit_trees(d, "panel", 21, T.Options(decimals=15))
    fits = {r.panel: r for r in trees.collect()}
    splits = N.splits(trees, "panel")
    for r in treedist.path_lengths(splits, d).collect():
        who = ["a", "b"] if r.panel == "two" else names
        assert abs(r.path - cophenetic(fits[r.panel].newick, who)[who.index(r.s1), who.index(r.s2)]) < 1e-12
    report = {r.panel: r for r in treedist.fit_report(splits, d, 21).collect()}
    assert {p: r.n_samples for p, r in report.items()} == {"p": 7, "q": 7, "two": 2}
    assert all(abs(r.ss - fits[p].ss) < 1e-9 and abs(r.percent_sd - fits[p].percent_sd) < 1e-6 for p, r in report.items())
    assert treedist.fit_report(splits, d.limit(0), 21).count() == 0


def test_greedy_choice_against_sets(spark):
    rnd = random.Random(9)
    tips = "abcdefg"
    table = {tuple(sorted(rnd.sample(tips[1:], rnd.randint(2, 5)))): float(rnd.randint(1, 6)) for _ in range(40)}
    for everyone in (len(tips), None):
        kept = []
        for s, w in sorted(table.items(), key=lambda x: (-x[1], x[0])):
            if all(C.compatible(set(s), set(t), everyone) for t, _ in kept):
                kept.append((s, w))
        df = spark.createDataFrame([("g", list(s), w, everyone) for s, w in table.items()], "grp string, split array<string>, weight double, tips int")
        assert {(tuple(r.split), r.weight) for r in C.chosen_splits(df, "grp").collect()} == set(kept)
        assert C.chosen_splits(df.limit(0), "grp").count() == 0
