"""Products of presence patterns against plain counting."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from strandweave.operators import newick, sharing
from strandweave.plans.pipeline import distances_of, panel_trees


@pytest.mark.parametrize("large", [7, 1 << 51, 1 << 58])
def test_products_of_patterns(monkeypatch, large):
    monkeypatch.setattr(sharing, "TILE", 7)
    r = random.Random(large)
    names = [f"s{i}" for i in range(12)]
    rows = [(r.choice(["a", "b", None]), sorted(r.sample(names, r.randint(0, 6))), r.choice([1, 5])) for _ in range(300)] + [("a", ["s1", "s9"], large)]
    b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], ["panel", "pattern", "n"])
    want = Counter()
    for panel, held, n in rows + rows[100:137]:
        for i, x in enumerate(held):
            want.update({(panel, x, y): n for y in held[i:]})
    got = Counter()
    for out in sharing._gram(iter([b, b.slice(0, 0), b.slice(100, 37)])):
        for *key, n in zip(*[c.to_pylist() for c in out.columns], strict=True):
            got[tuple(key)] += n
    assert got == want


def test_shares_of_panels_with_nulls(spark):
    rows = [("p", "a", "x"), ("p", "b", "x"), ("p", "b", "x"), ("p", None, "x"), (None, "a", "x"), (None, "b", "x"), ("p", "b", "y"), ("q", "c", None)]
    t = spark.createDataFrame(rows, "panel string, sample string, kmer string")
    assert {tuple(r) for r in sharing.pair_shares(t).collect()} == {("p", "a", "a", 1), ("p", "a", "b", 1), ("p", "b", "b", 2), (None, "a", "a", 1), (None, "a", "b", 1), (None, "b", "b", 1), ("q", "c", "c", 1)}
    assert sharing.pair_shares(t.limit(0)).count() == 0


def test_patterns_of_many_samples(spark, monkeypatch):
    r = random.Random(5)
    rows = [(p, f"s{r.randrange(150):03d}", str(r.randrange(60))) for p in ("p", "q") for _ in range(2500)] + [("r", "one", "1"), ("r", "one", "1")]
    held = {}
    for p, x, k in rows:
        held.setdefault((p, k), set()).add(x)
    want = Counter((p, tuple(sorted(x))) for (p, _), x in held.items())
    t = spark.createDataFrame(rows, "panel string, sample string, kmer string")
    for name, value in (("WORDS", 16), ("WORDS", 1), ("BROADCAST", 0)):
        with monkeypatch.context() as m:
            m.setattr(sharing, name, value)
            assert {(x.panel, tuple(x.pattern)): x.n for x in sharing.patterns(t).collect()} == want


def test_samples_that_share_nothing_stay_in_distances_and_trees(spark):
    held = spark.createDataFrame([("p", x, c) for x, y in {"a": "123", "b": "234", "c": "345", "far": "89", "thin": "7"}.items() for c in y] + [("q", "x", "1"), ("q", "y", "2")], "panel string, sample string, kmer string")
    d = distances_of(sharing.pair_shares(held), 21)
    got = {(r.s1, r.s2): (r.nshare, r.n1, r.n2, r.d) for r in d.collect()}
    assert len(got) == 11
    assert got["a", "far"] == (0, 3, 2, 1.0)
    assert got["far", "thin"] == (0, 2, 1, 1.0)
    assert got["x", "y"] == (0, 1, 1, 1.0)
    assert got["a", "c"][0] == 1
    trees = {r.panel: r.newick for r in panel_trees(d, 21).collect()}
    assert sorted(newick.parse(trees["p"])[0].tips()) == ["a", "b", "c", "far", "thin"]
    assert sorted(newick.parse(trees["q"])[0].tips()) == ["x", "y"]
