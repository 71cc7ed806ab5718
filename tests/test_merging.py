import pytest

from strandweave.operators import merging as M


def tables(spark, *held):
    return [spark.createDataFrame([(k, v, "x") for k, v in h.items()], "k string, v int, extra string") for h in held]


SETS = ({"a": 1, "b": 2, "d": 4}, {"b": 20, "c": 30}, {"b": 200, "c": 300, "e": 500})


@pytest.mark.parametrize(("rules", "keys"), [("AAA", "b"), ("ANN", "ad"), ("OOE", "abcd"), ("TTT", "bc"), ("AEE", "abd"), ("EEE", "abcde"), ("NNA", "e"), ("OOO", "abcde"), ("TTE", "b")])
def test_rules(spark, rules, keys):
    assert "".join(sorted(r.k for r in M.merge_tables(tables(spark, *SETS), ["k"], "v", rules).collect())) == keys


def test_values_defaults_and_marks(spark):
    got = {r.k: (r.v1, r.v2, r.v3, r.b3) for r in M.merge_tables(tables(spark, *SETS), ["k"], "v", "EEE", default=0, marks=True).collect()}
    assert got["b"] == (2, 20, 200, True)
    assert got["d"] == (4, 0, 0, False)
    assert M.merge_tables(tables(spark, {}, {"a": 1}), ["k"], "v", "EN").count() == 0


def test_kinds_of_keys(spark):
    a, b = tables(spark, {"A1": 1, "x": 2}, {"a1": 3})
    assert [tuple(r) for r in M.merge_tables([a, b], ["k"], "v", "AA", "c").collect()] == [("a1", 1, 3)]
    a, b = tables(spark, {"1.0": 1, "nan?": 5}, {"01": 3})
    assert [tuple(r) for r in M.merge_tables([a, b], ["k"], "v", "AA", "n").collect()] == [(1.0, 1, 3)]
    (a,) = tables(spark, {"chr10": 1, "chr2": 2, "chrX": 3, "odd": 4})
    m = M.merge_tables([a], ["k"], "v", "A", "e", order=M.chromosomes())
    assert [r.v1 for r in m.orderBy(*M.sort_order(["k"], "e")).collect()] == [2, 1, 3, 4]
    assert [r.v1 for r in m.orderBy(*M.sort_order(["k"], "E")).collect()] == [3, 1, 2, 4]
    with pytest.raises(ValueError, match="kind"):
        M.normal_key("k", "z")
    with pytest.raises(ValueError, match="rule"):
        M.merge_tables([a], ["k"], "v", "AA")


def test_one_to_many_and_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("a", 4), ("a", 5)], "k string, w int")
    assert M.merge_rows(a, b, ["k"]).count() == 2
    assert M.merge_tables([a, b.withColumnRenamed("w", "v")], ["k"], "v", "AA").count() == 2


def test_repeated_keys_pair_by_rank(spark):
    a = spark.createDataFrame([("k", 3), ("k", 9), ("k", 5), ("x", 1)], "k string, v int")
    b = spark.createDataFrame([("k", 2), ("k", 8), ("y", None)], "k string, v int")
    assert {tuple(r) for r in M.merge_tables([a, b], ["k"], "v", "AA", paired=True).collect()} == {("k", 9, 8), ("k", 5, 2)}
    assert {tuple(r) for r in M.merge_tables([a, b], ["k"], "v", "EE", paired=True).collect()} == {("k", 9, 8), ("k", 5, 2), ("k", 3, None), ("x", 1, None), ("y", None, None)}
    assert {tuple(r) for r in M.merge_tables([a, b], ["k"], "v", "AA").collect()} == {("k", 9, 8)}


def test_one_long_table_and_presence(spark):
    t = spark.createDataFrame([("k", 1, 5), ("k", 2, 7), ("k", 3, 1), ("j", 2, 4), (None, 1, 6), ("k", None, 9)], "k string, number int, v int")
    assert {tuple(r) for r in M.merge_long(t, ["k"], "v", "number", "OO", default=0, marks=True).collect()} == {("k", 5, 7, True, True), ("j", 0, 4, False, True), (None, 6, 0, True, False)}
    assert [r.present for r in M.present(spark.createDataFrame([(1,), (2,), (None,)], "cnt int"), 2).collect()] == [0, 1, 0]
