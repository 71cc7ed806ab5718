"""K-mers against a plain Python counter."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandweave.functions import kmers
from strandweave.operators import counting, sharing

PAIR = str.maketrans("ACGT", "TGCA")


def canonical(k):
    return min(k, k.translate(PAIR)[::-1])


def brute(seqs, k):
    c = Counter()
    for s in seqs:
        s = (s or "").replace("a", "A").replace("c", "C").replace("g", "G").replace("t", "T")
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                c[canonical(w)] += 1
    return c


def counted(spark, seqs, k, **more):
    df = spark.createDataFrame([("s", x) for x in seqs], "sample string, seq string")
    return {r.kmer: r.cnt for r in counting.count_kmers(df, k, **more).collect()}


@pytest.mark.parametrize(("seq", "k", "expected"), [("GATTACA", 3, {"ATC": 1, "AAT": 1, "TAA": 1, "GTA": 1, "ACA": 1}), ("ACGNACG", 3, {"ACG": 2}), ("acgt", 3, {"ACG": 2}), ("AC", 3, {}), ("", 3, {}), (None, 3, {}), ("ACGſACGéACG", 3, {"ACG": 3})])
def test_small_cases(spark, seq, k, expected):
    assert counted(spark, [seq], k) == expected


def test_random_reads(spark):
    rnd = random.Random(4)
    seqs = ["".join(rnd.choice("ACGTacgtN-") for _ in range(rnd.randint(0, 80))) for _ in range(200)] + [None, "", "ACGT" * 5000]
    for k in (3, 5, 21, 33):
        assert counted(spark, seqs, k, cap=10**9) == brute(seqs, k)


def test_reverse_complemented_reads_count_alike(spark):
    seqs = ["ACGGTTACGATCGATTTACG", "TTTACGCGAGGCATT"]
    assert counted(spark, seqs, 5) == counted(spark, [s.translate(PAIR)[::-1] for s in seqs], 5)


def test_saturation_least_limit_and_bounds(spark):
    assert counted(spark, ["AAA"] * 16400, 3) == {"AAA": 16383}
    assert counted(spark, ["ACGACG", "TTT"], 3, least=2) == {"ACG": 2}
    assert list(counted(spark, ["GATTACA"], 3, limit=2)) == ["AAT", "ACA"]
    with pytest.raises(ValueError, match="from 3 to 63"):
        counted(spark, ["A"], 2)


def test_special_filter(spark):
    ok, run, missing, most = "ACGTACGTA", "AAAAACCGGTT", "AAACCCGGGT", "AAAAGAAACCGGTT"
    df = spark.createDataFrame([(x,) for x in (ok, run, missing, most)], "k string")
    assert [r[0] for r in df.select(F.min(kmers.well_mixed("k", 9))).collect()] == [False]
    one = lambda x: spark.createDataFrame([(x,)], "k string").select(kmers.well_mixed("k", len(x))).first()[0]
    assert [one("ACGTACGT"), one(run), one(missing)] == [True, False, False]
    kept, left = counted(spark, ["ACGTACGTAAAAAAGT"], 8, special=True), counted(spark, ["ACGTACGTAAAAAAGT"], 8, special=False)
    assert kept | left == counted(spark, ["ACGTACGTAAAAAAGT"], 8)
    assert not kept.keys() & left.keys()


def test_complexity_and_codes(spark):
    rnd = random.Random(1)
    ks = ["".join(rnd.choice("ACGT") for _ in range(12)) for _ in range(30)] + ["A" * 12]
    df = spark.createDataFrame([(k,) for k in ks], "k string")
    for r in df.select("k", kmers.complexity("k", 12).alias("c"), kmers.encode_2bit("k").alias("e")).withColumn("back", kmers.decode_2bit("e", 12)).collect():
        assert r.c == len({r.k[i:j] for i in range(12) for j in range(i + 1, 13)})
        assert r.back == r.k
    coded = df.select("k", kmers.encode_2bit("k").alias("e")).orderBy("e").collect()
    assert [r.k for r in coded] == sorted(ks)


def test_canonical_is_symmetric(spark):
    df = spark.createDataFrame([("ACGGT",), ("TTTGC",)], "k string")
    for r in df.select(kmers.canonical("k").alias("a"), kmers.canonical(kmers.reverse_complement("k")).alias("b")).collect():
        assert r.a == r.b


KMERS = "rec_id bigint, panel string, sample string, file string, kmer string, cnt int, h string"


def test_summed_counts_and_tables(spark):
    a, b = "A" * 20 + "C", "C" * 10 + "GT" * 5 + "A"
    rows = [(1, "p", "p.sp1", "f", a, 3, "x"), (1, "p", "p.sp1", "f", a, 3, "y"), (2, "p", "p.sp1", "f", a.lower(), None, ""), (3, "p", "p.sp2", "f", a.translate(PAIR)[::-1], 16383, ""), (4, "p", "p.sp2", "f", a, 5, ""), (5, "p", "p.sp2", "f", b, None, "")]
    rows += [(6, "p", None, "f", a, 1, ""), (7, "p", "p.sp1", "f", "ACGT", 1, ""), (8, "p", "p.sp1", "f", a + "\n", 1, ""), (9, "p", "p.sp1", "f", None, 1, ""), (10, "p", "p.sp1", "f", "N" + a[1:], 1, "")]
    c = counting.summed_counts(spark.createDataFrame(rows, KMERS))
    assert {(r.sample, r.kmer, r.cnt) for r in c.collect()} == {("p.sp1", a, 3), ("p.sp2", a, 16383), ("p.sp2", canonical(b), 0)}
    assert {r.kmer for r in sharing.shared_table(c).collect()} == {a}
    assert {(r.s1, r.s2, r.nshare) for r in sharing.pair_shares(c).collect()} == {("p.sp1", "p.sp1", 1), ("p.sp1", "p.sp2", 1), ("p.sp2", "p.sp2", 2)}
    assert {(r.sample, r.n) for r in sharing.singletons(c, 1).collect()} == {("p.sp1", 0), ("p.sp2", 1)}
    assert sum(r.n for r in counting.abundance(c, 20000).collect()) == c.count()
    empty = counting.summed_counts(spark.createDataFrame([], KMERS))
    assert sharing.pair_shares(empty).count() == sharing.shared_table(empty).count() == counting.diversity(empty).count() == 0


def test_read_statistics(spark):
    df = spark.createDataFrame([("s", "GGCCN"), ("s", "AATT"), ("t", None), ("u", "NN"), ("u", "")], "sample string, seq string")
    got = {r["sample"]: r for r in counting.read_statistics(df).collect()}
    assert (got["s"].n_reads, got["s"].total_bp, got["s"].mean_len, got["s"].gc) == (2, 9, 4, 0.5)
    assert "t" not in got
    assert got["u"].gc is None


def test_codes_of_usable_rows(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["s", "t", None]), "".join(rnd.choice("ACGTacgt") for _ in range(rnd.choice([20, 21, 21, 21, 22])))) for _ in range(400)]
    rows += [("s", x) for x in ("T" * 21, "a" * 21, "ACGTN" + "A" * 16, "A" * 20 + "\n", "", None, "é" * 21, "C" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "sample string, kmer string, code string")
    want = kmers.usable_kmers(df, "sample").select("sample", kmers.encode_2bit("kmer").alias("code"), "kmer")
    got = kmers.usable_codes(df, "sample").withColumn("kmer", kmers.decode_2bit("code", 21))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 150
    for k in (1, 4, 15, 31):
        text = "".join(rnd.choice("ACGT") for _ in range(k))
        r = spark.createDataFrame([("s", text)], "sample string, kmer string").select(kmers.decode_2bit(kmers.reverse_complement_code(kmers.encode_2bit("kmer"), k), k), kmers.reverse_complement("kmer")).first()
        assert r[0] == r[1]
