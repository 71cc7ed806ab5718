import bz2
import gzip

import pytest
from pyspark.errors import PySparkException

from strandweave.operators import counting
from strandweave.sources import fastx, tables
from strandweave.streaming.counts import counts_table, stream_counts, stream_reads


@pytest.fixture
def data(tmp_path):
    (tmp_path / "sp1").mkdir()
    (tmp_path / "sp1/a.fa").write_text(">r1 first > read\nACGT\nACGT\n>empty\n>r2\r\nTT\r\nGG\r\n")
    (tmp_path / "sp1/b.fq.gz").write_bytes(gzip.compress(b"@q1 x y\nACGT\n+q1\n@III\n\n@q2\nNN\n+\n!!\n@cut\nAC\n"))
    (tmp_path / "loose.one.fa.bz2").write_bytes(bz2.compress(b">z\nGATTACA\n"))
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "sp1/a.fa~").write_text(">old\nA\n")
    (tmp_path / "empty.fa").write_text("")
    return tmp_path


def test_fastx(spark, data):
    df = fastx.read_fastx(spark, str(data))
    got = {(r["sample"], r.file, r.name, r.comment, r.seq, r.qual) for r in df.collect()}
    assert got == {("sp1", "a.fa", "r1", "first > read", "ACGTACGT", None), ("sp1", "a.fa", "r2", "", "TTGG", None), ("sp1", "b.fq.gz", "q1", "x y", "ACGT", "@III"), ("sp1", "b.fq.gz", "q2", "", "NN", "!!"), ("loose_one", "loose.one.fa.bz2", "z", "", "GATTACA", None)}
    assert df.select("read_id").distinct().count() == 5
    assert {r["sample"] for r in counting.count_kmers(df, 3).collect()} == {"sp1", "loose_one"}
    for split in (1, 3, 7, 20):  # plain files cut anywhere
        again = fastx.read_fastx(spark, str(data), split=split)
        assert {(r["sample"], r.file, r.name, r.comment, r.seq, r.qual) for r in again.collect()} == got
        assert again.select("read_id").distinct().count() == again.count() == 5
    (data / "sp1/bad.fa").write_text("neither")
    with pytest.raises(PySparkException):
        fastx.read_fastx(spark, str(data)).collect()
    (data / "loose").mkdir()
    (data / "loose/x.fa").write_text(">a\nA\n")
    with pytest.raises(ValueError, match="same name"):
        fastx.discover(str(data), "stem")


def test_plain_fastq_is_cut_between_records(spark, tmp_path):
    reads = [(f"@r{i} c", "ACGT" * (i % 5 + 1), ("@+>I" * (i % 5 + 1))) for i in range(200)]
    (tmp_path / "s.fq").write_text("".join(f"{h}\n{s}\n+{h[1:] if i % 2 else ''}\n{q}\n" for i, (h, s, q) in enumerate(reads)))
    for split in (11, 97, 1 << 20):
        df = fastx.read_fastx(spark, str(tmp_path), split=split)
        assert sorted((f"@{r.name} {r.comment}", r.seq, r.qual) for r in df.collect()) == sorted(reads)
        assert df.select("read_id").distinct().count() == 200


def test_tables_as_text(spark, tmp_path):
    c = spark.createDataFrame([("x", "ACG", 3), ("y", "CCG", 2), ("x", "CCG", 1)], "sample string, kmer string, cnt int")
    tables.matrix_text(c, ["x", "y"], 3).coalesce(1).write.text(str(tmp_path / "m"))
    assert {(r.kmer, r["sample"], r.cnt) for r in tables.read_matrix(spark, str(tmp_path / "m"), 3).collect()} == {("ACG", "x", 3), ("CCG", "x", 1), ("CCG", "y", 2)}
    m = spark.createDataFrame([("p", "p.sp2", 1, 4), ("p", "p.sp1", 5, 1)], "panel string, sample string, sp1 int, sp2 int")
    (tmp_path / "n.csv").write_text(tables.share_csv_text(m, ["sp1", "sp2"]).first().text)
    assert {(r.s1, r.s2, r.nshare) for r in tables.read_share_csv(spark, str(tmp_path / "n.csv")).collect()} == {("sp1", "sp1", 5.0), ("sp1", "sp2", 1.0), ("sp2", "sp1", 1.0), ("sp2", "sp2", 4.0)}


def test_header_of_many_samples(spark, tmp_path):
    names = [f"s{i}" for i in range(5000)]
    (tmp_path / "m").write_text("#-k 21\n" + "".join(f"#sample{i + 1}: {x}\n" for i, x in enumerate(names)) + "\t".join(["1"] * 5000) + "\n")
    h = tables.read_header(spark, str(tmp_path / "m"))
    assert h["samples"] == names
    assert h["k"] == 21 and not h["kmers"]
    assert tables.read_matrix(spark, str(tmp_path / "m")).count() == 5000


def test_matrix_of_either_dialect(spark, tmp_path):
    a, b = tmp_path / "a.dat", tmp_path / "b.dat"
    a.write_text("#-k 21\n#-n 1\n#sample1: x\n#sample2: y\n3\t0\n1\t2\n")
    b.write_text("#-k 21\n#-n 1\nkmer\tx\ty\nACG\t3\t0\nCCG\t1\t2\n")
    got = lambda p: {(r.kmer, r["sample"], r.cnt) for r in tables.read_matrix(spark, str(p), 21).collect()}
    assert got(a) == {(None, "x", 3), (None, "x", 1), (None, "y", 2)}
    assert got(b) == {("ACG", "x", 3), ("CCG", "x", 1), ("CCG", "y", 2)}
    with pytest.raises(ValueError, match="k = 21"):
        tables.read_matrix(spark, str(a), 25)
    a.write_text("#sample1: x\n#sample2: y\n3\n")
    with pytest.raises(PySparkException):
        got(a)


def test_small_tables(spark, tmp_path):
    w = tmp_path / "w"
    w.write_text("Total: 12 kmers\nsp1: 3\n\n")
    assert [(r.label, r.ntotal) for r in tables.read_diversity(spark, str(w)).collect()] == [("Total", 12), ("sp1", 3)]
    t = tmp_path / "t"
    t.write_bytes(b"spname\tcoverage\treadlength\terrorrate\rsp1\t3.95\t76\t0.01\rsp2\t3.87\t76\t0.01")
    assert [tuple(r) for r in tables.read_tip_info(spark, str(t)).collect()] == [("sp1", 3.95, 76.0, 0.01), ("sp2", 3.87, 76.0, 0.01)]
    t.write_text("sp1 1 2\n")
    with pytest.raises(PySparkException):
        tables.read_tip_info(spark, str(t)).collect()
    n = tmp_path / "n.csv"
    n.write_text("sp1,sp10\n165116.0,24379\n24379,165245.0\n")
    assert {(r.s1, r.s2, r.nshare) for r in tables.read_share_csv(spark, str(n)).collect()} == {("sp1", "sp1", 165116.0), ("sp1", "sp10", 24379.0), ("sp10", "sp1", 24379.0), ("sp10", "sp10", 165245.0)}


def test_phylip(spark, tmp_path):
    d = spark.createDataFrame([("p", "a_long_name_1", "a_long_name_2", 0.5), ("p", "a_long_name_1", "b", 0.25)], "panel string, s1 string, s2 string, d double")
    text = tables.phylip_lines(d).first().text
    assert text.splitlines()[0] == "3 3"
    (tmp_path / "d").write_text(text)
    got = {(r.s1, r.s2): r.d for r in tables.read_phylip(spark, str(tmp_path / "d")).collect()}
    assert got["a_long_nam", "a_long_na1"] == 0.5
    assert got["a_long_na1", "b"] == 1.0
    assert tables.parse_phylip("3\na\nb 1\nc 2 3\n", "lower") == [("b", "a", 1, 0, 1.0, 1.0), ("c", "a", 2, 0, 2.0, 1.0), ("c", "b", 2, 1, 3.0, 1.0)]
    with pytest.raises(ValueError, match="symmetric"):
        tables.parse_phylip("2\na 0 1\nb 2 0\n")
    with pytest.raises(ValueError, match="name"):
        tables.parse_phylip("1\na:b 0\n")


def test_counts_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([("s", "ACGTACG"), ("t", "GGGG")], "sample string, seq string")
    c = counting.count_kmers(reads, 3)
    tables.write_counts(c, str(tmp_path / "c"))
    back = {(r.kmer, r.cnt) for r in tables.read_counts(spark, str(tmp_path / "c/sample=s")).collect()}
    assert back == {(r.kmer, r.cnt) for r in c.where("sample = 's'").collect()}


def test_stream_counts_as_batch(spark, tmp_path):
    reads = spark.createDataFrame([("s", "ACGTACG"), ("t", "GGGGN"), (None, "ACG"), ("s", None)], "sample string, seq string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    got = counts_table(stream_counts(stream_reads(spark, str(tmp_path / "in"), "sample string, seq string", 1), 3), str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in counting.count_kmers(reads, 3).collect()}


def test_stream_counts_copies_once_and_saturates(spark, tmp_path):
    schema = "read_id bigint, sample string, seq string"
    reads = spark.createDataFrame([(1, "s", "ACGTACG"), (1, "s", "ACGTACG"), (2, "s", "ACGT"), (None, "s", "ACG"), (3, "t", "GGGGGG")], schema)
    for i, part in enumerate(("read_id = 1", "read_id is null or read_id > 1", "true")):  # everything comes twice
        reads.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    got = counts_table(stream_counts(stream_reads(spark, str(tmp_path / "in"), schema, 1), 3, cap=2, once=True), str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in counting.count_kmers(counting.distinct_reads(reads), 3, cap=2).collect()}
    late = spark.createDataFrame([("s", "ACGT")], "sample string, seq string").selectExpr("*", "timestamp'2009-01-05 10:00:00' as at")
    late.write.parquet(str(tmp_path / "days"))
    days = counts_table(stream_counts(stream_reads(spark, str(tmp_path / "days"), "sample string, seq string, at timestamp"), 3, day="at"), str(tmp_path / "out2"))
    assert {(r.kmer, r.cnt, str(r.day.start)) for r in days.collect()} == {("ACG", 2, "2009-01-05 00:00:00")}


def test_fasta_text(spark):
    df = spark.createDataFrame([("a", "x y", "ACGT"), ("b", "", "AC"), ("c", None, "")], "name string, comment string, seq string")
    assert [r.value for r in tables.fasta_text(df).collect()] == [">a x y\nACGT", ">b\nAC"]


def test_trees_and_commands(spark, tmp_path, data, capsys):
    from strandweave.plans import cli

    f = tmp_path / "trees"
    f.write_text("((a:1,b:1):2,\n(c:1,d:1):1);\r\n((a:1,b:1):2,(c:1,d:1):1);(a:1,(b:1,c:1):1,d:1);\n")
    t = tables.read_trees(spark, str(f))
    assert [r.newick for r in t.orderBy("tree_id").collect()] == ["((a:1,b:1):2,(c:1,d:1):1);", "((a:1,b:1):2,(c:1,d:1):1);", "(a:1,(b:1,c:1):1,d:1);"]
    tables.write_trees(t, str(tmp_path / "back"))
    assert tables.read_trees(spark, str(tmp_path / "back")).count() == 3
    run = lambda *a: cli.result(spark, cli._parser().parse_args([*a, "-o", "x"])).collect()
    assert [(r.id1, r.id2, r.rf) for r in run("treedist", "-d", str(f))] == [(0, 1, 0)]
    assert run("consensus", "-d", str(f))[0].n_trees == 3
    assert "a:0.50000" in run("trim", "-d", str(f), "--by", "0.5")[0].newick
    f.unlink()
    for p in (tmp_path / "back").iterdir():
        p.unlink()
    (tmp_path / "back").rmdir()
    for command in ("count", "histogram", "singletons", "stats", "distance", "phylogeny"):
        assert run(command, "-d", str(tmp_path), "-k", "3")
    for command in ("phylogeny", "bootstrap", "count"):
        cli.main([command, "-d", str(tmp_path), "-k", "3", "-o", str(tmp_path / "none"), "-s"])
    assert "Scan" in capsys.readouterr().out
    assert not (tmp_path / "none").exists()
    assert {r["sample"] for r in run("genomesize", "-d", str(tmp_path), "-k", "3")} == {"sp1", "loose_one"}
    (tmp_path.parent / "t1").write_text("ACG\t3\nCCC\t1\n")
    (tmp_path.parent / "t2").write_text("ACG\t2\n")
    both = f"{tmp_path.parent}/t1,{tmp_path.parent}/t2"
    assert [tuple(r) for r in run("merge", "-d", both)] == [("ACG", 3, 2)]
    assert {tuple(r) for r in run("merge", "-d", both, "--rules", "AE")} == {("ACG", 3, 2), ("CCC", 1, 0)}
    (tmp_path.parent / "tips").write_text("spname coverage readlength errorrate\nsp1 3.95 76 0.01\n")
    assert [r.spname for r in run("tip", "-d", str(tmp_path.parent / "tips"))] == ["sp1"]
    cli.main(["count", "-d", str(tmp_path), "-o", str(tmp_path.parent / "out"), "-k", "3"])
    assert spark.read.parquet(str(tmp_path.parent / "out.diversity")).count() == 2
