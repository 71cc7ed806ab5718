"""Rejected records: every reason, hostile records, and agreement with a plain parser."""

import random
import re

from strandweave.operators import rejects as R

RAW = "raw_id bigint, sample string, raw string, reason string, record string"


def raws(spark, rows):
    return spark.createDataFrame([(i, None, x, "clash", "clash") for i, x in rows], RAW)


def test_reasons(spark):
    rows = {
        1: '1,n,c,ACGT,IIII', 2: '"1","n","a ""q"", b","ACGT","I""I,"', 3: '1,n,c"x,ACGT,IIII', 4: '1,n,"c,ACGT,IIII', 5: "1,n,c,ACGT", 6: "1,n,c,ACGT,IIII,", 7: "", 8: None, 9: "x1,n,c,ACGT,IIII",
        10: "9223372036854775808,n,c,ACGT,", 11: "0009223372036854775807,n,c,ACGT,", 12: "1,,c,ACGT,", 13: "1,n,c,,", 14: "1,n,c,ACGT-,", 15: "1,n,c,ACGT,III", 16: "1,n,c,ACGT,III ", 17: "1,n,c,acgtn,\r", 18: "1,n,c,ACGT,IIII\n",
        19: '1,n,"two\nlines",ACGT,', 20: "1,n,two\nlines,ACGT,", 21: " 1,n,c,ACGT,", 22: '1,"n"x,c,ACGT,', 23: "1,n,c,ACGT,IIII\r\r", 24: '١,n,c,ACGT,', 25: "1,n,c,ACGſ,",
    }
    got = {r.row_id: r.reason for r in R.rejected_raw(raws(spark, rows.items())).collect()}
    assert got == {3: "quoting", 4: "quoting", 5: "columns", 6: "columns", 7: "columns", 8: "columns", 9: "read_id", 10: "read_id", 12: "name", 13: "seq", 14: "seq", 15: "qual", 16: "qual", 18: "qual", 21: "read_id", 22: "quoting", 23: "qual", 24: "read_id", 25: "seq"}
    loaded = {r.offset: r for r in R.parse_strict(raws(spark, rows.items())).collect()}
    assert loaded.keys() | got.keys() == rows.keys()
    assert not loaded.keys() & got.keys()
    assert (loaded[2].comment, loaded[2].qual) == ('a "q", b', 'I"I,')
    assert loaded[11].read_id == 2**63 - 1
    assert loaded[17].qual is None


def test_long_and_hostile_records(spark):
    rows = [(1, '1,n,"' + '""' * 200_000 + '",ACGT,IIII'), (2, "," * 200_000), (3, '1,n,"' + '""' * 200_000 + ",ACGT,IIII"), (4, "1,n,c," + "ACGT" * 100_000 + ",")]
    assert {r.row_id: r.reason for r in R.rejected_raw(raws(spark, rows)).collect()} == {2: "columns", 3: "quoting"}


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "bad"), (1, "bad"), (None, "bad"), (None, "1,n,c,ACGT,"), (2, "1,n,c,ACGT,"), (2, "1,n,c,,"), (2, 'a"')]
    assert {(r.row_id, r.reason) for r in R.rejected_raw(raws(spark, rows)).collect()} == {(1, "columns"), (None, "columns"), (2, "quoting")}
    assert R.rejected_raw(raws(spark, [])).count() == 0


def test_random_against_a_plain_parser(spark):
    rnd = random.Random(9)
    field = r'(?:"(?:[^"]|"")*"|[^",]*)'
    rows = []
    for i in range(600):
        parts = [rnd.choice(["1", "77", "x", '"5"']), rnd.choice(["n", "", '"a,b"', 'q"']), rnd.choice(["c", '"""x"""', '"un', "l\nm"]), rnd.choice(["ACGT", "acgn", "AXGT", ""]), rnd.choice(["IIII", "III", "", "I\tII", '"I""I!"'])]
        rows.append((i, ",".join(parts[: rnd.choice([5, 5, 5, 4])])))
    got = {r.row_id: r.reason for r in R.rejected_raw(raws(spark, rows)).collect()}
    for i, x in rows:
        if not re.fullmatch(f"{field}(?:,{field})*", x):
            want = "quoting"
        else:
            f = [y[1:-1].replace('""', '"') if y.startswith('"') else y for y in re.findall(f"({field})(?:,|\\Z)", x + ("" if not x.endswith(",") else ""))]
            f = f[:-1] if len(f) > x.count(",") + 1 else f
            if not re.fullmatch(",".join([field] * 5), x):
                want = "columns"
            else:
                f = [y[1:-1].replace('""', '"') if y.startswith('"') else y for y in re.fullmatch(",".join([f"({field})"] * 5), x).groups()]
                want = "read_id" if not f[0].isdigit() else "name" if not f[1] else "seq" if not re.fullmatch("[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]+", f[3]) else "qual" if f[4] and (len(f[4]) != len(f[3]) or not re.fullmatch("[!-~]+", f[4])) else None
        assert got.get(i) == want, (x, got.get(i), want)


READS = "read_id bigint, name string, comment string, seq string, qual string, offset string"


def test_reads(spark):
    rows = [(1, "a", "", "ACGT", "IIII", "z"), (1, "a", "", "ACGT", "IIII", "z"), (2, "a", "", None, None, "z"), (3, "a", "", "", "", "z"), (4, "a", "", "AC-T", "I", "z"), (5, "a", "", "ACGT", "III", "z"), (6, None, None, "acgu", None, "z"), (7, "a", "", "ACGT", "", "z"), (8, "a", "", "A", "é", "z")]
    df = spark.createDataFrame(rows, READS)
    assert {(r.row_id, r.reason) for r in R.rejected_reads(df).collect()} == {(2, "seq"), (3, "seq"), (4, "seq"), (5, "qual"), (8, "qual")}
    assert {r.read_id for r in R.valid_reads(df.drop("offset")).collect()} == {1, 6, 7}
    assert R.rejected_reads(spark.createDataFrame([], READS)).count() == 0
