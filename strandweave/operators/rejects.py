"""Rows that fail to parse: strict load plus anti-join.

Every raw record keeps its offset (its id). A strict load takes only records that conform in every respect; what it took is subtracted from the raw
offsets by an anti-join, and only the remainder is diagnosed. A record is therefore either loaded or rejected with one reason, never both or neither. Records of
one offset whose texts differ are records by themselves: those that conform are loaded, and the offset is reported if one of them doesn't.

A record is fields with commas between them. A field is free of commas and double quotes, or wholly within double quotes with every inner quote
doubled; it may hold line breaks. All patterns are possessive, so they neither back-track nor recurse on long or hostile records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("read_id", "name", "comment", "seq", "qual")
# Letters of a sequence, characters of a quality string, and the largest read_id
SEQUENCE_LETTERS = "ACGTUNRYSWKMBDHV"
QUALITY_RANGE = "!-~"
LARGEST_ID = "9223372036854775807"

_FIELD = r'(?:(?:"[^"]*+")++|[^",]*+)'
_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
_FIVE = rf"\A{_FIELD}(?:,{_FIELD}){{4}}+\z"


def record_text(raw: Column) -> Column:
    """The record less one carriage return at its end; a null record is an empty one."""
    r = F.coalesce(raw, F.lit(""))
    return F.when(r.endswith("\r"), r.substr(F.lit(1), F.length(r) - 1)).otherwise(r)


def field(record: Column, n: int) -> Column:
    """Field n, from 0, of a record of five fields, with its quotes resolved."""
    f = F.regexp_extract(record, rf"\A(?:{_FIELD},){{{n}}}+({_FIELD})", 1)
    return F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)


def id_ok(read_id: Column) -> Column:
    digits = F.regexp_replace(read_id, r"\A0++", "")
    return read_id.rlike(r"\A[0-9]++\z") & ((F.length(digits) < len(LARGEST_ID)) | ((F.length(digits) == len(LARGEST_ID)) & (digits <= LARGEST_ID)))


def seq_ok(seq: Column) -> Column:
    """Not null, not empty, and only sequence letters in either case."""
    return F.coalesce(seq.rlike(rf"\A[{SEQUENCE_LETTERS}{SEQUENCE_LETTERS.lower()}]++\z"), F.lit(False))


def qual_ok(qual: Column, seq: Column) -> Column:
    """Null, empty, or as long as seq and within the range of quality characters."""
    return F.coalesce((F.length(qual) == 0) | ((F.length(qual) == F.length(seq)) & qual.rlike(rf"\A[{QUALITY_RANGE}]++\z")), qual.isNull())


def _fields(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns f0 … f4 of records that have five fields."""
    return df.select(*keep, *[field(F.col("record"), i).alias(f"f{i}") for i in range(5)])


def _records(df: DataFrame, key: str, *texts: str) -> tuple[DataFrame, list[str]]:
    """Distinct (offset, texts) and the columns that identify them.

    The identifying columns hold no null, so that later joins on them are plain equalities, which keep the partitioning that making the rows distinct has
    brought about: the texts are shuffled once, after copies have been put together within the tasks.
    """
    flat = {"_o": F.coalesce(F.col(key), F.lit(0)), "_on": F.col(key).isNull()}
    for t in texts:
        flat |= {f"_{t}": F.coalesce(F.col(t), F.lit("")), f"_{t}n": F.col(t).isNull()}
    rows = df.select(*[c.alias(n) for n, c in flat.items()]).distinct()
    back = lambda n: F.when(~F.col(f"{n}n"), F.col(n))
    return rows.select(*flat, back("_o").alias("offset"), *[back(f"_{t}").alias(t) for t in texts]), list(flat)


def _strict(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The rows (raw, …) that conform in every respect, with their fields."""
    f = _fields(rows.withColumn("record", record_text(F.col("raw"))).where(F.col("record").rlike(_FIVE)), keep)
    return f.where(id_ok(F.col("f0")) & (F.length("f1") > 0) & seq_ok(F.col("f3")) & qual_ok(F.col("f4"), F.col("f3")))


def parse_strict(raw: DataFrame, key: str = "raw_id", text: str = "raw") -> DataFrame:
    """(offset, read_id BIGINT, name, comment, seq, qual) of the records that conform; an empty qual is null. One row for each distinct (offset, text)."""
    rows, _ = _records(raw.select(F.col(key).alias("key"), F.col(text).alias("raw")), "key", "raw")
    return _strict(rows, ["offset"]).select("offset", F.col("f0").cast("bigint").alias("read_id"), F.col("f1").alias("name"), F.col("f2").alias("comment"), F.col("f3").alias("seq"), F.nullif("f4", F.lit("")).alias("qual"))


def diagnose(remainder: DataFrame) -> DataFrame:
    """(offset, reason) of records (offset, raw) that the strict load left: the first of quoting, columns, read_id, name, seq, qual that applies."""
    f = _fields(remainder.withColumn("record", record_text(F.col("raw"))), ["offset", "record"])
    reason = (
        F.when(~F.col("record").rlike(_RECORD), "quoting")
        .when(~F.col("record").rlike(_FIVE), "columns")
        .when(~id_ok(F.col("f0")), "read_id")
        .when(F.length("f1") == 0, "name")
        .when(~seq_ok(F.col("f3")), "seq")
        .otherwise("qual")
    )
    return f.select("offset", reason.alias("reason"))


def _first_reason(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One reason an offset: where copies of an offset differ, the first of the order."""
    reasons = F.array(*map(F.lit, order))
    first = rows.groupBy("offset").agg(F.min(F.array_position(reasons, F.col("reason")).cast("int")).alias("_first"))  # a number, so that rows are combined by hash
    return first.select("offset", F.element_at(reasons, F.col("_first")).alias("reason"))


REASONS = ("quoting", "columns", "read_id", "name", "seq", "qual")


def rejected_raw(raw: DataFrame, key: str = "raw_id", text: str = "raw") -> DataFrame:
    """(row_id, reason): the records that can't be loaded, one row for each distinct id.

    A repeated record counts once. Should copies of one id differ, each is judged by itself, and the id comes out if one of them fails, with the first
    reason in order. A null id is an id like others. An empty table gives no row. Records of any length and number of quotes are judged whole.
    """
    rows, ids = _records(raw.select(F.col(key).alias("key"), F.col(text).alias("raw")), "key", "raw")
    rest = rows.join(_strict(rows, ids), ids, "left_anti")
    return _first_reason(diagnose(rest.select("offset", "raw")), REASONS).withColumnRenamed("offset", "row_id")


def valid_reads(reads: DataFrame) -> DataFrame:
    """(offset, read_id, name, comment, seq, qual) of earlier-loaded reads whose seq and qual can be used, one row for each distinct row."""
    return reads.where(seq_ok(F.col("seq")) & qual_ok(F.col("qual"), F.col("seq"))).select(F.col("read_id").alias("offset"), "read_id", "name", "comment", "seq", F.nullif("qual", F.lit("")).alias("qual")).distinct()


def rejected_reads(reads: DataFrame) -> DataFrame:
    """(row_id, reason) of earlier-loaded reads that can't be used: seq or qual; one row for each distinct read_id, as rejected_raw."""
    rows, ids = _records(reads.select("read_id", "seq", "qual"), "read_id", "seq", "qual")
    rest = rows.join(rows.where(seq_ok(F.col("seq")) & qual_ok(F.col("qual"), F.col("seq"))), ids, "left_anti")
    return _first_reason(rest.select("offset", F.when(~seq_ok(F.col("seq")), "seq").otherwise("qual").alias("reason")), REASONS).withColumnRenamed("offset", "row_id")


def rejects(raw: DataFrame, reads: DataFrame) -> DataFrame:
    """(src, row_id, reason) of both sources."""
    a = rejected_raw(raw).select(F.lit("sequence_raw").alias("src"), "row_id", "reason")
    return a.unionByName(rejected_reads(reads).select(F.lit("seq_reads").alias("src"), "row_id", "reason"))


def loaded(raw: DataFrame, reads: DataFrame) -> DataFrame:
    """(src, read_id, name, comment, seq, qual) of every record that can be used, each once."""
    cols = ["read_id", "name", "comment", "seq", "qual"]
    a = parse_strict(raw).select(F.lit("sequence_raw").alias("src"), *cols)
    return a.unionByName(valid_reads(reads).select(F.lit("seq_reads").alias("src"), *cols))
