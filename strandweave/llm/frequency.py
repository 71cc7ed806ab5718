"""Frequency of every distinct value or term: last-seen counters.

Occurrences are hash-partitioned by term and ordered by record and delivery. Walking them in that order, a term needs its occurrences so far, its records so far,
and the last record and delivery it was seen in: a row of the delivery just seen is a copy and adds nothing, a row of another record than the last adds one to
the records. No set of records or deliveries is kept for a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.kmers import decode_2bit, usable_codes
from strandweave.llm.distinct import chunks

#: Rows of which a task puts copies together before they are shuffled.
CHUNK = 400_000


def term_frequencies(rows: DataFrame, term: str, record: str, amount: str, delivery: str, parts: int | None = None) -> DataFrame:
    """(term, occurrences, records BIGINT): sum of `amount` over distinct deliveries and number of records for every term.

    Rows with the same term, record and delivery count once, with the largest amount (a null delivery is one of its own). A null amount adds nothing, a null term or record is left out.
    parts: so many parts a term's records are spread over, so that no task has to walk all rows of a term that a third of all rows hold; by default as many as
    there are shuffle partitions. Copies are put together in the tasks that read them, rows are shuffled once, and counters of parts once more.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.select(F.col(term).alias("term"), F.col(record).alias("record"), F.col(delivery).alias("delivery"), F.col(amount).cast("bigint").alias("amount"))
    once = d.mapInArrow(_together, d.schema).withColumn("part", F.pmod(F.xxhash64("record"), F.lit(parts)))
    walk = W.partitionBy("term", "part").orderBy("record", "delivery", F.desc_nulls_last("amount"))
    seen = once.withColumns({"last": F.lag("record").over(walk), "sent": F.lag("delivery").over(walk)})
    other = ~F.col("record").eqNullSafe(F.col("last"))
    copy = ~other & F.coalesce(F.col("delivery") == F.col("sent"), F.lit(False))
    counters = seen.groupBy("term", "part").agg(F.sum(F.when(copy, F.lit(0)).otherwise(F.coalesce("amount", F.lit(0)))).cast("bigint").alias("occurrences"), F.sum(other.cast("bigint")).alias("records"))
    return counters.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without null terms and records, of CHUNK rows (term, record, delivery, amount) one for each term, record and delivery: the largest amount of a delivery, the sum without one."""
    for t in chunks(batches, CHUNK):
        t = t.filter(pc.and_(pc.is_valid(t["term"]), pc.is_valid(t["record"])))
        g = t.group_by(["term", "record", "delivery"], use_threads=False).aggregate([("amount", "max"), ("amount", "sum")])
        amount = pc.if_else(pc.is_null(g["delivery"]), g["amount_sum"], g["amount_max"])
        yield from g.select(["term", "record", "delivery"]).append_column("amount", amount).combine_chunks().to_batches()


def kmer_frequencies(kmer_t: DataFrame) -> DataFrame:
    """(kmer, occurrences, records, mark) of every canonical k-mer of the usable rows; a record is a sample.

    mark is `rare` (one sample and a sum of at most 1), `common` (at least half of the samples with usable rows) or null; where both hold, as when there
    are at most two samples, it is `rare`. Rows with the same rec_id count once; a null cnt adds nothing. An empty table gives no row.
    """
    samples = usable_codes(kmer_t, "sample").select("sample").distinct().count()
    t = term_frequencies(usable_codes(kmer_t, "rec_id", "sample", "cnt"), "code", "sample", "cnt", "rec_id")
    rare, common = (F.col("records") == 1) & (F.col("occurrences") <= 1), F.col("records") * 2 >= samples
    return t.select(decode_2bit("term", 21).alias("kmer"), "occurrences", "records", F.when(rare, "rare").when(common, "common").alias("mark"))
