"""K-mer counts of a stream of reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.kmers import explode_kmers
from strandweave.operators.counting import CAP
from strandweave.plans.durable import checkpoint_dir


def stream_reads(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of reads as they arrive, at most `files` at a time."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(path)


def stream_counts(reads: DataFrame, k: int, day: str | None = None, late: str = "30 days", cap: int = CAP, once: bool = False) -> DataFrame:
    """(sample, kmer, cnt): counts so far, saturated at `cap`, for update mode. With `day`, a timestamp column, counts by day, and state is dropped `late` after its day.

    once: copies of a read (read_id, sample, seq; with `day` those that come within `late`) count once and reads without an id are left out, as distinct_reads() has it."""
    rows = reads.where("sample is not null")
    rows = rows.withWatermark(day, late) if day else rows
    if once:
        rows = rows.where("read_id is not null").dropDuplicates(["read_id", "sample", "seq", *([day] if day else [])])
    keys = [F.window(day, "1 day").alias("day")] if day else []
    kmers = explode_kmers(rows, "seq", k, "sample", *([day] if day else []))
    return kmers.groupBy(*keys, "sample", "kmer").agg(F.least(F.count(F.lit(1)), F.lit(cap)).cast("bigint").alias("cnt"))


def counts_table(counts: DataFrame, path: str | None = None) -> DataFrame:
    """Reads all present files of the stream and gives the counts as a table.

    Each batch adds the rows that it changed, with their new counts, to `path` (default: below the shared checkpoint folder); the table is the largest count of each key, since counts
    only grow. A batch that runs again overwrites what it wrote before."""
    spark = counts.sparkSession
    base = path or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")

    spark.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{base}/changes/batch=-1")
    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    keys = [c for c in counts.columns if c != "cnt"]
    return spark.read.parquet(f"{base}/changes").groupBy(*keys).agg(F.max("cnt").alias("cnt"))
