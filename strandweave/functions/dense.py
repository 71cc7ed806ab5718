"""Dense integer ids in sort order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.durable import durable, is_planning


def row_numbers(df: DataFrame, *order: str, name: str = "_row") -> DataFrame:
    """df with `name` BIGINT = 0, 1, … in the given order.

    Each range partition numbers its own rows and adds the number of rows before it; only the partitions' sizes reach the driver, and their offsets, a row a
    partition, are broadcast. The rows are checkpointed, since a range partitioning may differ when it is computed again. An empty table stays empty.
    """
    rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    if is_planning():
        return rows.withColumnRenamed("_m", name)
    part = F.shiftright("_m", 33).cast("int")
    offsets, before = [], 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, before))
        before += n
    start = df.sparkSession.createDataFrame(offsets, "_p int, _start bigint")
    return rows.withColumn("_p", part).join(F.broadcast(start), "_p").withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_start", "_m")


def dense_ids(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct non-null values of `column` with ids 0, 1, … in their order, as (column, name BIGINT)."""
    return row_numbers(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=name)
