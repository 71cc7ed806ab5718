"""Cutting lineage so that a lost executor costs a re-read, not a recomputation."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Only a session on one machine (master local or local[…]) that names none gets a temporary folder; on a cluster a missing spark.checkpoint.dir is a
    RuntimeError, since a folder of one machine would be lost with it. With spark.cleaner.referenceTracking.cleanCheckpoints Spark removes files that are no longer used."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not is_one_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(where)
    return where


def is_one_machine(master: str) -> bool:
    """local and local[…], but not local-cluster[…]."""
    return master == "local" or master.startswith("local[")


_planning: ContextVar[bool] = ContextVar("planning", default=False)


@contextmanager
def planning() -> Iterator[None]:
    """Within this block nothing is computed: durable() leaves frames as they are, so that their whole plan can be shown."""
    token = _planning.set(True)
    try:
        yield
    finally:
        _planning.reset(token)


def is_planning() -> bool:
    return _planning.get()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder; see planning()."""
    if is_planning():
        return df
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df hashed by keys into one partition more than the session shuffles into, for groups that are few bytes but much work: adaptive execution would join such
    partitions by their size and fit all trees in one task. A repartition into as many as a join or grouping by the same keys gives is left out by Spark, hence one more."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)
