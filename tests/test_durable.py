"""Where lineage is cut."""

import pytest

from strandweave.plans import durable


class _Context:
    """A session of a cluster that names no checkpoint folder."""

    master = "spark://host:7077"

    class _Empty:
        def isDefined(self):
            return False

        def get(self, *_):
            return None

    sparkContext = property(lambda self: self)
    conf = _Empty()
    _jsc = property(lambda self: self)

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self._Empty()

    def getConf(self):
        return self._Empty()

    def setCheckpointDir(self, where):
        raise AssertionError(where)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.checkpoint_dir(_Context())


def test_masters_of_one_machine():
    assert [durable.is_one_machine(m) for m in ("local", "local[8]", "local[*]", "local-cluster[3,2,3000]", "yarn")] == [True, True, True, False, False]


def test_rows_survive(spark):
    assert sorted(r.id for r in durable.durable(spark.range(5)).collect()) == [0, 1, 2, 3, 4]
    assert "checkpoints" in durable.checkpoint_dir(spark)


def test_spread_outlasts_a_grouping_by_the_same_keys(spark):
    """Adaptive execution puts the few bytes of a grouped table in one partition; what is spread keeps many."""
    from pyspark.sql import functions as F

    from strandweave.plans.durable import spread

    grouped = spark.range(400).groupBy((F.col("id") % 40).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    tasks = spread(grouped, "g").groupBy("g").applyInPandas(lambda p: p, "g bigint, n bigint").withColumn("p", F.spark_partition_id())
    assert tasks.select("p").distinct().count() > 2 and tasks.count() == 40
    assert parts(grouped) <= parts(spread(grouped, "g"))
