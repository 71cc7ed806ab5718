"""Distinct counts over huge identifier sets: registers of minimum exponential hash values.

A sketch of a set is `m` registers; register j holds the minimum over the set's members of an Exp(1) variate derived from the member's hash and
j. The minimum of n such variates is Exp(n), so the sum of the registers of a set of n members is Gamma(m, n), (m - 1) / sum is an unbiased
count with relative standard error 1 / sqrt(m - 2), and quantiles of the gamma distribution give confidence intervals. Registers of a union are
the elementwise minimum of the registers, so sketches can be stored and merged later in any order and grouping; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.kmers import usable_codes
from strandweave.plans.durable import durable

REGISTERS = 400
#: Rows that are hashed together, and sketches held by a task before it hands them on.
CHUNK, HELD = 32_768, 4_096
Z = 4.9
#: Days in doubt of which the days within reach (at most 31 of some 40 bytes each) are broadcast; see new_members().
BROADCAST = 50_000


def multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd 64-bit multipliers of the registers, the same in every task and run."""
    r = np.random.Generator(np.random.PCG64(20_260_101)).integers(0, 1 << 63, size=(2, m), dtype=np.uint64)
    return r[0] * np.uint64(2) + np.uint64(1), r[1] * np.uint64(2) + np.uint64(1)


def register_minima(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """For groups of hashes that begin at `starts`, the (groups, m) exponential minima as float32."""
    a, b = multipliers(m)
    low = np.empty((m, len(starts)), np.uint64)
    x, y, s = np.empty_like(hashes), np.empty_like(hashes), np.uint64(32)
    for j in range(m):
        np.multiply(hashes, a[j], out=x)
        np.right_shift(x, s, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, b[j], out=x)
        np.right_shift(x, s, out=y)
        np.bitwise_xor(x, y, out=x)
        low[j] = np.minimum.reduceat(x, starts)
    return (-np.log1p(-((low.T >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)).astype(np.float32)


def count(sketch: np.ndarray) -> np.ndarray:
    """Unbiased counts of sketches (…, m)."""
    return (sketch.shape[-1] - 1) / sketch.sum(-1, dtype=np.float64)


def gamma_interval(m: int, z: float) -> tuple[float, float]:
    """Factors f, g such that count * f and count * g bound the true number at z standard normal deviations (Wilson-Hilferty quantiles of Gamma(m))."""
    q = lambda t: m * (1 - 1 / (9 * m) + t / (3 * np.sqrt(m))) ** 3
    return float(q(-z) / (m - 1)), float(q(z) / (m - 1))


def wilson(hits: int, of: int, z: float) -> tuple[float, float]:
    """Interval of a share; (0, 1) of nothing."""
    if not of:
        return 0.0, 1.0
    p, w = hits / of, z * z / of
    mid, half = (p + w / 2) / (1 + w), z * float(np.sqrt(p * (1 - p) / of + w / (4 * of))) / (1 + w)
    return max(0.0, mid - half), min(1.0, mid + half)


def build_sketches(df: DataFrame, keys: list[str], hashed: str, m: int = REGISTERS) -> DataFrame:
    """Partial sketches (keys, sketch BINARY) of the 64-bit hashes in `hashed`, combined within each task before anything is shuffled."""
    n = len(keys)
    schema = df.select(*keys).schema.add("sketch", "binary")
    arrow = pa_schema(df.select(*keys), "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for t in chunks(batches, CHUNK):
            ids, labels = group_ids(t, n)
            h = t.column(n).to_numpy().view(np.uint64)
            order = np.lexsort((h, ids))
            ids, h = ids[order], h[order]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
            ids, h = ids[new], np.ascontiguousarray(h[new])
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(h) else np.zeros(0, int)
            if len(starts):
                for g, s in zip(ids[starts], register_minima(h, starts, m), strict=True):
                    fold(held, labels[g], s)
            if len(held) >= HELD:
                yield emit(held, arrow, n)
                held = {}
        if held:
            yield emit(held, arrow, n)

    return df.select(*keys, hashed).where(F.col(hashed).isNotNull()).mapInArrow(run, schema)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per combination of `keys`: elementwise minima within each task, then, shuffled by the keys, across tasks.

    A key with very many partial sketches is combined before the shuffle, so no task receives more than one sketch per earlier task and key."""
    n = len(keys)
    schema = sketches.select(*keys).schema.add("sketch", "binary")
    arrow = pa_schema(sketches.select(*keys), "sketch")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, s in keyed(b, n):
                fold(held, key, s)
            if len(held) >= HELD:
                yield emit(held, arrow, n)
                held = {}
        if held:
            yield emit(held, arrow, n)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple, np.ndarray] = {}
        for b in batches:  # sorted: only the last key may go on in the next batch
            for key, s in keyed(b, n):
                fold(ready, key, s)
            if len(ready) > 256:
                last = next(reversed(ready))
                rest = {last: ready.pop(last)}
                yield emit(ready, arrow, n)
                ready = rest
        if ready:
            yield emit(ready, arrow, n)

    rows = sketches.select(*keys, "sketch").mapInArrow(local, schema)
    return (rows.repartition(*keys).sortWithinPartitions(*keys) if keys else rows.coalesce(1)).mapInArrow(final, schema)


def estimates(sketches: DataFrame, keys: list[str], m: int = REGISTERS, z: float = 1.96) -> DataFrame:
    """(keys, n_est, n_low, n_high DOUBLE): unbiased counts and their interval at z standard normal deviations."""
    n, (f, g) = len(keys), gamma_interval(m, z)
    schema = sketches.select(*keys).schema.add("n_est", "double").add("n_low", "double").add("n_high", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = count(registers(b.column(n)))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(c), pa.array(c * f), pa.array(c * g)], [*keys, "n_est", "n_low", "n_high"])

    return sketches.select(*keys, "sketch").mapInArrow(run, schema)


def novelty(sketches: DataFrame, days: int = 30, z: float = Z) -> DataFrame:
    """For each sample and day the share of the day's members that are new, from sketches (sample, count_day, sketch).

    new = absent from the sample's `days` days before. A register of the day that is the union's minimum belongs to a uniformly drawn member of the
    day, and that member is new exactly if the register lies below that of the days before: their ratio estimates the share, with Wilson's
    interval. Columns: sample, count_day, n_est, before_est (0 on a first day),
    share, share_low, share_high (bounds at z deviations). Days stream through in order; a task holds the sketches of `days` days of one sample.
    A day without earlier days within reach has share 1. Rows with a null day are left out: they belong to no day.
    """
    schema = "sample string, count_day date, n_est double, before_est double, share double, share_low double, share_high double"
    names = ["sample", "count_day", "n_est", "before_est", "share", "share_low", "share_high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, kept = None, []
        for b in batches:
            out: list[tuple] = []
            for (who, day), s in keyed(b, 2):
                if who != sample:
                    sample, kept = who, []
                kept = [(d, k) for d, k in kept if d >= day - timedelta(days=days)]
                m, n = s.shape[-1], float(count(s))
                if kept:
                    before = np.minimum.reduce([k for _, k in kept])
                    held, new = int((s <= before).sum()), int((s < before).sum())
                    low, high = wilson(new, held, z)
                    out.append((who, day, n, float(count(before)), new / held if held else None, low, high))
                else:
                    out.append((who, day, n, 0.0, 1.0, 1.0, 1.0))
                kept.append((day, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.date32(), *[pa.float64()] * 5], strict=True)], names)

    rows = merge_sketches(sketches.where(F.col("count_day").isNotNull()), ["sample", "count_day"])
    return rows.repartition("sample").sortWithinPartitions("sample", "count_day").mapInArrow(run, schema)


# --- helpers -------------------------------------------------------------------------------------------------------------------------------


def pa_schema(df: DataFrame, *binary: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(df.schema), *[pa.field(b, pa.binary()) for b in binary]])


def chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of at least `rows` rows, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_ids(t: pa.Table, n: int) -> tuple[np.ndarray, list[tuple]]:
    """A group number for each row by the first n columns (null is a value like others), and each group's key."""
    if not t.num_rows:
        return np.zeros(0, np.int64), []
    ids = np.zeros(t.num_rows, np.int64)
    for c in t.columns[:n]:
        e = c.combine_chunks().dictionary_encode(null_encoding="encode") if not isinstance(c, pa.Array) else c.dictionary_encode(null_encoding="encode")
        e = e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e
        ids = ids * max(1, len(e.dictionary)) + e.indices.to_numpy(zero_copy_only=False)
    _, first, ids = np.unique(ids, return_index=True, return_inverse=True)
    at = t.take(pa.array(first))
    columns = [c.to_pylist() for c in at.columns[:n]]
    return ids, list(zip(*columns, strict=True)) if n else [()] * len(first)


def registers(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in column])


def keyed(b: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    keys = list(zip(*[c.to_pylist() for c in b.columns[:n]], strict=True)) if n else [()] * b.num_rows
    for key, s in zip(keys, b.column(n), strict=True):
        yield key, np.frombuffer(s.as_buffer(), np.float32)


def fold(held: dict[tuple, np.ndarray], key: tuple, s: np.ndarray) -> None:
    have = held.get(key)
    held[key] = s if have is None else np.minimum(have, s)


def emit(held: dict[tuple, np.ndarray], schema: pa.Schema, n: int) -> pa.RecordBatch:
    keys = list(zip(*held, strict=True)) if n else []
    return pa.RecordBatch.from_arrays([*[pa.array(k, schema.field(i).type) for i, k in enumerate(keys)], pa.array([s.tobytes() for s in held.values()], pa.binary())], schema=schema)



def repeated_days(kmer_t: DataFrame, days: int = 30, m: int = REGISTERS) -> DataFrame:
    """(count_day STRING, sample STRING): days of a sample on which fewer than half of its distinct k-mers are new against the 30 days before.

    Sketches decide every day whose interval lies on one side of one half; the few in doubt are counted exactly. Usable rows only; rows with a
    null day are left out, repeated rows change nothing, a first day is never a case, and an empty table gives no row.
    """
    rows = usable_codes(kmer_t, "sample", "count_day")
    told = durable(novelty(build_sketches(rows.withColumn("h", F.xxhash64("code")), ["sample", "count_day"], "h", m), days).where(F.col("share_low") < 0.5))
    sure, doubt = told.where(F.col("share_high") < 0.5).select("sample", "count_day"), told.where(F.col("share_high") >= 0.5).select("sample", "count_day")
    n = doubt.count()
    if n:
        sure = sure.unionByName(new_members(rows, doubt, n, days).where("2 * new < n").select("sample", "count_day"))
    return sure.select(F.date_format("count_day", "yyyy-MM-dd").alias("count_day"), "sample")


def new_members(rows: DataFrame, wanted: DataFrame, n_wanted: int, days: int = 30) -> DataFrame:
    """(sample, count_day, n, new BIGINT) of the wanted days (sample, count_day): exact numbers of distinct k-mers of rows (sample, count_day, code) and of those that are new.

    A k-mer is new on a day if the day before on which the sample holds it is out of reach. Days within reach of at most BROADCAST wanted ones are broadcast, to
    leave out other rows; with more all rows are counted: the result is the same. Rows are combined by (sample, day, k-mer) before any shuffle, and a sample that holds
    a third of all rows is spread by its k-mers."""
    held = rows.select("sample", "count_day", "code").where("sample is not null and count_day is not null")
    if n_wanted <= BROADCAST:
        reach = wanted.select("sample", F.explode(F.sequence(F.date_sub("count_day", days), F.col("count_day"))).alias("count_day")).distinct()
        held = held.join(F.broadcast(reach), ["sample", "count_day"], "left_semi")
    before = F.lag("count_day").over(W.partitionBy("sample", "code").orderBy("count_day"))
    each = held.distinct().select("sample", "count_day", F.coalesce(F.datediff("count_day", before) > days, F.lit(True)).alias("new"))
    by_day = each.groupBy("sample", "count_day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("new").cast("bigint")).alias("new"))
    return by_day.join(wanted, ["sample", "count_day"], "left_semi")


LEVELS = {"day": ["count_day"], "sample": ["sample"], "panel": ["panel"], "panel_day": ["panel", "count_day"], "sample_day": ["sample", "count_day"], "all": []}


def _level(df: DataFrame, level: str, *more: str) -> DataFrame:
    keys = LEVELS[level]
    return df.select(F.lit(level).alias("level"), *[(F.col(c) if c in keys else F.lit(None).cast(t)).alias(c) for c, t in (("count_day", "date"), ("panel", "string"), ("sample", "string"))], *more)


def _held_keys(df: DataFrame, level: str) -> DataFrame:
    for k in LEVELS[level]:
        df = df.where(F.col(k).isNotNull())
    return df


def distinct_rollup(kmer_t: DataFrame, m: int = REGISTERS, sample_days: bool = False, z: float = 1.96) -> DataFrame:
    """Estimated numbers of distinct canonical k-mers by day, sample, panel, panel and day, in all, and by sample and day if sample_days.

    Columns: level, count_day, panel, sample (null where the level hasn't them), n_est, n_low, n_high (interval at z deviations: 95 %), rse (relative standard error).
    A row with a null day or panel counts in the levels without it. An empty table gives no row.
    """
    rows = usable_codes(kmer_t, "panel", "sample", "count_day").withColumn("h", F.xxhash64("code"))
    fine = durable(merge_sketches(build_sketches(rows, ["panel", "sample", "count_day"], "h", m), ["panel", "sample", "count_day"]))
    out = None
    for level in LEVELS:
        if level == "sample_day" and not sample_days:
            continue
        keys = ["level", *LEVELS[level]]
        e = estimates(merge_sketches(_held_keys(fine, level).withColumn("level", F.lit(level)), keys), keys, m, z)
        e = _level(e, level, "n_est", "n_low", "n_high")
        out = e if out is None else out.unionByName(e)
    return out.withColumn("rse", F.lit(float(1 / np.sqrt(m - 2))))


def distinct_exact(kmer_t: DataFrame) -> DataFrame:
    """(level, count_day, panel, sample, n BIGINT): the numbers that distinct_rollup() with sample_days estimates, counted. For tables whose sets can be held: each level shuffles its distinct k-mers."""
    rows = usable_codes(kmer_t, "panel", "sample", "count_day")
    out = None
    for level, keys in LEVELS.items():
        e = _level(_held_keys(rows, level).select(*keys, "code").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), level, "n")
        e = e.where("n > 0")
        out = e if out is None else out.unionByName(e)
    return out


def interval_check(kmer_t: DataFrame, m: int = REGISTERS, z: float = Z) -> DataFrame:
    """(level, count_day, panel, sample, n, inside): exact numbers, and whether the estimate's interval at z deviations holds them. Null where one of both has no row."""
    keys = ["level", "count_day", "panel", "sample"]
    e, n = distinct_rollup(kmer_t, m, True, z), distinct_exact(kmer_t)
    same = reduce(Column.__and__, [e[k].eqNullSafe(n[k]) for k in keys])
    return n.join(e, same, "full").select(*[F.coalesce(n[k], e[k]).alias(k) for k in keys], n["n"], F.col("n").between(F.col("n_low"), F.col("n_high")).alias("inside"))
