"""Items that appear together: stripes, merged by key, and the significance of a log-likelihood ratio.

A record is a pair (group, record id) and holds items of its group. The stripe of an item is an associative array from the items that occur
with it to the number of records. Tasks build stripes over whole records, combine them before the shuffle and merge them, as a stream, by
item after it. No pair of a record ever becomes a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dense import row_numbers
from strandweave.functions.kmers import usable_codes
from strandweave.llm.distinct import chunks
from strandweave.plans.durable import durable

#: Incidences that a task turns into stripes together, and array entries that it holds before it hands its stripes on.
CHUNK, HELD = 200_000, 2_000_000
#: Items of a record up to which all records of a chunk are taken together, a distance between places at a time; longer ones are taken one by one.
WIDE = 64
#: Names of items (some 80 bytes each) that are broadcast with their numbers; more are joined by a shuffle.
BROADCAST = 100_000
STRIPE = "x int, others array<int>, counts array<bigint>"
#: Probability, under independence, below which items are said to occur together more often than by chance.
LEVEL = 0.001


def stripes(rows: DataFrame) -> DataFrame:
    """Merged stripes (x, others, counts) of rows (rec, g, x): items numbered from 0 and of each the number of its group. Rows with a null record are left out.

    An item's stripe holds the item itself, with the number of its records, and those after it. A group's number of records is the stripe of
    -1 - g. Repeated rows count once: copies fall away in the tasks that read them, so a record of which there are very many brings few to the shuffle, and
    behind it, where a record's rows are side by side.
    """
    parts = rows.select("rec", "g", "x").mapInArrow(_once, rows.select("rec", "g", "x").schema).repartition("rec", "g").sortWithinPartitions("rec", "g", "x").mapInArrow(_build, STRIPE)
    return parts.repartition("x").sortWithinPartitions("x").mapInArrow(_merge, STRIPE)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, CHUNK):
        t = t.filter(pc.is_valid(t["rec"]))
        yield from t.group_by(["rec", "g", "x"], use_threads=False).aggregate([]).select(["rec", "g", "x"]).combine_chunks().to_batches()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    entries = 0
    for rec, g, x in _whole_records(batches):
        start = (rec[1:] != rec[:-1]) | (g[1:] != g[:-1])
        new = np.r_[True, start | (x[1:] != x[:-1])]
        x, first = x[new].astype(np.int64), np.flatnonzero(np.r_[True, start][new])
        degree = np.diff(np.r_[first, len(x)])
        held.append(_counted((-1 - g[new][first].astype(np.int64)) << 32))
        held.append(_counted(x << 32 | x))
        ordinal = np.repeat(np.arange(len(first)), degree)
        narrow = (degree <= WIDE)[ordinal]
        y, o = x[narrow], ordinal[narrow]
        step = 1
        while len(a := np.flatnonzero(o[step:] == o[:-step])):  # neighbours at distance `step` within a record, for all records at once
            held.append(_counted(y[a] << 32 | y[a + step]))
            step += 1
        for r in np.flatnonzero(degree > WIDE):
            some = x[first[r] : first[r] + degree[r]]
            for i in range(len(some) - 1):
                held.append((some[i] << 32 | some[i + 1 :], np.ones(len(some) - i - 1, np.int64)))
                entries += len(some) - i - 1
                if entries >= HELD:
                    held, entries = [_added(held)], 0
                    if len(held[0][0]) >= HELD:
                        yield _out(*held.pop())
        entries = sum(len(k) for k, _ in held)
        if entries >= HELD:
            held = [_added(held)]
            entries = len(held[0][0])
            if entries >= HELD:
                yield _out(*held.pop())
                entries = 0
    if held:
        yield _out(*_added(held))


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (record, group, item) of the sorted rows that end between records; a record's id is a number that is its own within a chunk."""
    held: list[pa.RecordBatch] = []
    n, goal = 0, CHUNK
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= goal:
            t = pa.Table.from_batches(held).combine_chunks()
            rec, g, x = _numbers(t)
            last = np.flatnonzero((rec != rec[-1]) | (g != g[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield rec[:cut], g[:cut], x[:cut]
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
            goal = max(CHUNK, 2 * n)  # a long record isn't looked at anew for each batch
    if n:
        yield _numbers(pa.Table.from_batches(held).combine_chunks())


def _numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rec = t.column(0).combine_chunks()
    rec = rec.chunk(0) if isinstance(rec, pa.ChunkedArray) else rec
    rec = rec if pa.types.is_integer(rec.type) else rec.dictionary_encode().indices
    return rec.to_numpy(zero_copy_only=False), t.column(1).to_numpy(), t.column(2).to_numpy()


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.unique(keys, return_counts=True)
    return k, n.astype(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Entries (item << 32 | other, count) in order, those of one key added up."""
    k, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _out(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Entries in order as stripes."""
    x, first = np.unique(k >> 32, return_index=True)
    ends = pa.array(np.r_[first, len(k)].astype(np.int32))
    others = pa.ListArray.from_arrays(ends, pa.array((k & 0xFFFFFFFF).astype(np.uint32).view(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), others, pa.ListArray.from_arrays(ends, pa.array(n))], ["x", "others", "counts"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:  # sorted: only the last item may go on in the next batch
        if not b.num_rows:
            continue
        x = np.repeat(b.column(0).to_numpy().astype(np.int64), np.diff(b.column(1).offsets.to_numpy()))
        k, n = _added([*held, (x << 32 | b.column(1).flatten().to_numpy().view(np.uint32), b.column(2).flatten().to_numpy())])
        cut = int(np.searchsorted(k, (k[-1] >> 32) << 32))
        if cut:
            yield _out(k[:cut], n[:cut])
        held = [(k[cut:], n[cut:])]
    if held:
        yield _out(*_added(held))


def log_likelihood_ratio(n12: Column, n1: Column, n2: Column, n: Column) -> Column:
    """Dunning's G2 of two items: n12 records hold both, n1 and n2 each, of n records."""
    cells = ((n12, n1, n2), (n1 - n12, n1, n - n2), (n2 - n12, n - n1, n2), (n - n1 - n2 + n12, n - n1, n - n2))
    term = lambda k, r, c: F.when(k > 0, k * F.log(k.cast("double") * n / (r.cast("double") * c))).otherwise(0.0)
    a, b, c, d = (term(*x) for x in cells)
    return F.greatest(2 * (a + b + c + d), F.lit(0.0))


def critical_value(level: float) -> float:
    """The ratio that independent items exceed with probability `level`: a quantile of chi-square of one degree of freedom."""
    return NormalDist().inv_cdf(1 - level / 2) ** 2


# Coefficients of a published rational approximation of erfc whose relative error is below 1.2e-7
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def p_value(ratio: Column) -> Column:
    """Probability that independent items have a ratio at least as large, whatever its sign: erfc of the root of half of it."""
    z = F.sqrt(F.abs(ratio) / 2)
    t = 1 / (1 + z / 2)
    series = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        series = c + t * series
    return t * F.exp(series - z * z)


def cooccurrence(records: DataFrame, level: float = LEVEL, sets: DataFrame | None = None) -> DataFrame:
    """(grp, a, b, n12, n1, n2, n, lift, llr, p_value, significant) of every pair a < b of items that occur in one record of (grp, rec, item).

    lift = n12 * n / (n1 * n2); llr is the log-likelihood ratio, signed: negative where the items occur together less often than by chance; p_value is that of the
    ratio; significant: llr is at least critical_value(level). sets: (grp, item) of all items, if these are to be had for less than from the records; others do no harm. Rows with a null in any of the three columns are left out, repeated rows count once. An empty table gives no row.
    """
    items = durable(row_numbers((records if sets is None else sets).select("grp", "item").dropna().distinct(), "grp", "item", name="x").withColumn("x", F.col("x").cast("int")))
    items = durable(items.join(items.groupBy("grp").agg(F.min("x").alias("g")), "grp"))
    near = F.broadcast(items) if items.count() <= BROADCAST else items
    merged = durable(stripes(records.select("grp", "rec", "item").join(near, ["grp", "item"]).select("rec", "g", "x")))
    cells = merged.where("x >= 0").select("x", F.explode(F.arrays_zip("others", "counts")).alias("e")).select("x", F.col("e.others").alias("y"), F.col("e.counts").alias("n12"))
    total = merged.where("x < 0").select((-1 - F.col("x")).alias("g"), F.col("counts")[0].alias("n"))
    known = items.join(cells.where("x = y").select("x", F.col("n12").alias("n1")), "x").join(total, "g")
    one = known.select("x", "grp", F.col("item").alias("a"), "n1", "n")
    two = known.select(F.col("x").alias("y"), F.col("item").alias("b"), F.col("n1").alias("n2"))
    pairs = cells.where("x < y").join(one, "x").join(two, "y")
    lift = F.col("n12").cast("double") * F.col("n") / (F.col("n1").cast("double") * F.col("n2"))
    g2 = log_likelihood_ratio(*[F.col(c) for c in ("n12", "n1", "n2", "n")])
    rated = pairs.select("grp", "a", "b", "n12", "n1", "n2", "n", lift.alias("lift"), F.when(lift < 1, -g2).otherwise(g2).alias("llr"))
    return rated.select("*", p_value(F.col("llr")).alias("p_value"), (F.col("llr") >= critical_value(level)).alias("significant"))


def sample_cooccurrence(kmer_t: DataFrame, level: float = LEVEL) -> DataFrame:
    """(panel, s1, s2, n12, n1, n2, n, lift, llr, p_value, significant): samples of one panel that hold the same canonical k-mers, s1 < s2.

    Usable rows; rows with a null panel belong to no panel and are left out."""
    rows = usable_codes(kmer_t, "panel", "sample").select(F.col("panel").alias("grp"), F.col("code").alias("rec"), F.col("sample").alias("item"))
    return cooccurrence(rows, level, kmer_t.select(F.col("panel").alias("grp"), F.col("sample").alias("item"))).withColumnsRenamed({"grp": "panel", "a": "s1", "b": "s2"})


def more_than_chance(pairs: DataFrame, hundredths: int = 175) -> DataFrame:
    """Pairs with a positive log-likelihood ratio and lift >= hundredths / 100, compared in whole numbers. From a lift of above 1 on the ratio is always positive."""
    d = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(F.col("llr") > 0).where(d("n12") * d("n") * F.lit(100) >= d("n1") * d("n2") * F.lit(hundredths))
