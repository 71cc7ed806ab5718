"""Most frequent items among billions: a hierarchical count-sketch over hash-bit prefixes, verified by a second scan.

An item is its 64-bit hash. For each of a few prefix lengths, each task keeps a count-sketch (DEPTH rows of WIDTH signed counters) of the amounts by
prefix; sketches are added up, so their memory depends on neither the rows nor the distinct items. Starting with all prefixes of the shortest length,
the descent extends those prefixes whose estimate (median over the rows) can still reach the k-th largest, given the sketch's error. Items under the
longest heavy prefixes are candidates; a second scan adds up their amounts exactly. Where the amounts are so even that the candidates' prefixes are too many to
be listed, the second scan asks the sketch itself whether an item's prefixes are all heavy: the candidates are the same, and no list of them exists anywhere. If
the exact k-th sum shows that the descent's threshold was too high to be sure of the answer, the descent starts again with a lower one.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.kmers import decode_2bit, usable_codes
from strandweave.llm.distinct import chunks
from strandweave.plans.durable import durable

DEPTH, WIDTH = 5, 1 << 16
LEVELS = (12, 18, 24, 30, 36, 42)
#: Standard errors that an estimate is allowed to be wrong by.
SURE = 4.0
#: Prefixes that a level of the descent may look at on the driver, and listed candidates (8 bytes each) that are broadcast; beyond these the sketch takes the list's place.
MOST, MAX_BROADCAST = 1 << 22, 100_000
#: Share of the k-th largest estimate that the descent goes down to at first: estimates also hold what was delivered again, so the exact k-th sum lies below.
FIRST = 0.75
#: Counters of a sketch row that make one row of the shuffle.
CELL = 1 << 12
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_B = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def slots(prefixes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each prefix in a row of a level's sketch."""
    x = (prefixes + np.uint64(level << 56)) * _A[row]
    x ^= x >> np.uint64(29)
    x *= _B[row]
    x ^= x >> np.uint64(32)
    return (x & np.uint64(WIDTH - 1)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def build(hashes: DataFrame) -> np.ndarray:
    """The summed sketch (levels, DEPTH, WIDTH) of rows (hash BIGINT, amount BIGINT): LEVELS x DEPTH x WIDTH x 8 bytes, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, some = np.zeros((len(LEVELS), DEPTH, WIDTH)), False
        for t in chunks(batches, 1 << 16):
            t = t.filter(pc.is_valid(t["hash"]))
            if not t.num_rows:
                continue
            h, back = np.unique(t.column(0).to_numpy().view(np.uint64), return_inverse=True)
            amount = np.bincount(back, weights=t.column(1).to_numpy())
            some = True
            for i, bits in enumerate(LEVELS):
                p = h >> np.uint64(64 - bits)
                for r in range(DEPTH):
                    at, sign = slots(p, bits, r)
                    s[i, r] += np.bincount(at, weights=sign * amount, minlength=WIDTH)
        if some:
            flat = s.reshape(-1, CELL)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([pa.compress(x.astype(np.int64).tobytes(), codec="zstd", asbytes=True) for x in flat], pa.binary())], ["cell", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, np.zeros(0, np.int64)
        for b in batches:
            for cell, sums in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.frombuffer(pa.decompress(sums, CELL * 8, codec="zstd"), np.int64)
                if cell == at:
                    s = s + x
                    continue
                if at is not None:
                    yield _cell(at, s)
                at, s = cell, x
        if at is not None:
            yield _cell(at, s)

    schema = "cell int, sums binary"
    sums = hashes.select("hash", "amount").mapInArrow(run, schema).repartition("cell").sortWithinPartitions("cell").mapInArrow(total, schema)
    out = np.zeros((len(LEVELS) * DEPTH * WIDTH // CELL, CELL), np.int64)
    for cell, s in sums.collect():  # as many rows as a sketch has cells
        out[cell] = np.frombuffer(pa.decompress(bytes(s), CELL * 8, codec="zstd"), np.int64)
    return out.reshape(len(LEVELS), DEPTH, WIDTH).astype(np.float64)


def _cell(at: int, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pa.compress(s.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["cell", "sums"])


def estimate(sketch: np.ndarray, level: int, prefixes: np.ndarray) -> np.ndarray:
    rows = []
    for r in range(DEPTH):
        at, sign = slots(prefixes, LEVELS[level], r)
        rows.append(sketch[level, r, at] * sign)
    return np.median(rows, axis=0)


def noise(sketch: np.ndarray, level: int) -> float:
    """Standard error of one row's estimate, from quantiles of the counters' magnitude: a few heavy items, which the median over rows ignores, don't raise it. The largest of
    the quantiles' answers counts, as most counters are 0 where there are fewer items than counters."""
    return max(float(np.quantile(np.abs(sketch[level]), q)) / NormalDist().inv_cdf((1 + q) / 2) for q in (0.5, 0.75, 0.9))


def heavy_prefixes(sketch: np.ndarray, least: float) -> np.ndarray | None:
    """Prefixes of the last level whose estimates, and those of all their shorter prefixes, are within SURE errors of `least` or above; None if a level would have more than MOST to look at."""
    p = np.zeros(1, np.uint64)
    for i, bits in enumerate(LEVELS):
        more = bits - (LEVELS[i - 1] if i else 0)
        if len(p) << more > MOST:
            return None
        p = ((p[:, None] << np.uint64(more)) | np.arange(1 << more, dtype=np.uint64)[None, :]).ravel()
        p = p[estimate(sketch, i, p) >= least - SURE * noise(sketch, i)]
    return p


def is_heavy(sketch: np.ndarray, least: float, hashes: np.ndarray) -> np.ndarray:
    """Of hashes (uint64) those whose prefixes of all levels are heavy: exactly the items under heavy_prefixes()."""
    at = np.arange(len(hashes))
    for i, bits in enumerate(LEVELS):
        at = at[estimate(sketch, i, hashes[at] >> np.uint64(64 - bits)) >= least - SURE * noise(sketch, i)]
    out = np.zeros(len(hashes), bool)
    out[at] = True
    return out


def candidates(hashed: DataFrame, sketch: np.ndarray, least: float) -> DataFrame:
    """The rows (item, amount, delivery, hash) of candidates, picked where they lie: by a broadcast list of at most MAX_BROADCAST prefixes or else by the broadcast sketch, which is of fixed size; in both ways the same rows."""
    p = heavy_prefixes(sketch, least)
    listed = p is not None and len(p) <= MAX_BROADCAST
    spread = hashed.sparkSession.sparkContext.broadcast(np.sort(p) if listed else sketch)

    def heavy(h: np.ndarray) -> np.ndarray:
        return np.isin(h >> np.uint64(64 - LEVELS[-1]), spread.value) if listed else is_heavy(spread.value, least, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column("hash")))
            if b.num_rows:
                yield b.filter(pa.array(heavy(b.column("hash").to_numpy().view(np.uint64))))

    return hashed.mapInArrow(run, hashed.schema)


def threshold(sketch: np.ndarray, k: int) -> float:
    """A first threshold: a lower bound of the k-th largest estimate that a greedy descent along the 8k best prefixes finds."""
    p = np.arange(1 << LEVELS[0], dtype=np.uint64)
    est = np.zeros(0)
    for i, bits in enumerate(LEVELS):
        if i:
            more = bits - LEVELS[i - 1]
            p = ((p[:, None] << np.uint64(more)) | np.arange(1 << more, dtype=np.uint64)[None, :]).ravel()
        est = estimate(sketch, i, p)
        best = np.argsort(-est)[: 8 * k]
        p, est = p[best], est[best]
    return float(np.sort(est)[::-1][: min(k, len(est))][-1])


def heaviest(rows: DataFrame, item: str, amount: str, delivery: str, k: int = 20) -> DataFrame:
    """(item, approx BIGINT, total BIGINT): the k items with the largest sums of `amount` over distinct deliveries, ties by the item's order.

    The first scan adds up every row, deliveries repeated or not, and counts negative amounts as 0: its sums are upper bounds, so no item of the answer
    is missed on their account. The second scan keeps only rows of candidates, counts rows of one delivery once (a null delivery is one of its own) and is
    exact. `approx` is the sketch's estimate of the item's own longest prefix. Null items are left out, a null amount adds nothing, fewer than k items give
    them all (with sums of at least 1 if there are more than the descent can tell from 0), an empty table gives none.
    """
    d = rows.select(F.col(item).alias("item"), F.col(amount).cast("bigint").alias("amount"), F.col(delivery).alias("delivery"))
    hashed = d.withColumn("hash", F.when(F.col("item").isNotNull(), F.xxhash64("item")))  # null items, of null hash, fall away in the tasks: a filter would make the item twice
    sketch = build(hashed.select("hash", F.greatest(F.coalesce("amount", F.lit(0)), F.lit(0)).alias("amount")))
    least = max(1.0, FIRST * threshold(sketch, k))
    while True:
        once = candidates(hashed, sketch, least).groupBy("item", "hash", "delivery").agg(F.max("amount").alias("one"), F.sum("amount").alias("each"))
        total = F.sum(F.coalesce(F.when(F.col("delivery").isNull(), F.col("each")).otherwise(F.col("one")), F.lit(0))).alias("total")
        best = durable(once.groupBy("item", "hash").agg(total).orderBy(F.desc("total"), "item").limit(k))
        found = [(r.hash, r.total) for r in best.select("hash", "total").orderBy("total").collect()]  # k rows
        if (len(found) == k and found[0][1] >= least) or least <= 1.0:
            break
        least = max(1.0, min(least / 2, float(found[0][1]) if len(found) == k else 1.0))
    h = np.array([x for x, _ in found], np.int64)
    approx = np.rint(estimate(sketch, len(LEVELS) - 1, h.view(np.uint64) >> np.uint64(64 - LEVELS[-1]))).astype(np.int64)
    own = rows.sparkSession.createDataFrame(pa.table({"hash": pa.array(h), "approx": pa.array(approx)}))
    return best.join(F.broadcast(own.distinct()), "hash").select("item", "approx", "total")


def heaviest_kmers(kmer_t: DataFrame, k: int = 20) -> DataFrame:
    """(kmer, approx, total): the k canonical k-mers with the largest sums of cnt over distinct rec_id, of the usable rows."""
    best = heaviest(usable_codes(kmer_t, "rec_id", "cnt"), "code", "cnt", "rec_id", k)
    return best.select(decode_2bit("item", 21).alias("kmer"), "approx", "total")
