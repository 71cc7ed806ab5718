"""Overlap sizes between many large sets: a blocked matrix product of 0/1 incidence tiles.

Identifiers are rows and sets are columns of an incidence matrix A; A'A holds the number of shared identifiers of each pair of sets and, on its
diagonal, each set's own number. Identifiers are hash-partitioned, so A'A is the sum of the partitions' products. Within a task identifiers are put
in order of the rarest set that holds them, so that a tile of some hundred identifiers touches few columns and only those are multiplied, a pair of blocks
of columns at a time. Results are summed in blocks of BLOCK x BLOCK integers, which are shuffled compressed and added up as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.dense import dense_ids
from strandweave.functions.kmers import usable_codes
from strandweave.llm.distinct import chunks
from strandweave.plans.durable import durable

BLOCK, TILE, WIDE = 256, 512, 64
#: Incidences that a task arranges together, and blocks that it holds before it hands them on (each 256 KB).
CHUNK, HELD = 400_000, 600
#: Names of sets (some 50 bytes each) that are broadcast with their numbers; more are joined by a shuffle.
BROADCAST = 100_000


def pair_counts(incidence: DataFrame, item: str, column: str) -> DataFrame:
    """(i, j, n BIGINT) with i <= j and n > 0: identifiers that sets i and j share; i = j gives the set's own number.

    incidence: identifier BIGINT in `item`, set number (dense from 0) in `column`; rows with a null in either are left out, repeated rows count once.
    Copies of a row fall away in the tasks that read them, so an identifier of which there are very many rows brings few to the one shuffle; what is left
    of them falls away behind it, where all rows of an identifier are side by side.
    """
    rows = incidence.select(F.col(item).alias("item"), F.col(column).cast("int").alias("col"))
    once = rows.mapInArrow(_once, "item bigint, col int")
    blocks = once.repartition("item").sortWithinPartitions("item", "col").mapInArrow(_products, "bi int, bj int, cells binary")
    return blocks.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_sums, "i bigint, j bigint, n bigint")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for CHUNK rows read."""
    for t in chunks(batches, CHUNK):
        t = t.drop_null()
        item, col = t.column(0).to_numpy(), t.column(1).to_numpy()
        order = np.lexsort((col, item))
        item, col = _distinct(item[order], col[order])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(col)], ["item", "col"])


def _distinct(items: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows without their copies."""
    new = np.r_[True, (items[1:] != items[:-1]) | (cols[1:] != cols[:-1])] if len(items) else np.zeros(0, bool)
    return items[new], cols[new]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}
    for items, cols in _whole_items(batches):
        for _ in _add_chunk(held, *_distinct(items, cols)):
            if len(held) > HELD:
                yield _packed(held)
                held.clear()
    if held:
        yield _packed(held)


def _whole_items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of the sorted rows that end between items."""
    items, cols, n = [], [], 0
    for b in batches:
        items.append(b.column(0).to_numpy())
        cols.append(b.column(1).to_numpy())
        n += b.num_rows
        if n >= CHUNK:
            a, c = np.concatenate(items), np.concatenate(cols)
            cut = int(np.searchsorted(a, a[-1]))  # the last item may go on
            if cut:
                yield a[:cut], c[:cut]
            items, cols, n = [a[cut:]], [c[cut:]], len(a) - cut
    if n:
        yield np.concatenate(items), np.concatenate(cols)


def _add_chunk(held: dict[tuple[int, int], np.ndarray], items: np.ndarray, cols: np.ndarray) -> Iterator[None]:
    """Adds the products of the chunk's tiles to the held blocks; pauses after each row of blocks, when they may be handed on."""
    own = np.bincount(cols)
    some = np.flatnonzero(own)
    for b in np.unique(some // BLOCK):
        x = some[some // BLOCK == b]
        _block(held, b, b)[x % BLOCK, x % BLOCK] += own[x]
    yield
    starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
    degree = np.diff(np.r_[starts, len(items)])
    row = np.repeat(np.arange(len(starts)), degree)
    keep = degree[row] > 1  # identifiers of one set add to the diagonal only
    row, cols = row[keep], cols[keep]
    if not len(row):
        return
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    degree = np.diff(np.r_[starts, len(row)])
    rank = np.empty(len(own), np.int64)
    rank[np.argsort(own, kind="stable")] = np.arange(len(own))
    order = np.lexsort((np.minimum.reduceat(rank[cols], starts), degree > WIDE))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    row = np.repeat(place, degree)
    by = np.argsort(row, kind="stable")
    row, cols = row[by], cols[by]
    for k in range(0, len(order), TILE):
        lo, hi = np.searchsorted(row, (k, k + TILE))
        at, c = np.unique(cols[lo:hi], return_inverse=True)
        tile = np.zeros((min(TILE, len(order) - k), len(at)), np.float32)
        tile[row[lo:hi] - k, c] = 1
        edges = np.r_[np.flatnonzero(np.r_[True, at[1:] // BLOCK != at[:-1] // BLOCK]), len(at)]
        for x in range(len(edges) - 1):
            left, r = tile[:, edges[x] : edges[x + 1]].T, at[edges[x] : edges[x + 1]]
            for y in range(x, len(edges) - 1):
                s = at[edges[y] : edges[y + 1]]
                g = (left @ tile[:, edges[y] : edges[y + 1]]).astype(np.int32)
                _block(held, r[0] // BLOCK, s[0] // BLOCK)[np.ix_(r % BLOCK, s % BLOCK)] += np.triu(g, 1) if x == y else g
            yield


def _block(held: dict[tuple[int, int], np.ndarray], i: int, j: int) -> np.ndarray:
    key = (int(i), int(j))
    if key not in held:
        held[key] = np.zeros((BLOCK, BLOCK), np.int32)
    return held[key]


def _packed(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    cells = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in held.values()]
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array(cells, pa.binary())], ["bi", "bj", "cells"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total = None, np.zeros((0, 0), np.int64)
    for b in batches:
        for i, j, cells in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (i, j) != at:
                if at:
                    yield from _cells(at, total)
                at, total = (i, j), np.zeros((BLOCK, BLOCK), np.int64)
            total += np.frombuffer(pa.decompress(cells, BLOCK * BLOCK * 4, codec="zstd"), np.int32).reshape(BLOCK, BLOCK)
    if at:
        yield from _cells(at, total)


def _cells(at: tuple[int, int], total: np.ndarray) -> Iterator[pa.RecordBatch]:
    r, c = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(r + at[0] * BLOCK, pa.int64()), pa.array(c + at[1] * BLOCK, pa.int64()), pa.array(total[r, c], pa.int64())], ["i", "j", "n"])


def sample_overlaps(kmer_t: DataFrame, least_percent: int = 0) -> DataFrame:
    """(s1, s2, shared, n1, n2 BIGINT, share DOUBLE) of every pair s1 < s2 of samples that share a k-mer; share = shared / least(n1, n2).

    least_percent keeps only pairs with share >= least_percent / 100, compared in whole numbers. Usable rows and canonical k-mers; repeated rows,
    files and days count once; pairs that share nothing have no row; an empty table gives none.
    """
    rows = usable_codes(kmer_t, "sample")
    ids = dense_ids(kmer_t.select("sample"), "sample", "sid")
    near = F.broadcast(ids) if ids.count() <= BROADCAST else ids  # without the hint the checkpointed ids have no known size, and the rows would be shuffled for them
    cells = durable(pair_counts(rows.join(near, "sample").select(F.col("code").alias("item"), "sid"), "item", "sid"))
    own = cells.where("i = j").join(ids, F.col("i") == F.col("sid")).select("sid", "sample", "n")
    a, b = own.select(F.col("sid").alias("i"), F.col("sample").alias("s1"), F.col("n").alias("n1")), own.select(F.col("sid").alias("j"), F.col("sample").alias("s2"), F.col("n").alias("n2"))
    pairs = cells.where("i < j").withColumnRenamed("n", "shared").join(a, "i").join(b, "j")
    if least_percent:
        pairs = pairs.where(F.col("shared") * 100 >= F.least("n1", "n2") * least_percent)
    return pairs.select("s1", "s2", "shared", "n1", "n2", (F.col("shared") / F.least("n1", "n2")).alias("share"))
