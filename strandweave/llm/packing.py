"""Filling fixed-capacity containers: bounded-space online best-fit packing with a final merge of leftovers.

A task keeps at most OPEN windows. An item goes into the fullest open window that still takes it; if none does and OPEN windows are open, the fullest is
closed for good. What is open at the end of a partition is a leftover: leftovers are items of a second packing of whole windows, largest first, over few partitions.
An item above the capacity is cut into full pieces, which fill a container each, and a rest; nothing else is ever divided.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.bpe import VOCABULARY, _groups, encoder, spread
from strandweave.plans.durable import durable

CAPACITY, OPEN = 2048, 64
#: Leftover windows that one task of the final merge packs.
MERGED = 20_000


class Windows:
    """Open windows as (fill, id), ascending; ids are given by `fresh`."""

    def __init__(self, capacity: int, most: int, fresh: Iterator[int]) -> None:
        self.capacity, self.most, self.fresh, self.open = capacity, most, fresh, []

    def place(self, size: int) -> int:
        """Window of an item of at most the capacity."""
        at = bisect_left(self.open, (self.capacity - size + 1, -1)) - 1
        if at >= 0:
            fill, w = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop()  # the fullest is done
            fill, w = 0, next(self.fresh)
        if fill + size < self.capacity or not size:
            insort(self.open, (fill + size, w))
        return w


def _ids(task: int) -> Iterator[int]:
    return iter(range(task << 36, (task + 1) << 36))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, windows: int = OPEN) -> DataFrame:
    """(key, piece INT, first BIGINT, n BIGINT, container BIGINT): every item's pieces and the containers that hold them.

    Sizes below 1 and null sizes are items of size 0, which take no room but have a container as well. Pieces of an item are numbered from 0 and cover
    it from `first` on without gaps; an item of at most the capacity has one. Keys may repeat; each row is an item. An empty table gives no row.
    """
    schema = sizes.select(key).schema.add("piece", "integer").add("first", "long").add("n", "long").add("window", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _ids(TaskContext.get().partitionId())
        w, kind = Windows(capacity, windows, fresh), None
        for b in batches:
            kind = b.schema.field(0).type
            n = np.maximum(np.nan_to_num(b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)), 0).astype(np.int64)
            out: list[tuple[int, int, int, int, int]] = []
            for i, s in enumerate(n.tolist()):
                full, rest = divmod(s, capacity) if s > capacity else (0, s)
                for k in range(full):
                    out.append((i, k, k * capacity, capacity, next(fresh)))
                if rest or not full:
                    out.append((i, full, full * capacity, rest, w.place(rest)))
            if out:
                row, *rest_ = (np.array(c, np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(rest_[0].astype(np.int32)), *map(pa.array, rest_[1:])], names)
        if w.open:  # one row without a piece for each leftover
            m = len(w.open)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array([f for f, _ in w.open], pa.int64()), pa.array([i for _, i in w.open], pa.int64())], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[int, int] = {}
        w = Windows(capacity, 1 << 30, iter(()))
        for b in batches:
            own = b.column(0).to_pylist()
            for x, s in zip(own, b.column(1).to_pylist(), strict=True):
                w.fresh = iter((x,))
                chosen[x] = w.place(s)
        if chosen:
            yield pa.RecordBatch.from_arrays([pa.array(list(chosen), pa.int64()), pa.array(list(chosen.values()), pa.int64())], ["window", "container"])

    placed = durable(sizes.select(key, F.col(size).cast("bigint")).mapInArrow(run, schema))
    left = placed.where("piece is null").select("window", "n")
    parts = max(1, -(-left.count() // MERGED))
    merged = left.repartition(parts, "window").sortWithinPartitions(F.desc("n"), "window").mapInArrow(merge, "window bigint, container bigint")
    return placed.where("piece is not null").join(merged, "window", "left").select(key, "piece", "first", "n", F.coalesce("container", "window").alias("container"))


def token_counts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, n BIGINT): number of tokens of each row's whole text, 0 of a null or empty one."""
    schema = df.select(key).schema.add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [len(x) // 4 for i, j in _groups(texts) for x in e.encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n"])

    return spread(df.select(key, F.col(text)), df).mapInArrow(run, schema)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Containers of the pages' texts: (doc_id, piece, first, n, container), sized in tokens."""
    return pack(token_counts(documents, "doc_id", "text", path), "doc_id", "n", capacity)


def divided(packed: DataFrame) -> DataFrame:
    """Keys of the items that had to be divided, once each."""
    return packed.where("piece = 1").drop("piece", "first", "n", "container")


def coverage(packed: DataFrame, sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, covered): whether an item's pieces, numbered from 0 and full but for the last, cover its whole size, from (key, n) of all items; keys occur once."""
    pieces = packed.groupBy(key).agg(F.min(F.col("first") == F.col("piece") * F.lit(capacity).cast("bigint")).alias("_even"), F.count(F.lit(1)).alias("_pieces"), F.max("piece").alias("_last"), F.sum("n").alias("_sum"), F.max(F.col("first") + F.col("n")).alias("_end"))
    whole = F.col("_even") & (F.col("_pieces") == F.col("_last") + 1) & (F.col("_sum") == F.col("n")) & (F.col("_end") == F.col("n")) & ((F.col("_pieces") == 1) | (F.col("n") > capacity))
    return sizes.select(key, "n").join(pieces, key, "full").select(key, F.coalesce(whole, F.lit(False)).alias("covered"))


def fullness(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, least, over BIGINT), one row: containers that hold something, as many as their contents need at least, and those beyond the capacity."""
    fill = packed.groupBy("container").agg(F.sum("n").alias("fill")).where("fill > 0")
    return fill.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity).alias("least"), F.count(F.when(F.col("fill") > capacity, 1)).alias("over"))
