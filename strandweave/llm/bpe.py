"""Encoding with a public byte-level BPE vocabulary: a hierarchical-bitmap rank queue.

Merging always takes the pair of lowest rank, leftmost first. Positions of a linked list wait in one bucket per merge rank; a bitmap of 64-bit words, with
a bit in the level above for every word that isn't 0, tells by find-first-set which bucket is next. A position whose pair has changed since
it was put into a bucket is stale and skipped. Each merge costs the same however long the pre-token is. Pre-tokens don't affect one another, so
those that a batch of texts needs for the first time are merged in one list with gaps between them.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-token pattern
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of a stretch that is remembered, and stretches that a process remembers.
REMEMBERED, MEMORY = 48, 400_000
#: Characters of the texts that are encoded together.
TOGETHER = 4_000_000
#: Bytes a core below which a table is spread.
SMALL = 4 << 20


class Ranks:
    """Waiting positions by merge rank."""

    def __init__(self, n: int) -> None:
        self.levels = []
        while True:
            n = -(-n // 64)
            self.levels.append([0] * n)
            if n == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, position: int) -> None:
        b = self.buckets.get(rank)
        if b is not None:
            heapq.heappush(b, position)
        else:
            self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """An ascending list for an empty bucket."""
        self.buckets[rank] = positions
        for words in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            full = words[word]
            words[word] = full | bit
            if full:
                return
            rank = word

    def first(self) -> int:
        """Lowest rank with a bucket, or -1."""
        at = 0
        for words in reversed(self.levels):
            w = words[at]
            if not w:
                return -1
            at = at << 6 | (w & -w).bit_length() - 1
        return at

    def clear(self, rank: int) -> None:
        del self.buckets[rank]
        for words in self.levels:
            word = rank >> 6
            words[word] &= ~(1 << (rank & 63))
            if words[word]:
                return
            rank = word


class Encoder:
    """Token ids of texts; special tokens' strings are ordinary text."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.text = [b""] * self.size
        for t, r in self.ranks.items():
            self.text[r] = t
        one = [bytes([i]) for i in range(256)]
        self.byte = np.array([self.ranks[b] for b in one], np.int64)
        self.byte_pair = np.array([[self.ranks.get(a + b, -1) for b in one] for a in one], np.int64)
        self.pairs: dict[int, int] = {}
        self.split = regex.compile(pattern).findall
        # a space belongs to what follows it, so text can be cut before it: these stretches always begin and end at pre-tokens
        # White space as the pattern understands it (without the separators U+001C to U+001F)
        space = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.stretches = re.compile(f" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]").findall
        self.known: dict[str, bytes] = {}

    def pair(self, a: int, b: int) -> int:
        key = a * self.size + b
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.text[a] + self.text[b], -1)
        return r

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token (none of them empty)."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(raw), np.cumsum([len(p) for p in pieces])
        if not n:
            return []
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.r_[0, ends[:-1]]] = -1
        at = np.r_[self.byte_pair[raw[:-1], raw[1:]], -1]
        at[ends - 1] = -1
        queue = Ranks(self.size)
        waiting = np.flatnonzero(at >= 0)
        waiting = waiting[np.argsort(at[waiting], kind="stable")]
        ranks, starts = np.unique(at[waiting], return_index=True)
        for r, some in zip(ranks.tolist(), np.split(waiting, starts[1:]), strict=True):
            queue.fill(r, some.tolist())
        ids, nxt, prv, now = self.byte[raw].tolist(), after.tolist(), before.tolist(), at.tolist()
        pair, put, pop = self.pair, queue.put, heapq.heappop
        while (r := queue.first()) >= 0:
            bucket = queue.buckets[r]
            while bucket:
                p = pop(bucket)
                if now[p] != r:
                    continue  # stale
                q = nxt[p]
                s = nxt[q]
                ids[p], ids[q], now[q], nxt[p] = r, -1, -1, s
                least = r
                if s >= 0:
                    prv[s] = p
                    now[p] = x = pair(r, ids[s])
                    if x >= 0:
                        put(x, p)
                        least = x if x < least else least
                else:
                    now[p] = -1
                o = prv[p]
                if o >= 0:
                    now[o] = x = pair(ids[o], r)
                    if x >= 0:
                        put(x, o)
                        least = x if x < least else least
                if least < r:
                    break
            if not bucket:
                queue.clear(r)
        out = np.array(ids, np.int32)
        alive = out >= 0
        cuts = np.cumsum(alive)[ends - 1]
        return np.split(out[alive], cuts[:-1])

    def learn(self, stretches: set[str]) -> dict[str, bytes]:
        """Ids (int32, little-endian) of stretches of text that aren't remembered."""
        split = {s: [p.encode() for p in self.split(s)] for s in stretches}
        hard = list({p for ps in split.values() for p in ps if p not in self.ranks})
        ids = {p: x.astype("<i4").tobytes() for p, x in zip(hard, self.merge(hard), strict=True)}
        for ps in split.values():
            for p in ps:
                if p not in ids:
                    ids[p] = self.ranks[p].to_bytes(4, "little")
        return {s: b"".join([ids[p] for p in ps]) for s, ps in split.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes; of a null or an empty text none."""
        cut = [self.stretches(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        found = self.learn(new) if new else {}
        if len(self.known) + len(found) > MEMORY:
            found |= {s: self.known[s] for s in set(chain.from_iterable(cut)) if s in self.known}
            self.known = {}
        self.known.update(found)
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for s in found:
            if len(s) > REMEMBERED:
                self.known.pop(s, None)
        return out


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The process's encoder, with what it remembers."""
    return Encoder(path)


def spread(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, columns of `table`, moved to as many partitions as there are cores if the table is so small that a scan leaves cores idle: smaller than what Spark counts for opening a file, for each core.

    Work on texts is dear for their size, and Spark gives a small table, or one of a single row group, to one task. A larger table stays where it lies. No result depends on this."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= TOGETHER:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row. Null and empty texts give an empty list; no special tokens; whole texts, in the scan's partitions, without a shuffle (see spread()).

    Keys may be null or repeat: each row gives one row. `path` is the vocabulary's file on every executor."""
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _groups(texts):
                ids = e.encode(texts[i:j])
                offsets = np.zeros(j - i + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])

    return spread(df.select(key, F.col(text)), df).mapInArrow(run, schema)
