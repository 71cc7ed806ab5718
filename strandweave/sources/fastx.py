"""FASTA and FASTQ files as a Spark data source, plain, gzip or bzip2.

`spark.read.format("fastx").load(folder)` gives (sample, file, read_id, name, comment, seq, qual). A folder below the data folder is a sample; a loose
file is a sample of its own. Plain files are cut by offsets, so that a large file is read by many tasks; compressed ones are a partition each, as they can't be
cut. The format is told by each file's first character, and records come as a stream of Arrow batches, never a file as a whole. The folder must be mounted
under the same path on all machines.
"""

from __future__ import annotations

import bz2
import gzip
import os
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample string, file string, read_id bigint, name string, comment string, seq string, qual string"
ARROW = pa.schema([("sample", pa.string()), ("file", pa.string()), ("read_id", pa.int64()), ("name", pa.string()), ("comment", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
#: Bytes of a plain file that a task reads, and records of an Arrow batch.
SPLIT, BATCH = 128 << 20, 4096
#: read_ids are the partition's number and the record's within it.
IDS = 40


def opened(path: str) -> BinaryIO:
    how = gzip.open if path.endswith(".gz") else bz2.open if path.endswith(".bz2") else open
    return how(path, "rb")


def is_compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2"))


def sample_of(path: Path, root: Path, naming: str = "pair") -> str:
    """The first folder below the root; of a loose file x.y.fa its first two dotted parts as x_y (naming `pair`), or the first part alone (`stem`)."""
    inner = path.relative_to(root).parts
    if len(inner) > 1:
        return inner[0]
    parts = [p for p in path.name.split(".")]
    return "_".join(parts[:2]) if naming == "pair" and len(parts) > 2 and parts[1] not in ("fa", "fq", "fasta", "fastq") else parts[0]


def discover(root: str, naming: str = "pair") -> list[tuple[str, str]]:
    """(sample, path) of all read files, sorted; hidden files and editors' copies (~) are left out. Two loose files or a folder of the same sample name are an error."""
    base = Path(root)
    files = [base] if base.is_file() else sorted(p for p in base.rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(base).parts) and not p.name.endswith("~"))
    base = base.parent if base.is_file() else base
    out = [(sample_of(p, base, naming), str(p)) for p in files]
    loose = [s for s, p in out if Path(p).parent == base]
    folders = {s for s, p in out if Path(p).parent != base}
    if len(set(loose)) < len(loose) or folders & set(loose):
        raise ValueError("two samples of the same name")
    return sorted(out)


Line = tuple[int, str]


def lines_from(f: BinaryIO, start: int) -> Iterator[Line]:
    """(offset, line) of every line that begins at or after `start`, without its end of whatever kind."""
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
    for x in f:
        yield at, x.decode("utf-8", "replace").rstrip("\r\n")
        at += len(x)


def records(lines: Iterator[Line], end: float = float("inf"), kind: str | None = None) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, seq, qual) of the records that begin before `end`; qual is null for FASTA. Empty FASTA records and a FASTQ record that the file's end cuts off are left out.

    kind: the file's first character, for lines that needn't begin with a record; those before the first are left to whoever reads what lies before."""
    if kind is None:
        first = next((x for x in lines if x[1].strip()), None)
        if first is None:
            return
        kind, lines = first[1][0], chain([first], lines)
    elif kind == ">":
        lines = _skipped(lines, lambda w: w[0][1].startswith(">"))
    elif kind == "@":  # a quality line may begin like a header, but what comes two lines after a header begins with a plus
        lines = _skipped(lines, lambda w: w[0][1].startswith("@") and len(w) > 2 and w[2][1].startswith("+"))
    head = lambda x: (*x[1:].split(None, 1), "", "")[:2]
    if kind == ">":
        name, parts = None, []
        for at, x in lines:
            if x.startswith(">"):
                if parts:
                    yield (*name, "".join(parts), None)
                if at >= end:
                    return
                name, parts = head(x), []
            elif x:
                parts.append(x)
        if parts:
            yield (*name, "".join(parts), None)
    elif kind == "@":
        while (first := next((x for x in lines if x[1]), None)) is not None and first[0] < end:
            seq = next(lines, None)
            for _, x in lines:
                if x.startswith("+"):
                    break
            qual = next(lines, None)
            if seq is None or qual is None:
                return
            yield (*head(first[1]), seq[1], qual[1])
    else:
        raise ValueError("neither FASTA nor FASTQ")


def _skipped(lines: Iterator[Line], begins: object) -> Iterator[Line]:
    """The lines from the first on at which a record begins, by it and the two after it."""
    w = list(islice(lines, 3))
    while w and not begins(w):
        w = [*w[1:], *islice(lines, 1)]
    return chain(w, lines)


def first_character(path: str) -> str | None:
    with opened(path) as f:
        return next((x[1].lstrip()[0] for x in lines_from(f, 0) if x[1].strip()), None)


class _Part(InputPartition):
    def __init__(self, number: int, sample: str, path: str, start: int, end: float) -> None:
        self.number, self.sample, self.path, self.start, self.end = number, sample, path, start, end


def parts_of(files: list[tuple[str, str]], split: int = SPLIT) -> list[_Part]:
    out: list[_Part] = []
    for sample, path in files:
        size = os.path.getsize(path)
        cuts = [0] if is_compressed(path) else list(range(0, max(size, 1), split))
        out += [_Part(len(out) + i, sample, path, c, e) for i, (c, e) in enumerate(zip(cuts, [*cuts[1:], float("inf")], strict=True))]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.naming, self.split = options["path"], options.get("naming", "pair"), int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return parts_of(discover(self.root, self.naming), self.split)

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kind = first_character(partition.path) if partition.start else None
        with opened(partition.path) as f:
            found = records(lines_from(f, partition.start), partition.end, kind)
            n = partition.number << IDS
            while some := list(islice(found, BATCH)):
                columns = [pa.array(c, pa.string()) for c in zip(*some, strict=True)]
                same = [pa.array([x] * len(some), pa.string()) for x in (partition.sample, os.path.basename(partition.path))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n, n + len(some)), pa.int64()), *columns], schema=ARROW)
                n += len(some)


class FastxSource(DataSource):
    """Options: path, naming (pair or stem), split (bytes of a plain file that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_fastx(spark: SparkSession, path: str, naming: str = "pair", split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("naming", naming).option("split", split).load(path)
