"""A data source that reads files of transforms in splits, and a sink whose tasks write one file together.

Both use Spark's Python Data Source API. A split is a range of a file's bytes, so a file may have any size and no task or
driver holds it. The sink writes every chunk of bytes at its own place in the file, by whichever task has it;
the driver only learns how many bytes there were, puts the header and padding around them and gives the file its name.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import codecs

#: Bytes that are decoded at a time, and bytes of a split; multiples of the native block.
CHUNK, SPLIT = 1 << 20, 64 << 20
PIECES = "chunk long, inside long, c int, len long"
#: What a file is read as besides its pieces: one row for each chunk, with its place in the file and the first and the last of its maximal runs.
SHAPES = {
    "pieces": PIECES,
    "ends": "chunk long, at long, stop long, bases long, sequences long, pieces long, m long, first int, last int, first_len long",
}
RUNS = "run_id long, start long, c int, len long"


def _columns(shape: str, chunk: int, at: int, stop: int, symbols: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The columns of a shape for one chunk, the bytes [at, stop) of a file."""
    if shape == "pieces":
        return [np.full(len(symbols), chunk), np.cumsum(lengths) - lengths, symbols.astype(np.int32), lengths]
    pieces = len(symbols)
    c, size = _maximal(symbols, lengths)
    row = [chunk, at, stop, size.sum(), size[c == 0].sum(), pieces, len(c), c[0], c[-1], size[0]] if len(c) else []
    return [np.array([x], np.int32 if k in (7, 8) else np.int64) for k, x in enumerate(row)]


def _maximal(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of the maximal runs of a chunk's pieces."""
    kept = lengths > 0
    symbols, lengths = symbols[kept].astype(np.int32), lengths[kept]
    begins = np.flatnonzero(np.append(True, np.diff(symbols) != 0)[: len(symbols)])
    return symbols[begins], np.add.reduceat(lengths, begins) if len(begins) else lengths


def arrow_file(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there: local and mounted folders by their name, others by their URI as far as Arrow knows them."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Split(InputPartition):
    """Chunks from ``first`` on, that hold the bytes [begin, end) of a file."""

    first: int
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, tag: str, begin: int, end: int, split: int, shape: str = "pieces"):
        self.path, self.tag, self.begin, self.end, self.split, self.shape = path, tag, begin, end, split, shape

    def partitions(self):
        """Splits of whole chunks; one empty split for a file without data."""
        step = max(CHUNK, self.split // CHUNK * CHUNK)
        return [Split((a - self.begin) // CHUNK, a, min(self.end, a + step)) for a in range(self.begin, self.end, step)] or [Split(0, 0, 0)]

    def read(self, part: Split):
        system, path = arrow_file(self.path)
        with system.open_input_file(path) as data:
            for k, at in enumerate(range(part.begin, part.end, CHUNK)):
                stop = min(at + CHUNK, part.end)
                found = _columns(self.shape, part.first + k, at, stop, *codecs.decode(self.tag, data.read_at(stop - at, at)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[f.split()[0] for f in SHAPES[self.shape].split(", ")])


class RunFile(DataSource):
    """format("sparkloom_runs"): the runs of one file, with options path, tag, begin, end (of its data) and split (bytes); chunk and inside say where a run starts."""

    @classmethod
    def name(cls):
        return "sparkloom_runs"

    def schema(self):
        return PIECES

    def reader(self, schema):
        o = self.options
        return _Reader(o["path"], o["tag"], int(o["begin"]), int(o["end"]), int(o.get("split", SPLIT)))


def shaped(spark, shape: str, path: str, tag: str, begin: int, end: int, split: int):
    """The chunks of a file in one of SHAPES, a task for each split; at least four a core, as far as there are chunks."""
    reader = _Reader(path, tag, begin, end, min(split, (end - begin) // (4 * spark.sparkContext.defaultParallelism)), shape)
    parts = reader.partitions()

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from reader.read(parts[k])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, SHAPES[shape])


def placed(bases, path: str, tag: str):
    """Maximal runs(run_id, start, c, len) of a file, of bases(at, stop, base, number, on, tail), a row for each chunk: a task decodes the chunks whose rows it has.

    So no run meets a table in a join, for which Spark would guess the size of the runs from that of the rows that name the chunks.
    """

    def read(batches):
        system, name = arrow_file(path)
        with system.open_input_file(name) as data:
            for batch in batches:
                for at, stop, base, number, on, tail in zip(*(column.to_pylist() for column in batch.columns)):
                    c, size = _maximal(*codecs.decode(tag, data.read_at(stop - at, at)))
                    start, number = base + np.cumsum(size) - size, number - on + np.arange(len(c))
                    size[-1] += tail
                    yield pa.RecordBatch.from_arrays([pa.array(x[on:]) for x in (number, start, c, size)], names=["run_id", "start", "c", "len"])

    dealt = bases.repartition(4 * bases.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("at")
    return dealt.select("at", "stop", "base", "number", "on", "tail").mapInArrow(read, RUNS)


@dataclass
class Written(WriterCommitMessage):
    """What a task says of what it wrote: chunks and bytes."""

    chunks: int
    bytes: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.head, self.tail = arrow_file(options["path"])[1], bytes.fromhex(options["head"]), bytes.fromhex(options["tail"])
        self.part, self.size = f"{self.path}.{options['id']}.part", int(options["size"])
        # made here, on the driver, once; tasks only open it
        os.makedirs(os.path.dirname(self.part) or ".", exist_ok=True)
        with open(self.part, "wb") as out:
            out.truncate(len(self.head) + self.size + len(self.tail))

    def write(self, batches):
        chunks = size = 0
        with open(self.part, "r+b") as out:
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.seek(len(self.head) + at)
                    out.write(data)  # a task that runs again writes the same bytes to the same place
                    chunks, size = chunks + 1, size + len(data)
            out.flush()
            os.fsync(out.fileno())
        return Written(chunks, size)

    def commit(self, messages):
        written = sum(m.bytes for m in messages if m is not None)
        if written != self.size:
            raise ValueError(f"{written} bytes written of {self.size}")
        with open(self.part, "r+b") as out:
            out.write(self.head)
            out.seek(len(self.head) + self.size)
            out.write(self.tail)
        os.replace(self.part, self.path)

    def abort(self, messages):
        if os.path.exists(self.part):
            os.remove(self.part)


class ByteFile(DataSource):
    """format("sparkloom_bytes"): rows (at long, data binary) become one file, each at its place behind ``head``; options path, head and tail (hexadecimal), size (bytes of all rows)."""

    @classmethod
    def name(cls):
        return "sparkloom_bytes"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark) -> None:
    """Make both known to a session."""
    spark.dataSource.register(RunFile)
    spark.dataSource.register(ByteFile)


def write_bytes(rows, path: str, head: bytes, tail: bytes, size: int) -> None:
    """Write rows(at, data) as one file on a local or mounted file system."""
    register(rows.sparkSession)
    rows.select("at", "data").write.format("sparkloom_bytes").mode("append").option("path", path).option("head", head.hex()).option("tail", tail.hex()).option("size", size).option("id", uuid.uuid4().hex).save()
