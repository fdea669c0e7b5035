"""Token counts of the documents in flat, unindexed token files, by a separator scan.

A flat file is a run of little-endian token ids in which an end-of-document
id closes each document; nothing says where documents begin. The files are
cut into blocks, each block is searched for the id in one vector operation, and
a prefix scan over the blocks' separator counts, one row a block, numbers the documents, so
pieces of a document in different blocks add up to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a block.
BLOCK_BYTES = 1 << 20


def write(df: DataFrame, path: str, end: int, ids: str = "token_ids", width: int = 2) -> None:
    """Write the arrays of ids in ``ids`` to flat files in ``path``, each followed by ``end``; null arrays as empty ones.

    Spark's text writer puts the bytes down, with the separator as its line
    end, so tasks commit as for any table. ``width``: bytes of an id, 2 or 4; ids
    that are null, out of range or equal to ``end`` cannot stand in such a file and are left out.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def pack(batches):
        for batch in batches:
            lists = batch.column(0)
            for k in range(0, len(lists), 256):  # bounds what is held beside the batch
                out = []
                for row in lists.slice(k, 256):
                    got = row.values.drop_null().to_numpy() if row.is_valid else np.zeros(0, np.int32)
                    if len(got) and not (got.min() >= 0 and got.max() < 1 << (8 * width) and (got != end).all()):
                        got = got[(got >= 0) & (got < 1 << (8 * width)) & (got != end)]
                    out.append(got.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    write_packed(df.select(ids).mapInArrow(pack, "value binary"), path, end, width)


def write_packed(df: DataFrame, path: str, end: int, width: int = 2) -> None:
    """As ``write``, for ids that are bytes already: the only column of ``df`` is binary, whole ids of ``width`` bytes, none of them ``end``."""
    separator = np.array([end], {2: "<u2", 4: "<u4"}[width]).tobytes().decode("latin-1")
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def scan(spark: SparkSession, path: str, end: int, width: int = 2, block_bytes: int = BLOCK_BYTES, head: int = 0) -> DataFrame:
    """(file, doc_no, start, n_tokens, head): every document of the flat files in ``path``.

    ``doc_no`` counts from 0 in each file, ``start`` is the place of the first
    token, ``head`` holds the first ``head`` ids. Tokens after the last
    separator are a document too; an empty file has none, and neighbouring
    separators enclose empty documents. A file must be smaller than 2 GB, as for
    Spark's binaryFile source, and hold whole ids; ``write`` leaves one file a task, far below that. Only blocks and one row per piece of a document move.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    step = max(width, block_bytes // width * width)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content", "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("length", F.lit(1)) - 1, F.lit(step).cast("long")))
    blocks = files.where("length > 0").select("file", "content", at.alias("at")).select("file", "at", F.expr(f"substring(content, cast(at + 1 as int), {step})").alias("block"))

    def search(batches):
        for batch in batches:
            for file, at, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if len(block.as_buffer()) % width:
                    raise ValueError(f"{file} does not hold whole ids of {width} bytes")
                tokens = np.frombuffer(block.as_buffer(), kind)
                ends = np.flatnonzero(tokens == end)
                starts = np.concatenate(([0], ends + 1))
                lengths = np.concatenate((ends, [len(tokens)])) - starts
                closed = np.arange(len(starts)) < len(ends)
                kept = closed | (lengths > 0)
                heads = [tokens[s : s + min(head, n)].tolist() for s, n in zip(starts[kept].tolist(), lengths[kept].tolist())] if head else [[]] * int(kept.sum())
                n = int(kept.sum())
                columns = [pa.array([file] * n, pa.string()), pa.array(np.full(n, at)), pa.array(np.flatnonzero(kept)), pa.array(starts[kept] + at // width), pa.array(lengths[kept]), pa.array(closed[kept]), pa.array(heads, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "at", "k", "start", "n", "closed", "head"])

    pieces = materialize(blocks.mapInArrow(search, "file string, at long, k long, start long, n long, closed boolean, head array<int>"), "pieces")
    counts = pieces.groupBy("file", "at").agg(F.count_if("closed").alias("ends"))
    before = F.coalesce(F.sum("ends").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a block
    numbered = pieces.join(counts.select("file", "at", before.alias("before")), ["file", "at"]).withColumn("doc_no", F.col("before") + F.col("k"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "n", "head"))), lambda p: p["head"]))
    grouped = numbered.groupBy("file", "doc_no").agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), *([F.slice(joined, 1, head).alias("head")] if head else []))
    return grouped


#: Ids that carry a number at the head of a document: so many digits of 15 bits.
DIGITS = 5


def number_ids(number):
    """A number as DIGITS ids below 2**15, the lowest first, to stand at the head of a document; negative numbers in two's complement of 75 bits."""
    return F.array(*(F.shiftright(number, min(63, 15 * k)).bitwiseAND(F.lit(0x7FFF)).cast("int") for k in range(DIGITS)))


#: The highest of the ids that stand for no number; no number of 64 bits has it.
NONE = 0x5555


def number_bytes(number):
    """``number_ids`` as bytes, two an id, the lowest first; a null has an id of its own that no number has."""
    digits = [F.shiftright(number, min(63, 15 * k)).bitwiseAND(F.lit(0x7FFF)) for k in range(DIGITS)]
    spelled = [F.lpad(F.hex(x), 2, "0") for d in digits for x in (d.bitwiseAND(F.lit(0xFF)), F.shiftright(d, 8))]
    return F.coalesce(F.unhex(F.concat(*spelled)), F.unhex(F.lit("0000" * (DIGITS - 1) + f"{NONE:04X}")))


def number_of(head):
    """The number that ``number_ids`` or ``number_bytes`` put down."""
    out = F.lit(0).cast("long")
    for k in range(DIGITS):
        out = out.bitwiseOR(F.shiftleft(F.get(head, k).cast("long"), 15 * k))
    return F.when(F.get(head, DIGITS - 1) != NONE, out)
