"""Reading and writing transforms in file formats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alphabet import ORDERS, SIGMA
from ..operators import runs as run_operators
from ..operators.spelled import _pack, _unpack
from ..plans.order import before_blocks
from ..plans.shared import forget, materialize
from . import codecs, splits

#: Bytes of a chunk that a task decodes or encodes at a time; a multiple of the native block.
CHUNK = 1 << 20


def formats(spark: SparkSession) -> DataFrame:
    """(tag, name, alphabet) of all formats."""
    return spark.createDataFrame([(f.tag, f.name, f.order) for f in codecs.FORMATS.values()], "tag string, name string, alphabet string")


def sizes(runs: DataFrame) -> DataFrame:
    """(tag, name, alphabet, bytes) of all formats, with the bytes that a file of runs(c, len) takes; null for the native code, where they do not follow from counts."""

    def size(tag: str) -> Column:
        if tag == "native":
            return F.lit(None).cast("long")
        data = F.col("run_bytes") if tag in codecs.RUN_CODES else F.col("bases")
        padding = F.pmod(-F.col("bases"), F.lit(8)) if codecs.padding(tag, 1) else F.lit(0)
        return (data + padding + len(codecs.header(tag, 0, 0, 0))).cast("long")

    each = (F.struct(*(F.lit(x).alias(n) for n, x in (("tag", f.tag), ("name", f.name), ("alphabet", f.order))), size(f.tag).alias("bytes")) for f in codecs.FORMATS.values())
    return byte_counts(runs).select(F.inline(F.array(*each)))


def _known(tag: str) -> codecs.Format:
    if tag not in codecs.FORMATS:
        raise ValueError(f"no such format: {tag}; there are {', '.join(codecs.FORMATS)}")
    return codecs.FORMATS[tag]


def inspect(spark: SparkSession, *paths: str) -> DataFrame:
    """headers(path, format, sequences, bases, bytes, alphabet) of files, by their first bytes; totals are plain sums over it.

    A file that is missing or cannot be read has the format ``unreadable``, and the others are looked at all the same.
    """
    schema = "path string, format string, sequences long, bases long, bytes long, alphabet string"
    there = [p for p in paths if _exists(spark, p)]
    missing = spark.createDataFrame([(p, "unreadable", None, None, None, None) for p in paths if p not in there], schema)
    if not there:
        return missing
    held = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).format("binaryFile").load(there)
    try:
        for path in there:
            splits.arrow_file(qualified(spark, path))
        heads = held.select("path", F.lit(None).cast("binary").alias("head"))  # names only: a file's first bytes are read by name, whatever its size
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        heads = held.select("path", F.expr("substring(content, 1, 32)").alias("head"))

    def look(batches):
        for batch in batches:
            found = [_sniffed(path, head) for path, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = [batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in (("format", pa.string()), ("sequences", pa.int64()), ("bases", pa.int64()), ("bytes", pa.int64()), ("alphabet", pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "format", "sequences", "bases", "bytes", "alphabet"])

    found = heads.mapInArrow(look, schema).unionByName(missing)
    empty = [(p, "unknown", None, None, None, None) for p in _empty_files(spark, there)]  # the source leaves these out
    return found.unionByName(spark.createDataFrame(empty, schema)) if empty else found


def _sniffed(path: str, head: bytes | None) -> dict:
    """What a file's first bytes say, which are read here where they are not given."""
    if head is None:
        try:
            system, name = splits.arrow_file(path)
            with system.open_input_file(name) as data:
                head = data.read(32)
        except OSError:
            return codecs.sniff(b"") | {"format": "unreadable"}
    return codecs.sniff(head)


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(name))


def _empty_files(spark: SparkSession, paths) -> list[str]:
    """Those of the named files that hold no bytes."""
    out = []
    for path in paths:
        name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        for status in name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(name) or []:
            if status.isFile() and not status.getLen():
                out.append(status.getPath().toString())
    return out


def read_runs(spark: SparkSession, path: str, tag: str, split: int = splits.SPLIT) -> DataFrame:
    """Maximal runs(run_id, start, c, len) of one file."""
    return read_told(spark, path, tag, split)[0]


def read_told(spark: SparkSession, path: str, tag: str, split: int = splits.SPLIT) -> tuple[DataFrame, dict]:
    """As ``read_runs``, and what the file holds: sequences, bases and runs, as many as it has pieces.

    Runs are put together in the chunks that are decoded, and a first pass over the file gives a row for each chunk: from these follow where its
    runs stand, their numbers, whether its first one belongs to a chunk before and how far its last one goes on. So no run moves or is written.
    """
    _known(tag)
    options = _opened(spark, path, tag, split)
    sums = lambda df, **of: {n: int(v or 0) for n, v in df.agg(*(F.expr(e).alias(n) for n, e in of.items())).first().asDict().items()}
    if options is None:
        pieces = read_pieces(spark, path, tag)
        return run_operators.coalesce_runs(pieces), sums(pieces, sequences="sum(if(c = 0, len, 0))", bases="sum(len)", runs="count(*)")
    ends = materialize(splits.shaped(spark, "ends", **options), "ends")
    bases = materialize(_chunk_bases(ends), "chunks")
    return splits.placed(bases, options["path"], tag), sums(ends, sequences="sum(sequences)", bases="sum(bases)", runs="sum(pieces)")


def _chunk_bases(ends: DataFrame) -> DataFrame:
    """(chunk, at, stop, base, number, on, tail): the bytes of each chunk, positions and runs before each chunk, 1 where its first run began before it, and by how much its last one goes on behind it. One window holds all chunks, a row for each megabyte of a file."""
    order = W.orderBy("chunk")
    before = lambda x: F.coalesce(F.sum(x).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    on = ends.withColumn("on", F.coalesce((F.col("first") == F.lag("last").over(order)).cast("long"), F.lit(0)))
    own = on.withColumn("own", F.last(F.when((F.col("m") > 1) | (F.col("on") == 0), F.col("chunk")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = own.select("chunk", "at", "stop", "on", "first_len", F.lag("own").over(order).alias("whose"), before("bases").alias("base"), before(F.col("m") - F.col("on")).alias("number"))
    tails = placed.where("on = 1").groupBy(F.col("whose").alias("chunk")).agg(F.sum("first_len").alias("tail"))
    return placed.join(tails, "chunk", "left").select("chunk", "at", "stop", "base", "number", "on", F.coalesce("tail", F.lit(0)).alias("tail"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark takes it to be on."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()


def read_pieces(spark: SparkSession, path: str, tag: str, split: int = splits.SPLIT) -> DataFrame:
    """Runs in pieces(start, c, len) as a file of any size holds them: splits of ``split`` bytes are decoded in parallel, and where each chunk starts follows from the lengths in those before.

    File systems that Arrow does not know (see ``splits.arrow_file``) are read through Spark, a file as a whole, and must hold less than 2 GB in each.
    """
    _known(tag)
    options = _opened(spark, path, tag, split)
    if options is None:
        return _read_whole(spark, path, tag)
    splits.register(spark)
    pieces = materialize(spark.read.format("sparkloom_runs").options(**options).load(), "pieces")
    bases = before_blocks(pieces.groupBy("chunk").agg(F.sum("len").alias("n")), {"base": "n"}, "chunk")
    return pieces.join(bases, "chunk").select((F.col("base") + F.col("inside")).alias("start"), "c", "len")


def _opened(spark: SparkSession, path: str, tag: str, split: int) -> dict | None:
    """What the source of splits is told of a file; None where Arrow does not know its file system."""
    place = qualified(spark, path)
    try:
        system, name = splits.arrow_file(place)
        length = system.get_file_info(name).size
        if length is None:
            raise FileNotFoundError(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as problem:
        if isinstance(problem, FileNotFoundError):
            raise
        return None
    with system.open_input_file(name) as data:
        begin, end = codecs.data_span(tag, data.read(32), length)  # native arrays may end in free space
    if end > length:
        raise ValueError(f"{path}: the file is shorter than its header says")
    return {"path": place, "tag": tag, "begin": begin, "end": end, "split": split}


def _read_whole(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """As ``read_pieces`` by Spark's source of whole files, whose limit is 2 GB."""
    spans = spark.read.format("binaryFile").load(path).select("content", "length")

    def cut(batches):
        for batch in batches:
            for content, length in zip(batch.column(0), batch.column(1).to_pylist()):
                data = memoryview(content.as_buffer())
                begin, end = codecs.data_span(tag, bytes(data[:32]), length)
                if end > length:
                    raise ValueError(f"{path}: the file is shorter than its header says")
                for k, at in enumerate(range(begin, end, CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bytes(data[at : min(end, at + CHUNK)])], pa.binary())], names=["k", "data"])

    def decode(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols, lengths = codecs.decode(tag, data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(symbols), k)), pa.array(np.cumsum(lengths) - lengths), pa.array(symbols).cast(pa.int32()), pa.array(lengths)], names=["chunk", "inside", "c", "len"])

    pieces = materialize(spans.mapInArrow(cut, "k long, data binary").repartition("k").mapInArrow(decode, splits.PIECES), "pieces")
    bases = before_blocks(pieces.groupBy("chunk").agg(F.sum("len").alias("n")), {"base": "n"}, "chunk")
    return pieces.join(bases, "chunk").select((F.col("base") + F.col("inside")).alias("start"), "c", "len")


def recode(runs: DataFrame, source: str, target: str) -> DataFrame:
    """Runs whose symbols change from one alphabet order to another: T and N trade places. The order of suffixes is not touched."""
    return runs if source == target else recoded(runs, "c", source)(target)


def recoded(df: DataFrame, column: str, source: str) -> Callable[[str], DataFrame]:
    """``df`` as a function of the alphabet order to which the symbols in ``column`` change."""

    def to(target: str) -> DataFrame:
        c = F.col(column)
        for k, ch in enumerate(ORDERS[source]):
            if ORDERS[target].index(ch) != k:
                c = F.when(F.col(column) == k, ORDERS[target].index(ch)).otherwise(c)
        return df.withColumn(column, c)

    return to


#: Positions of a cell of packed runs.
CELL = 1 << 18


def packed(runs: DataFrame) -> DataFrame:
    """(k, start, inside, bases, sequences, parts, runs, held) of runs(start, c, len): the runs that begin in each cell of positions, in order, as numbers len * 8 + c in bytes, a few rows a cell.

    Runs that lie one behind another are packed before they move, so what moves is about a byte a run. parts: the bytes of a run code that they take; inside: those before in the cell.
    """

    def pack(batches):
        for batch in batches:
            start, c, length = (batch.column(k).to_numpy() for k in range(3))
            order = np.argsort(start, kind="stable")
            start, length, value = start[order], length[order], (length << 3 | c)[order]
            k = start // CELL
            edge = np.flatnonzero(np.append(True, (np.diff(k) != 0) | (start[1:] != start[:-1] + length[:-1]))[: len(start)])
            rows = [_pack(value[a:b]) for a, b in zip(edge.tolist(), np.append(edge[1:], len(start)).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(k[edge]), pa.array(start[edge]), pa.array(rows, pa.binary())], names=["k", "start", "held"])

    def join(batches):
        now, inside = None, 0
        for batch in batches:
            k, start, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            edge, rows = np.flatnonzero(np.append(True, np.diff(k) != 0)[: len(k)]).tolist(), []
            for a, b in zip(edge, [*edge[1:], len(k)]):
                values = np.concatenate([_unpack(h) for h in held[a:b]])
                c, length = values & 7, values >> 3
                inside, now = inside if k[a] == now else 0, k[a]
                parts = int((-(-length // codecs.LONGEST)).sum())
                rows.append((k[a], start[a], inside, length.sum(), length[c == 0].sum(), parts, len(values), _pack(values)))
                inside += parts
            names = ["k", "start", "inside", "bases", "sequences", "parts", "runs"]
            columns = [pa.array([int(r[n]) for r in rows], pa.int64()) for n in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.binary())], names=[*names, "held"])

    some = runs.where("len > 0").select("start", F.col("c").cast("long").alias("c"), F.col("len").cast("long").alias("len"))
    dealt = some.mapInArrow(pack, "k long, start long, held binary").repartition("k").sortWithinPartitions("k", "start")
    return materialize(dealt.mapInArrow(join, "k long, start long, inside long, bases long, sequences long, parts long, runs long, held binary"), "packed")


def encoded(held: DataFrame, tag: str, source: str | None = None, order: str | None = None) -> DataFrame:
    """(at, data): the bytes of packed runs in a format, and where they begin behind the header. ``source`` and ``order``: alphabet orders between which symbols change."""
    codes = np.arange(8)
    if source and order and source != order:
        codes[:SIGMA] = [ORDERS[order].index(ch) for ch in ORDERS[source]]
    coded = tag in codecs.RUN_CODES
    if coded:
        before = before_blocks(held.groupBy("k").agg(F.sum("parts").alias("n")), {"base": "n"}, "k")
        rows = held.join(before, "k").select((F.col("base") + F.col("inside")).alias("at"), "held")
    else:
        rows = held.select(F.col("start").alias("at"), "held")

    def encode(batches):
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = _unpack(data)
                for c, length in [(codes[values & 7], values >> 3)] if coded else _slices(codes[values & 7], values >> 3):
                    out = codecs.encode(tag, c, length)
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out], pa.binary())], names=["at", "data"])
                    at += len(out)

    return rows.mapInArrow(encode, "at long, data binary")


def _slices(symbols: np.ndarray, lengths: np.ndarray, most: int = CHUNK):
    """Runs in slices of at most ``most`` positions, cut where they cross a bound."""
    ends = np.cumsum(lengths)
    for a in range(0, int(ends[-1]), most):
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends - lengths, a + most, "left"))
        yield symbols[i:j], np.minimum(ends[i:j], a + most) - np.maximum(ends[i:j] - lengths[i:j], a)


def native_chunks(runs: DataFrame, bases_in_chunk: int = CHUNK) -> DataFrame:
    """(k, data): the native code of runs(start, c, len), as chunks of as many positions, each of which begins at a block of its own."""
    pieces = run_operators.cut_at(runs, bases_in_chunk).select(F.col("blk").alias("k"), "start", "c", "len")
    ordered = pieces.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "c", "len"))).alias("r"))  # at most bases_in_chunk runs

    def encode(batches):
        for batch in batches:
            rows = [codecs.encode("native", *(r.values.field(n).to_numpy().astype("int64") for n in ("c", "len"))) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["k", "data"])

    return ordered.mapInArrow(encode, "k long, data binary")


def write_runs(runs: DataFrame, path: str, tag: str, order: str = "default", force: bool = False) -> dict:
    """Write runs to one file of an interchange format; returns sequences, bases, runs and bytes. ``runs`` are computed once.

    The alphabet order must be the format's, unless ``force``. The engine's own format has no such file: see Index.save.
    """
    _writable(tag, order, force)
    held = packed(runs)
    done = write_packed(held, path, tag, order, force)
    forget(held)
    return done


def _writable(tag: str, order: str, force: bool) -> None:
    found = _known(tag)
    if tag == "native":
        raise ValueError("the native file is read only; save an Index instead")
    if found.order not in ("any", order) and not force:
        raise ValueError(f"{tag} holds the {found.order} alphabet, not {order}")


def write_packed(held: DataFrame, path: str, tag: str, order: str = "default", force: bool = False, source: str | None = None) -> dict:
    """As ``write_runs`` of runs that are packed, for any number of files; ``source``: the alphabet order that they are in, where their symbols must change to ``order``.

    On a local or mounted file system tasks write the chunks that they encode, each at its place, and no bytes pass through the driver; elsewhere, where a file cannot
    be written in places, the driver puts one chunk after another into it, with one in memory at a time.
    """
    _writable(tag, order, force)
    spark = held.sparkSession
    sums = held.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("bases", "sequences", "parts", "runs"))).first()
    bases, sequences, run_bytes = sums["bases"], sums["sequences"], sums["parts"]
    head, tail = codecs.header(tag, sequences, bases, run_bytes), codecs.padding(tag, bases)
    size = run_bytes if tag in codecs.RUN_CODES else bases
    place, rows = qualified(spark, path), encoded(held, tag, source, order)
    if place.startswith("file:"):
        splits.write_bytes(rows, place, head, tail, size)
    else:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(head)
            for r in rows.orderBy("at").select("data").toLocalIterator():
                out.write(bytes(r["data"]))
            out.write(tail)
        finally:
            out.close()
    return {"sequences": sequences, "bases": bases, "runs": sums["runs"], "bytes": len(head) + size + len(tail)}


def byte_counts(runs: DataFrame) -> DataFrame:
    """One row: sequences, bases and run_bytes, what a header of a one-byte code holds."""
    return runs.agg(
        F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("len"))), F.lit(0)).alias("sequences"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("bases"),
        F.coalesce(F.sum(F.ceil(F.col("len") / codecs.LONGEST)), F.lit(0)).alias("run_bytes"),
    )


def split_runs(runs: DataFrame) -> DataFrame:
    """Runs cut into pieces of at most 31, as one-byte codes hold them: (run_id, part, c, len)."""
    parts = runs.select("run_id", "c", "len", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("len") / codecs.LONGEST) - 1).cast("int"))).alias("part"))
    return parts.select("run_id", "part", "c", F.least(F.col("len") - F.col("part") * codecs.LONGEST, F.lit(codecs.LONGEST)).cast("long").alias("len"))


def through_native(runs: DataFrame, bases_in_chunk: int = CHUNK) -> DataFrame:
    """Maximal runs(run_id, start, c, len) after the native code and back; each chunk of positions begins at a block of its own."""
    coded = native_chunks(runs, bases_in_chunk)

    def decode(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols, lengths = codecs.decode("native", data)
                starts = k * bases_in_chunk + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array(symbols).cast(pa.int32()), pa.array(lengths)], names=["start", "c", "len"])

    return run_operators.coalesce_runs(coded.mapInArrow(decode, "start long, c int, len long"))
