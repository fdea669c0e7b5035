"""Texts back from a transform, and places in texts, by walking back from all texts' ends at once, by list ranking with pointer doubling, or by walking back to the next sampled place."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.alphabet import SIGMA
from ..plans.order import cell
from ..plans.shared import forget, laid_out, materialize, materialize_counted, shared_dir
from . import lookups, runs
from .spelled import HEAD, _pack, _unpack

#: Rounds at most: texts of up to 2**ROUNDS symbols.
ROUNDS = 40


#: Positions of a chunk of a walk, and steps of a walk at most: indexes of longer texts go by list ranking.
CHUNK, STEPS = 1 << 18, 1 << 10
_WALK = "chunk long, n long, at binary, seqs binary, words binary"


def chunk_size(block_size: int) -> int:
    """Positions of a chunk of an index, whole blocks."""
    return max(1, CHUNK // block_size) * block_size


def _chunks(index, size: int) -> DataFrame:
    """(chunk, s, before) of an index: its symbols by chunks of ``size`` positions, in buckets, and how many of each come before the chunk."""
    per = size // index.block_size
    parts = runs.spelled_of(index.blocks).groupBy(cell("blk", per).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "s"))), lambda x: x["s"]), "").alias("s"))
    heads = index.blocks.where(F.col("blk") % per == 0).select(cell("blk", per).alias("chunk"), F.array(*(F.col(f"n{k}") for k in range(SIGMA))).alias("before"))
    return laid_out(parts.join(heads, "chunk"), "chunk", "chunks")


def walk(index, steps: int = STEPS) -> DataFrame | None:
    """(chunk, n, at, seqs, words, round) of an index: after ``round`` steps back from its end, where each text is, packed by chunks of positions; None if a text has more than ``steps`` symbols.

    A round moves one place a text, sorted, its number and the symbols met since the last word, to the chunks, which lie in buckets and stay, so
    all rounds together move a few bytes a position. Where the words of HEAD symbols are full and where texts begin there are rows of chunk -1, with the words of texts, the last symbol first.
    """
    spark, counts, below = index.blocks.sparkSession, index.counts, lookups.smaller(index.counts)
    size = chunk_size(index.block_size)
    chunks = _chunks(index, size)

    def begin(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                at = np.arange(chunk * size, min(counts[0], (chunk + 1) * size))
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "n": len(at), "at": _pack(at, True), "seqs": _pack(at), "words": b""}], _fields())

    def step(k):
        def stepped(key, there, held):
            if not there.num_rows:
                return _fields().empty_table()
            chunk, rows, out = key[0].as_py(), there.to_pylist(), []
            at, seqs = np.concatenate([_unpack(r["at"], True) for r in rows]), np.concatenate([_unpack(r["seqs"]) for r in rows])
            words = np.concatenate([_unpack(r["words"]) if r["words"] else np.zeros(r["n"], np.int64) for r in rows])
            order = np.argsort(at)
            at, seqs, words = at[order] - chunk * size, seqs[order], words[order]
            symbols, before = np.frombuffer(held.column("s")[0].as_py().encode(), np.uint8) - 48, held.column("before")[0].as_py()
            own = symbols[at].astype(np.int64)
            words = np.where(own > 0, words * SIGMA + own, words)
            full = (k + 1) % HEAD == 0
            told = np.ones(len(at), bool) if full else own == 0
            if told.any():
                out.append({"chunk": -1, "n": int(told.sum()), "at": b"", "seqs": _pack(seqs[told]), "words": _pack(words[told])})
            for c in range(1, SIGMA):
                mine = np.flatnonzero(own == c)
                to = below[c] + before[c] + np.searchsorted(np.flatnonzero(symbols == c), at[mine])
                for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(to // size)) + 1):
                    if len(part):
                        out.append({"chunk": int(to[part[0]] // size), "n": len(part), "at": _pack(to[part], True), "seqs": _pack(seqs[mine[part]]), "words": b"" if full else _pack(words[mine[part]])})
            return pa.Table.from_pylist(out, _fields())

        return stepped

    path = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    now = spark.range(-(-counts[0] // size)).mapInArrow(begin, _WALK)
    for k in range(steps + 2):
        seen = Observation()
        now.observe(seen, F.count(F.when(F.col("chunk") >= 0, 1)).alias("open")).write.parquet(f"{path}/round={k}", compression="zstd")
        if not seen.get["open"]:
            return spark.read.schema(f"{_WALK}, round int").parquet(path)
        level = spark.read.schema(_WALK).parquet(f"{path}/round={k}").where("chunk >= 0")
        now = level.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(step(k), _WALK)
    return None


def _fields() -> pa.Schema:
    return pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("seqs", pa.binary()), ("words", pa.binary())])


def words_of(walked: DataFrame) -> DataFrame:
    """(seq_id, round, s) of a walk: stretches of texts as they stand there, the last one of a text first."""

    def told(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seqs, words, lines = _unpack(row["seqs"]), _unpack(row["words"]), []
                for _ in range(HEAD):
                    lines.append((words % SIGMA + 48).astype(np.uint8))
                    words = words // SIGMA
                spelled = np.stack(lines, 1).tobytes().decode()
                s = [spelled[a : a + HEAD].rstrip("0") for a in range(0, len(spelled), HEAD)]
                yield pa.RecordBatch.from_arrays([pa.array(seqs), pa.array(np.full(len(seqs), row["round"], np.int32)), pa.array(s, pa.string())], names=["seq_id", "round", "s"])

    return walked.where("chunk < 0").select("seqs", "words", "round").mapInArrow(told, "seq_id long, round int, s string")


def texts_of_index(index) -> DataFrame:
    """texts(seq_id, s) of an index without texts; texts are numbered in their order."""
    walked = walk(index)
    if walked is None:
        return texts_of(index.edges, index.counts)
    parts = F.sort_array(F.collect_list(F.struct("round", "s")), asc=False)
    return words_of(walked).groupBy("seq_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("s"))


def located_in_index(found: DataFrame, index) -> DataFrame:
    """(pattern_id, seq_id, off) of found(pattern_id, lo, hi), from an index without texts or sampled places: every place of a pattern. Ranges meet the walk by its chunks."""
    walked, size = walk(index), chunk_size(index.block_size)
    if walked is None:
        places = materialize(places_of(index.edges, index.counts), "places")
        return locate(found, places, places.groupBy("seq_id").agg(F.max("back").alias("n")))
    ranges = found.where("lo < hi").select("pattern_id", "lo", "hi", F.explode(F.sequence(cell("lo", size), cell(F.col("hi") - 1, size))).alias("chunk"))

    def meet(key, there, asked):
        if not there.num_rows or not asked.num_rows:
            return pa.schema([("pattern_id", pa.int64()), ("seq_id", pa.int64()), ("back", pa.int32())]).empty_table()
        rows = there.to_pylist()
        at, seqs = np.concatenate([_unpack(r["at"], True) for r in rows]), np.concatenate([_unpack(r["seqs"]) for r in rows])
        back = np.repeat(np.array([r["round"] for r in rows], np.int32), [r["n"] for r in rows])
        order = np.argsort(at)  # every position of the chunk, once
        start = key[0].as_py() * size
        low, high = (np.clip(asked.column(e).to_numpy() - start, 0, len(at)) for e in ("lo", "hi"))
        n = high - low
        pick = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return pa.table({"pattern_id": pa.array(np.repeat(asked.column("pattern_id").to_numpy(), n)), "seq_id": pa.array(seqs[pick]), "back": pa.array(back[pick])})

    met = walked.where("chunk >= 0").select("chunk", "n", "at", "seqs", "round").groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(meet, "pattern_id long, seq_id long, back int")
    lengths = words_of(walked).groupBy("seq_id").agg(F.sum(F.length("s")).alias("n"))
    return met.join(lengths, "seq_id").select("pattern_id", "seq_id", (F.col("n") - F.col("back")).alias("off"))


def places_of(lf: DataFrame, counts: list[int]) -> DataFrame:
    """(pos, c, seq_id, back) of lf(pos, c, r, lf): which text the suffix at each position is of, and how many symbols it has.

    Text i ends at position i, where the suffix is empty. Every position knows the one
    whose suffix is a symbol shorter; each round it asks what that one knows, so the distance doubles.
    """
    shorter = lf.where("c > 0").select(F.col("lf").alias("pos"), F.col("pos").alias("next"), F.lit(1).cast("long").alias("back"))
    ends = lf.where(F.col("pos") < counts[0]).select("pos", F.col("pos").alias("next"), F.lit(0).cast("long").alias("back"))
    now = materialize(ends.unionByName(shorter), "places")
    for _ in range(ROUNDS):
        if now.where(F.col("next") >= counts[0]).isEmpty():
            break
        ahead = now.select(F.col("pos").alias("next"), F.col("next").alias("next2"), F.col("back").alias("back2"))
        open_ = now.where(F.col("next") >= counts[0]).join(ahead, "next").select("pos", F.col("next2").alias("next"), (F.col("back") + F.col("back2")).alias("back"))
        after = materialize(open_.unionByName(now.where(F.col("next") < counts[0])), "places")
        forget(now)
        now = after
    return lf.select("pos", "c").join(now, "pos").select("pos", "c", F.col("next").alias("seq_id"), "back")


def texts_of(lf: DataFrame, counts: list[int]) -> DataFrame:
    """texts(seq_id, s) of lf(pos, c, r, lf): the symbol before each suffix, the longest suffix first. Only single symbols move; each text is put together once."""
    symbols = F.array_sort(F.collect_list(F.when(F.col("c") > 0, F.struct((-F.col("back")).alias("at"), "c"))))
    spelled = F.array_join(F.transform(symbols, lambda x: x["c"].cast("string")), "")
    return places_of(lf, counts).groupBy("seq_id").agg(spelled.alias("s"))


def locate(found: DataFrame, places: DataFrame, lengths: DataFrame, block: int = 1 << 12) -> DataFrame:
    """(pattern_id, seq_id, off) of found(pattern_id, lo, hi) ranges: every place where a pattern occurs.

    ``places``: places_of an index; ``lengths``(seq_id, n): the texts' lengths. Ranges are dealt out to blocks of positions, so the lookup is an equi-join.
    """
    cells = found.where("lo < hi").select("pattern_id", "lo", "hi", F.explode(F.sequence(cell("lo", block), cell(F.col("hi") - 1, block))).alias("blk"))
    met = places.withColumn("blk", cell("pos", block)).join(cells, "blk").where("pos >= lo AND pos < hi")
    return met.join(lengths, "seq_id").select("pattern_id", "seq_id", (F.col("n") - F.col("back")).alias("off"))


def sampled(bwt: DataFrame, step: int) -> DataFrame:
    """(pos, seq_id, off) of bwt(pos, c, seq_id, off): where every ``step``-th symbol of each text stands, its first one always."""
    return bwt.where(F.pmod("off", F.lit(step)) == 0).select("pos", "seq_id", "off")


def sampled_without_texts(index, step: int) -> DataFrame:
    """As ``sampled`` for an index without texts, by list ranking once; texts are numbered in their order."""
    places = materialize(places_of(index.edges, index.counts), "places")
    lengths = places.groupBy("seq_id").agg(F.max("back").alias("n"))
    found = places.join(lengths, "seq_id").select("pos", "seq_id", (F.col("n") - F.col("back")).alias("off"))
    return found.where(F.pmod("off", F.lit(step)) == 0)


def walked(at: DataFrame, index, step: int) -> DataFrame:
    """``at``(pos, ...) with seq_id and off of the suffix at each position: a step back a round until a sampled place is met, ``step`` rounds at most.

    Only positions that are asked for move; the blocks and the sampled places lie in buckets and stay.
    """
    names = [n for n in at.columns if n != "pos"]
    places = index.places(step)
    (now, n), done = materialize_counted(at.withColumn("_back", F.lit(0).cast("long")), "walk"), []
    while n:
        few = n <= lookups.SENT
        met, hits = materialize_counted(places.join(F.broadcast(now) if few else now, "pos"), "met")
        done.append(met.select(*names, "seq_id", (F.col("off") + F.col("_back")).alias("off")))
        if hits == n:
            break
        ahead = now.join(met.select("pos").distinct(), "pos", "left_anti")
        stepped = lookups.step_back(ahead, index.blocks, index.counts, size=index.block_size, few=few)
        now, n = materialize_counted(stepped.select("pos", (F.col("_back") + 1).alias("_back"), *names), "walk")
    out = done[0] if done else now.select(*names, F.lit(0).cast("long").alias("seq_id"), F.lit(0).cast("long").alias("off"))
    for part in done[1:]:
        out = out.unionByName(part)
    return out


_PLACES = "chunk long, n long, at binary, seqs binary, offs binary"


def starts(bwt: DataFrame, sequences: int, step: int, size: int) -> DataFrame:
    """(chunk, n, at, seqs, offs) of bwt(pos, c, seq_id, off): where every ``step``-th symbol of each text and its end stand, packed by chunks of ``size`` positions."""

    def pack(batches):
        for batch in batches:
            pos, seq, off = (batch.column(k).to_numpy() for k in range(3))
            yield from _places(pos, seq, off, size)

    kept = bwt.where((F.pmod("off", F.lit(step)) == 0) | (F.col("pos") < sequences)).select("pos", "seq_id", "off")
    return materialize(kept.mapInArrow(pack, _PLACES), "starts", "zstd")


def _places(pos: np.ndarray, seq: np.ndarray, off: np.ndarray, size: int):
    """Rows of _PLACES, one for each chunk."""
    order = np.argsort(pos, kind="stable")
    pos, seq, off = pos[order], seq[order], off[order]
    edge = np.flatnonzero(np.diff(pos // size, prepend=-1)).tolist()
    rows = [(int(pos[a] // size), b - a, _pack(pos[a:b], True), _pack(seq[a:b]), _pack(off[a:b])) for a, b in zip(edge, [*edge[1:], len(pos)])]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=[f.split()[0] for f in _PLACES.split(", ")])


def spread_places(index, begin: DataFrame, step: int, size: int) -> DataFrame:
    """(chunk, n, at, seqs, offs): every position of an index once, with its text and the offset there, packed by chunks. Each of ``starts`` goes back to the next sampled place, so
    a round moves a place for every ``step`` positions, there are ``step`` rounds at most, and the chunks stay in their buckets."""
    spark, below, chunks = index.blocks.sparkSession, lookups.smaller(index.counts), _chunks(index, size)
    fields = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in _PLACES.split(", ")])

    def stepped(key, there, held):
        if not there.num_rows:
            return fields.empty_table()
        chunk, rows, out = key[0].as_py(), there.to_pylist(), []
        at, seqs, offs = np.concatenate([_unpack(r["at"], True) for r in rows]), *(np.concatenate([_unpack(r[n]) for r in rows]) for n in ("seqs", "offs"))
        goes = np.flatnonzero((offs > 0) & ((offs - 1) % step != 0))  # the others meet a sampled place, or the text begins
        at, seqs, offs = at[goes] - chunk * size, seqs[goes], offs[goes] - 1
        symbols, before = np.frombuffer(held.column("s")[0].as_py().encode(), np.uint8) - 48, held.column("before")[0].as_py()
        own = symbols[at]
        for c in range(1, SIGMA):
            mine = np.flatnonzero(own == c)
            if len(mine):
                to = below[c] + before[c] + np.searchsorted(np.flatnonzero(symbols == c), at[mine])
                out += _places(to, seqs[mine], offs[mine], size)
        return pa.Table.from_batches(out, fields)

    path = f"{shared_dir(spark)}/spread-{uuid.uuid4().hex}"
    now, k = begin, 0
    while True:
        seen = Observation()
        now.observe(seen, F.count(F.lit(1)).alias("open")).write.parquet(f"{path}/round={k}", compression="zstd")
        if not seen.get["open"]:
            return spark.read.schema(f"{_PLACES}, round int").parquet(path).drop("round")
        level = spark.read.schema(_PLACES).parquet(f"{path}/round={k}")
        now, k = level.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(stepped, _PLACES), k + 1


#: Rows that are put together at once.
TOLD = 1 << 20


def _met(ranges: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(pattern_id, seq_id, off) of ranges(pattern_id, lo, hi) and of every position's place, packed by chunks: a task has the ranges of a chunk, then its places, and gives rows some ranges at a time."""
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    kind = ranges.schema["pattern_id"].dataType
    asked = ranges.select(F.explode(F.sequence(cell("lo", size), cell(F.col("hi") - 1, size))).alias("chunk"), F.lit(0).alias("kind"), "pattern_id", "lo", "hi", *(none(n, "binary") for n in ("at", "seqs", "offs")))
    held = places.select("chunk", F.lit(1).alias("kind"), none("pattern_id", kind), none("lo", "long"), none("hi", "long"), "at", "seqs", "offs")
    buckets = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.unionByName(held).repartition(buckets, "chunk").sortWithinPartitions("chunk", "kind")

    def tell(batches):
        now, kept = None, []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
            for a, b in zip(edge, [*edge[1:], len(chunk)]):
                if kept and chunk[a] != now:
                    yield from told(int(now), pa.Table.from_batches(kept))
                    kept = []
                now = chunk[a]
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from told(int(now), pa.Table.from_batches(kept))

    def told(chunk, table):
        asks = int(np.count_nonzero(table.column(1).to_numpy() == 0))
        if not asks:
            return
        at, seqs, offs = (np.concatenate([_unpack(x, n == 5) for x in table.column(n)[asks:].to_pylist()]) for n in (5, 6, 7))
        order = np.argsort(at)  # every position of the chunk, once
        seqs, offs, names = seqs[order], offs[order], table.column(2)[:asks].combine_chunks()
        low, high = (np.clip(table.column(n)[:asks].to_numpy() - chunk * size, 0, len(at)) for n in (3, 4))
        n = high - low
        ends = np.cumsum(n)
        a = 0
        while a < asks:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOLD, "right")))
            m = n[a:b]
            pick = np.repeat(low[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(a, b), m))), pa.array(seqs[pick]), pa.array(offs[pick])], names=["pattern_id", "seq_id", "off"])
            a = b

    return rows.mapInArrow(tell, StructType([ranges.schema["pattern_id"], *StructType.fromDDL("seq_id long, off long").fields]))


def located(found: DataFrame, index, step: int = 32, block: int = 1 << 12) -> DataFrame:
    """(pattern_id, seq_id, off) of found(pattern_id, lo, hi): every place where a pattern occurs, from sampled places.

    A position is walked back from once, in however many patterns' ranges it lies; ranges meet the places by blocks of positions, an equi-join.
    Where so many are asked for that this takes more steps than the index has positions, all sampled places are walked back from instead, packed, each to the one before it.
    Work grows with the positions asked for, which the index bounds, and with the rows that are returned.
    """
    ranges = materialize(found.where("lo < hi").select("pattern_id", "lo", "hi"), "ranges")
    asked = min(index.bases, ranges.select("lo", "hi").distinct().agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] or 0)
    if asked > lookups.SENT and asked * step > 2 * index.bases:
        if index.starts(step) is None:  # texts are numbered in their order
            return located_in_index(ranges, index)
        begin, size = index.starts(step)
        return _met(ranges, spread_places(index, begin, step, size), size)
    each = ranges.select("lo", "hi").distinct().select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos")).distinct()
    places = materialize(walked(each.withColumn("_at", F.col("pos")), index, step), "located")
    cells = ranges.select("pattern_id", "lo", "hi", F.explode(F.sequence(cell("lo", block), cell(F.col("hi") - 1, block))).alias("blk"))
    return places.withColumn("blk", cell("_at", block)).join(cells, "blk").where("_at >= lo AND _at < hi").select("pattern_id", "seq_id", "off")


def extracted(at: DataFrame, index, most: int) -> DataFrame:
    """``at``(pos, ...) with ``before``: up to ``most`` symbols that stand before the suffix at each position in its text, spelled left to right by as many steps back."""
    names = [n for n in at.columns if n != "pos"]
    now = materialize(at.withColumn("before", F.lit("")), "extract")
    few = now.count() <= lookups.SENT
    for _ in range(most):  # where a text begins, a step changes nothing
        stepped = lookups.step_back(now, index.blocks, index.counts, size=index.block_size, few=few)
        spelled = F.when(F.col("c") > 0, F.concat(F.col("c").cast("string"), "before")).otherwise(F.col("before"))
        after = materialize(stepped.select("pos", spelled.alias("before"), *names), "extract")
        forget(now)
        now = after
    return now
