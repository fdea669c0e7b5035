"""Runs of equal symbols, and blocks of runs with the counts before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alphabet import SIGMA
from ..plans.order import BLOCK, before_blocks, cell
from ..plans.shared import materialize

#: Positions of a block of the index; at most 2**14.
SAMPLE = 1024


def pieces_of(bwt: DataFrame, block: int = BLOCK) -> DataFrame:
    """(start, c, len): runs of bwt(pos, c) in pieces, none of which crosses a multiple of ``block``.

    Every batch of rows gives the runs inside it and nothing moves; a transform lies in order, so most runs stay whole.
    """

    def encode(batches):
        for batch in batches:
            pos, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(pos) > 1 and (np.diff(pos) < 0).any():
                order = np.argsort(pos)
                pos, c = pos[order], c[order]
            if len(pos):
                cut = np.concatenate(([0], np.flatnonzero((np.diff(pos) != 1) | (np.diff(c) != 0) | (pos[1:] % block == 0)) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(pos[cut]), pa.array(c[cut].astype(np.int32)), pa.array(np.diff(np.append(cut, len(pos))))], names=["start", "c", "len"])

    return bwt.select(F.col("pos").cast("long").alias("pos"), F.col("c").cast("int").alias("c")).mapInArrow(encode, "start long, c int, len long")


def cut_at(parts: DataFrame, block: int) -> DataFrame:
    """(blk, start, c, len): pieces of runs(start, c, len) cut at multiples of ``block``, with the number of their block. Empty pieces vanish."""
    first, last = cell("start", block), cell(F.col("start") + F.col("len") - 1, block)
    spread = parts.where("len > 0").select("start", "c", (F.col("start") + F.col("len")).alias("stop"), F.explode(F.sequence(first, last)).alias("blk"))
    low = F.greatest("start", F.col("blk") * block)
    return spread.select("blk", low.alias("start"), "c", (F.least("stop", (F.col("blk") + 1) * block) - low).alias("len"))


def coalesce_runs(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Maximal runs(run_id, start, c, len) of runs in pieces, parts(start, c, len), which cover positions from 0 on without gaps: neighbours of one symbol become one.

    A piece begins a run where the symbol before, found inside its block of positions or at the end of the block before,
    differs. Beginnings are numbered inside blocks and by the blocks' sums.
    """
    rows = materialize(cut_at(parts, block), "pieces")
    edge = rows.groupBy((F.col("blk") + 1).alias("blk")).agg(F.max_by("c", "start").alias("last"))  # a row a block
    inside = W.partitionBy("blk").orderBy("start")
    prev = F.when(F.col("start") % block == 0, F.col("last")).otherwise(F.lag("c").over(inside))
    marked = rows.join(edge, "blk", "left").withColumn("head", F.when(prev == F.col("c"), 0).otherwise(1))
    numbered = materialize(marked.select("blk", "start", "c", "len", F.sum("head").over(inside).alias("g")), "heads")
    bases = before_blocks(numbered.groupBy("blk").agg(F.max("g").alias("n")), {"base": "n"}, "blk")
    whole = numbered.join(bases, "blk").groupBy((F.col("base") + F.col("g") - 1).alias("run_id"))
    return whole.agg(F.min("start").alias("start"), F.max("c").alias("c"), F.sum("len").alias("len")).select("run_id", "start", "c", "len")


def runs_of(bwt: DataFrame) -> DataFrame:
    """Maximal runs of bwt(pos, c), with positions from 0 without gaps: runs(run_id, start, c, len). The transform is read once."""
    return coalesce_runs(pieces_of(bwt))


def expand(runs: DataFrame) -> DataFrame:
    """bwt(pos, c) of runs(start, c, len)."""
    return runs.where("len > 0").select(F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos"), "c")


def expand_blocks(blocks: DataFrame) -> DataFrame:
    """bwt(pos, c) of the blocks of an index, a few of which are spelled at once."""

    def spell(batches):
        for batch in batches:
            row, start, c, length, _ = held_in(batch.column(1), batch.column(2))
            position = batch.column(0).to_numpy()[row] + start
            for a in range(0, len(row), 1 << 12):
                n = length[a : a + (1 << 12)]
                j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(position[a : a + (1 << 12)], n) + j), pa.array(np.repeat(c[a : a + (1 << 12)], n))], names=["pos", "c"])

    return blocks.where("sym <> ''").select("start_pos", "sym", "at").mapInArrow(spell, "pos long, c int")


def histogram(runs: DataFrame) -> DataFrame:
    """(c, len, n): how many runs of each symbol have each length."""
    return runs.groupBy("c", "len").agg(F.count("*").alias("n"))


def character_counts(bwt: DataFrame) -> DataFrame:
    """(c, n) for each symbol that occurs."""
    return bwt.groupBy("c").agg(F.count("*").alias("n"))


#: What a block holds. ``sym`` has a digit for each of its runs; ``at`` has for each run its start in the block, times 2**16, and how many of its
#: symbol come before it in the block; a last entry has the block's length.
BLOCKS = "blk long, start_pos long, end_pos long, n0 long, n1 long, n2 long, n3 long, n4 long, n5 long, sym string, at array<int>"


def blocks_of(pieces: DataFrame, size: int = SAMPLE) -> DataFrame:
    """blocks(blk, start_pos, end_pos, n0..n5, sym, at) of runs in pieces(start, c, len): the runs of each block of ``size`` positions, with what a search needs to rank and to access inside it.

    n0 to n5: how many of each symbol come before the block. Pieces are dealt out and sorted by block; each block is put together once.
    """
    ordered = cut_at(pieces, size).repartition("blk").sortWithinPartitions("blk", "start")
    names = [f.split()[0] for f in BLOCKS.replace(" n", " m").split(", ")]

    def assemble(batches):
        kept: list = []
        for batch in batches:
            if batch.num_rows:
                columns = [np.concatenate(x) for x in zip(*kept, [batch.column(k).to_numpy() for k in range(4)])]
                done = int(np.searchsorted(columns[0], columns[0][-1]))
                if done:
                    yield pa.RecordBatch.from_arrays(_packed(*(x[:done] for x in columns), size), names=names)
                kept = [[x[done:] for x in columns]]
        if kept:
            yield pa.RecordBatch.from_arrays(_packed(*kept[0], size), names=names)

    made = BLOCKS.replace(" n", " m")
    own = materialize(ordered.mapInArrow(assemble, made), "runs-of-blocks")
    bases = before_blocks(own.select("blk", *(f"m{k}" for k in range(SIGMA))), {f"n{k}": f"m{k}" for k in range(SIGMA)}, "blk")
    return own.join(bases, "blk").select(*(f.split()[0] for f in BLOCKS.split(", ")))


def _packed(blk, start, c, length, size: int) -> list[pa.Array]:
    """The columns of BLOCKS of some runs in pieces, sorted; n0 to n5 are those of the block itself."""
    new = np.concatenate(([True], (np.diff(blk) != 0) | (np.diff(c) != 0)))  # pieces of one run inside a block become one
    first = np.flatnonzero(new)
    length = np.add.reduceat(length, first)
    blk, start, c = blk[first], start[first], c[first]
    edge = np.concatenate(([0], np.flatnonzero(np.diff(blk)) + 1, [len(blk)]))
    total, before = np.zeros((len(edge) - 1, SIGMA), np.int64), np.zeros(len(blk), np.int64)
    for k in range(SIGMA):
        own = np.where(c == k, length, 0)
        sums = np.concatenate(([0], np.cumsum(own)))
        total[:, k] = sums[edge[1:]] - sums[edge[:-1]]
        before = np.where(c == k, sums[:-1] - np.repeat(sums[edge[:-1]], np.diff(edge)), before)
    blocks = blk[edge[:-1]]
    ends = start[edge[1:] - 1] + length[edge[1:] - 1]
    entries = np.insert((start - blk * size) << 16 | before, edge[1:], (ends - blocks * size) << 16).astype(np.int32)
    offsets = edge + np.arange(len(edge))
    digits = (c + 48).astype(np.uint8).tobytes().decode()
    sym = [digits[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    at = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(entries))
    return [pa.array(blocks), pa.array(blocks * size), pa.array(ends), *(pa.array(total[:, k]) for k in range(SIGMA)), pa.array(sym), at]


def _runs_in(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, c, length, last) of the runs in a batch of spelled(blk, s): the row each is in, where it starts in it, its symbol, and whether it is the row's last."""
    parts = batch.column(1).to_pylist()
    digits = np.frombuffer("".join(parts).encode(), np.uint8) - 48
    lengths = np.array([len(p) for p in parts], np.int64)
    edge = np.cumsum(lengths) - lengths
    new = np.append(True, np.diff(digits) != 0)[: len(digits)]
    new[edge] = True
    first = np.flatnonzero(new)
    row = np.repeat(np.arange(len(parts)), lengths)[first]
    return row, first - edge[row], digits[first].astype(np.int32), np.diff(np.append(first, len(digits))), np.append(np.diff(row) != 0, True)[: len(row)]


def blocks_of_spelled(spelled: DataFrame, size: int = SAMPLE) -> DataFrame:
    """As ``blocks_of`` of spelled(blk, s) in blocks of ``size``: only counts move where it lies in buckets of ``blk``, and the rows stay in them."""

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                row, at, c, length, _ = _runs_in(batch)
                blk = batch.column(0).to_numpy()[row]
                made = _packed(blk, blk * size + at, c, length, size)
                yield pa.RecordBatch.from_arrays([*made[:3], *(batch.column(2 + k) for k in range(SIGMA)), *made[-2:]], names=[f.split()[0] for f in BLOCKS.split(", ")])

    own = [(F.length("s") - F.length(F.replace("s", F.lit(str(k)), F.lit("")))).cast("long").alias(f"m{k}") for k in range(SIGMA)]
    bases = before_blocks(spelled.select("blk", *own), {f"n{k}": f"m{k}" for k in range(SIGMA)}, "blk")
    return spelled.join(bases.hint("merge"), "blk").select("blk", "s", *(f"n{k}" for k in range(SIGMA))).mapInArrow(encode, BLOCKS)


def spelled_of(blocks: DataFrame) -> DataFrame:
    """spelled(blk, s) of the blocks of an index."""

    def spell(batches):
        for batch in batches:
            sizes = [np.diff(a.to_numpy(zero_copy_only=False) >> 16) if len(a) else a for a in (x.values for x in batch.column(2))]
            parts = [np.repeat(np.frombuffer(s.encode(), np.uint8), n).tobytes().decode() for s, n in zip(batch.column(1).to_pylist(), sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.string())], names=["blk", "s"])

    return blocks.where("sym <> ''").select("blk", "sym", "at").mapInArrow(spell, "blk long, s string")


def _edged(spelled: DataFrame, size: int) -> DataFrame:
    """Maximal runs(run_id, start, c, len) of which an end meets a bound of the blocks of ``spelled``. What lies between the first and the last run of a block passes as one run of a symbol of its own."""

    def ends(batches):
        for batch in batches:
            row, at, c, length, last = _runs_in(batch)
            first = at == 0
            kept = first | last | np.append(False, first)[: len(first)]  # the second run of a block stands for all up to the last
            row, at, c, last, first, end = row[kept], at[kept], c[kept], last[kept], first[kept], (at + length)[kept]
            c = np.where(first | last, c, SIGMA)
            stop = np.where(first | last, end, np.append(at[1:], 0)[: len(at)])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row] * size + at), pa.array(c.astype(np.int32)), pa.array(stop - at)], names=["start", "c", "len"])

    return coalesce_runs(spelled.mapInArrow(ends, "start long, c int, len long")).where(F.col("c") < SIGMA)


def histogram_of_spelled(spelled: DataFrame, size: int) -> DataFrame:
    """(c, len, n) of spelled(blk, s) in blocks of ``size``: runs inside a block are counted where it lies, and only those at its ends are put together."""

    def count(batches):
        for batch in batches:
            _, at, c, length, last = _runs_in(batch)
            inside = (at > 0) & ~last
            found, n = np.unique(c[inside] * (size + 1) + length[inside], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found // (size + 1)).astype(np.int32)), pa.array(found % (size + 1)), pa.array(n)], names=["c", "len", "n"])

    edges = _edged(spelled, size).groupBy("c", "len").agg(F.count("*").alias("n"))
    return spelled.mapInArrow(count, "c int, len long, n long").unionByName(edges).groupBy("c", "len").agg(F.sum("n").alias("n"))


def _numbers(ends: DataFrame) -> DataFrame:
    """(blk, base, on) of ends(blk, m, first, last), a row a block with its number of runs and the symbols it begins and ends with: the number of the first run that begins in the block, and 1 where the block goes on with the run before."""
    ends = materialize(ends, "ends")
    behind = ends.select((F.col("blk") + 1).alias("blk"), F.col("last").alias("_last"))
    on = F.coalesce((F.col("first") == F.col("_last")).cast("long"), F.lit(0)).alias("on")
    starts = materialize(ends.join(behind, "blk", "left").select("blk", on, "m").select("blk", "on", (F.col("m") - F.col("on")).alias("m")), "starts")
    return before_blocks(starts, {"base": "m"}, "blk").join(starts.select("blk", "on"), "blk")


def runs_of_spelled(spelled: DataFrame, size: int) -> DataFrame:
    """Maximal runs(run_id, start, c, len) of spelled(blk, s) in blocks of ``size``. Runs inside a block are final there; those that meet its ends are put together by their numbers, two rows a block."""

    def number(batches):
        for batch in batches:
            row, _, c, _, last = _runs_in(batch)
            first = np.append(True, np.diff(row) != 0)[: len(row)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array(np.diff(np.append(np.flatnonzero(first), len(row)))), pa.array(c[first]), pa.array(c[last])], names=["blk", "m", "first", "last"])

    bases = _numbers(spelled.mapInArrow(number, "blk long, m long, first int, last int"))
    named = spelled.join(bases, "blk").select("blk", "s", "base", "on")

    def emit(batches):
        for batch in batches:
            row, at, c, length, final = _runs_in(batch)
            blk, base, on = (batch.column(k).to_numpy() for k in (0, 2, 3))
            begins = np.cumsum(at == 0) - 1
            nth = np.arange(len(row)) - np.flatnonzero(at == 0)[begins]
            yield pa.RecordBatch.from_arrays([pa.array(base[row] + nth - on[row]), pa.array(blk[row] * size + at), pa.array(c), pa.array(length), pa.array((at == 0) | final)], names=["run_id", "start", "c", "len", "edge"])

    each = materialize(named.mapInArrow(emit, "run_id long, start long, c int, len long, edge boolean"), "runs", "zstd")
    edges = each.where("edge").groupBy("run_id").agg(F.min("start").alias("start"), F.max("c").alias("c"), F.sum("len").alias("len"))
    return each.where("NOT edge").drop("edge").unionByName(edges)


def held_in(sym: pa.Array, at: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, c, length, before) of the runs that columns ``sym`` and ``at`` of blocks hold: the row each is in, where it starts there, its symbol, and how many of that come before it in the block."""
    entries, sizes = at.flatten().to_numpy(zero_copy_only=False), at.value_lengths().to_numpy(zero_copy_only=False)
    kept = np.ones(len(entries), bool)
    kept[np.cumsum(sizes)[sizes > 0] - 1] = False  # a block's length, behind its runs
    start = (entries >> 16).astype(np.int64)
    length = np.append(start[1:], 0)[: len(start)] - start
    digits = np.frombuffer("".join(sym.to_pylist()).encode(), np.uint8) - 48
    return np.repeat(np.arange(len(sizes)), np.maximum(sizes - 1, 0)), start[kept], digits.astype(np.int32), length[kept], (entries[kept] & 0xFFFF).astype(np.int64)


def runs_of_blocks(blocks: DataFrame) -> DataFrame:
    """Maximal runs(run_id, start, c, len) of the blocks of an index, which stay where they lie. How they are numbered follows from their ends, a row a block; only runs that meet these ends are put together."""
    held = blocks.where("sym <> ''").select("blk", "start_pos", "sym", "at")
    digit = lambda at: F.ascii(F.substr("sym", at, F.lit(1))) - 48
    m = F.length("sym")
    bases = materialize(_numbers(held.select("blk", m.cast("long").alias("m"), digit(F.lit(1)).alias("first"), digit(m).alias("last"))), "bases")
    named = held.join(bases, "blk")
    run = lambda number, k, at: F.struct((F.col("base") - F.col("on") + number).alias("run_id"), (F.col("start_pos") + start_of(F.get("at", k))).alias("start"), digit(at).alias("c"), (start_of(F.get("at", k + 1)) - start_of(F.get("at", k))).cast("long").alias("len"))
    first, last = run(F.lit(0), F.lit(0), F.lit(1)), run(m - 1, m - 1, m)
    ends = named.select(F.explode(F.when(m == 1, F.array(first)).otherwise(F.array(first, last))).alias("x")).select("x.*")
    edges = materialize(ends.groupBy("run_id").agg(F.min("start").alias("start"), F.max("c").alias("c"), F.sum("len").alias("len")), "edges")

    def emit(batches):
        for batch in batches:
            row, start, c, length, _ = held_in(batch.column(1), batch.column(2))
            first = np.append(True, np.diff(row) != 0)[: len(row)]
            inside = ~first & np.append(~first[1:], False)[: len(row)]
            nth = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            number, position = (batch.column(k).to_numpy()[row][inside] for k in (3, 0))
            yield pa.RecordBatch.from_arrays([pa.array(number + nth[inside]), pa.array(position + start[inside]), pa.array(c[inside]), pa.array(length[inside])], names=["run_id", "start", "c", "len"])

    inner = named.select("start_pos", "sym", "at", (F.col("base") - F.col("on")).alias("number")).mapInArrow(emit, "run_id long, start long, c int, len long")
    return inner.unionByName(edges)


def start_of(entry: Column) -> Column:
    """Where a run starts in its block."""
    return F.shiftright(entry, 16)


def before_in(entry: Column) -> Column:
    """How many of a run's symbol come before it in its block."""
    return entry.bitwiseAND(F.lit(0xFFFF))


def run_rows(blocks: DataFrame) -> DataFrame:
    """(start, c, len, r): the runs of each block, and the rank of each one's first symbol in the whole transform."""
    each = F.transform(F.sequence(F.lit(1), F.length("sym")), lambda j: F.struct(F.get("at", j - 1).alias("e"), start_of(F.get("at", j)).alias("stop"), (F.ascii(F.substr("sym", j, F.lit(1))) - 48).alias("c")))
    rows = blocks.where("sym <> ''").select("start_pos", *(f"n{k}" for k in range(SIGMA)), F.explode(each).alias("x"))
    before = F.coalesce(*(F.when(F.col("x.c") == k, F.col(f"n{k}")) for k in range(SIGMA)))
    return rows.select((F.col("start_pos") + start_of(F.col("x.e"))).alias("start"), F.col("x.c").alias("c"), (F.col("x.stop") - start_of(F.col("x.e"))).cast("long").alias("len"), (before + before_in(F.col("x.e"))).alias("r"))


def samples_of(blocks: DataFrame) -> DataFrame:
    """samples(block, start_pos, end_pos, n0..n5)."""
    return blocks.select(F.col("blk").alias("block"), "start_pos", "end_pos", *(f"n{k}" for k in range(SIGMA)))


def storage(blocks: DataFrame) -> DataFrame:
    """One row: blocks, positions, runs, and the bytes that the runs take, five for each and four for each block."""
    n = F.sum(F.length("sym"))
    return blocks.agg(F.count("*").alias("blocks"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("positions"), n.alias("runs"), (n + 4 * F.sum(F.size("at"))).alias("bytes"))


def checksum(bwt: DataFrame) -> DataFrame:
    """(rows, checksum): a hash of all (pos, c) that any order of adding up gives."""
    return bwt.agg(F.count("*").alias("rows"), F.sum(F.xxhash64("pos", "c").cast("decimal(38,0)")).alias("checksum"))


# fixed values: offset basis and prime of 64-bit FNV-1a
_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Maps that one task joins to one.
JOINED = 4096
_MAPS = "g long, factor string, addends array<string>, states array<int>"


def content_map(blocks: DataFrame, joined: int = JOINED) -> DataFrame:
    """One row (g, factor, addends, states), or none for no blocks: what FNV-1a (64 bits) over the comp values of the blocks in order does to a hash.

    Symbols are below 8, so a block's effect depends on the lowest three bits of the hash before it alone; for each of
    the eight states it is a factor and an addend. Such maps follow each other associatively, so tasks join
    ``joined`` neighbours to one, again and again, until a single map is left.
    """

    def encode(batches):
        prime, low = np.uint64(_PRIME), np.uint64(7)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [np.diff(np.array(a) >> 16) for a in batch.column(2).to_pylist()]
            spelled = [np.repeat(np.frombuffer(s.encode(), np.uint8) - 48, n) for s, n in zip(batch.column(1).to_pylist(), sizes)]
            lengths = np.array([len(s) for s in spelled])
            symbols = np.zeros((len(spelled), lengths.max()), np.uint64)
            for k, s in enumerate(spelled):
                symbols[k, : len(s)] = s
            state = np.tile(np.arange(8, dtype=np.uint64), (len(spelled), 1))
            addend, factor = np.zeros_like(state), np.ones(len(spelled), np.uint64)
            for j in range(symbols.shape[1]):
                on = (j < lengths)[:, None]
                changed = state ^ symbols[:, j : j + 1]
                addend = np.where(on, (addend + changed - state) * prime, addend)
                state = np.where(on, (changed * prime) & low, state)
                factor = np.where(on[:, 0], factor * prime, factor)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(factor.astype(str).tolist()), pa.array(addend.astype(str).tolist(), pa.list_(pa.string())), pa.array(state.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["g", "factor", "addends", "states"])

    def join(key, table):
        rows = sorted(zip(*(table[c].to_pylist() for c in ("g", "factor", "addends", "states"))))
        factor, sums, at, mask = 1, [0] * 8, list(range(8)), (1 << 64) - 1
        for _, f, a, states in rows:
            f = int(f)
            sums, factor, at = [(s * f + int(a[k])) & mask for s, k in zip(sums, at)], factor * f & mask, [states[k] for k in at]
        return pa.table({"g": [key[0].as_py()], "factor": [str(factor)], "addends": [[str(x) for x in sums]], "states": pa.array([at], pa.list_(pa.int32()))})

    now = blocks.select("blk", "sym", "at").mapInArrow(encode, _MAPS)
    last = blocks.agg(F.max("blk")).first()[0] or 0
    while True:
        now, last = now.groupBy(cell("g", joined).alias("k")).applyInArrow(join, _MAPS), last // joined
        if not last:
            return now


def hash_of(maps: DataFrame) -> DataFrame:
    """One row with ``fnv1a``, 16 hexadecimal digits: the hash that a content map gives; that of nothing without one."""
    mask, low = (1 << 64) - 1, _BASIS & 7

    def apply(batches):
        h = _BASIS
        for batch in batches:
            for factor, addends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = (h * int(factor) + int(addends[low])) & mask
        yield pa.RecordBatch.from_arrays([pa.array([f"{h:016x}"])], names=["fnv1a"])

    return maps.select("factor", "addends").coalesce(1).mapInArrow(apply, "fnv1a string")  # a row at most


def content_hash(blocks: DataFrame) -> int:
    """FNV-1a (64 bits) over the comp values of blocks in order, for comparison with other tools."""
    return int(hash_of(content_map(blocks)).first()[0], 16)
