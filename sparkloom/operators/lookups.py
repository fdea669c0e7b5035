"""Rank, select, access and the mappings between positions, for whole tables of questions.

Questions meet blocks(blk, start_pos, end_pos, n0..n5, sym, at) by an equi-join on
the block of their position, so each reads one block, however long the transform is. The blocks lie in
buckets of their number (``Index`` writes them so), so only questions move: to the blocks' buckets, or to all workers where
there are few. Few questions find the run of a position by halving; many meet their block in a task that spells it once for all of its questions.
Ranges are half-open. ``counts`` are the six symbol counts of the transform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.alphabet import SIGMA
from ..plans.order import cell
from ..plans.shared import materialize
from .runs import SAMPLE, held_in

#: Questions that are sent to all workers at most, a few numbers each.
SENT = 1 << 17
#: Occurrences of a symbol that a cell of the select directory covers.
STRIDE = 256
#: Runs of blocks that are spelled together.
SPELLED = 1 << 12


def smaller(counts: list[int]) -> list[int]:
    """How many symbols are smaller than each comp value."""
    return [sum(counts[:k]) for k in range(len(counts))]


# What is asked inside a block is written as SQL text: it says the same for every lookup, and the session parses it faster than columns can be put together.


def _one_of(c: str, values: list) -> str:
    """The value for the symbol ``c``; 0 for other symbols."""
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN {v if isinstance(v, str) else f'{v}L'}" for k, v in enumerate(values)) + " ELSE 0L END"


#: Counts before the block by symbol.
_BEFORE = [f"n{k}" for k in range(SIGMA)]


def _halved(most: int, holds: str, size: str) -> str:
    """The largest k up to ``size`` (at most ``most``) for which ``holds``, with k in place of its braces, does, or 0, if it holds up to some k only: found by halving."""
    steps = ", ".join(str(1 << k) for k in range(most.bit_length() - 1, -1, -1))
    return f"aggregate(array({steps}), 0, (k, step) -> if(k + step <= {size} AND {holds.replace('{}', '(k + step)')}, k + step, k))"


def _run(offset: str, size: int) -> str:
    """How many runs of the block start before ``offset``."""
    return _halved(size, f"shiftright(get(at, {{}} - 1), 16) < {offset}", "size(at) - 1")


def _last(runs: str, c: str) -> str:
    """Which of the first ``runs`` runs of the block is the last of ``c`` (a digit), from 1; 0 without one."""
    return f"{runs} - length(substring_index(substr(sym, 1, {runs}), {c}, -1))"


def _inside(c: str) -> str:
    """How often ``c`` (a digit) occurs in the block before place ``_o``, of which ``_k`` runs start before it: what its last run before counts, and as much of that run as lies before."""
    within = "if(j > 0, (get(at, j - 1) & 65535) + least(_o, shiftright(get(at, j), 16)) - shiftright(get(at, j - 1), 16), 0)"
    return f"cast(get(transform(array({_last('_k', c)}), j -> {within}), 0) AS LONG)"


def counted(runs: str, c: str) -> str:
    """How often ``c`` (a digit) occurs in the first ``runs`` runs of the block."""
    within = "if(j > 0, (get(at, j - 1) & 65535) + shiftright(get(at, j), 16) - shiftright(get(at, j - 1), 16), 0)"
    return f"get(transform(array({_last(runs, c)}), j -> {within}), 0)"


def _question(at: DataFrame) -> Column:
    """A question's columns as one, so that no name of theirs clashes with a block's."""
    return F.struct(*(F.col(f"`{n}`").alias(n) for n in at.columns)).alias("_q")


def _asked(name: str) -> str:
    return f"_q.`{name}`"


class _Spelled:
    """A block as its symbols, with how many of each come before each of its places and its end, in the whole transform."""

    def __init__(self, block: dict):
        self.start, runs = block["start_pos"], np.array(block["at"]) >> 16
        self.symbols = np.repeat(np.frombuffer(block["sym"].encode(), np.uint8) - 48, np.diff(runs))
        self.before = np.zeros((len(self.symbols) + 1, SIGMA), np.int64)
        self.before[np.arange(1, len(self.symbols) + 1), self.symbols] = 1
        self.before[0] = [block[n] for n in _BEFORE]
        np.cumsum(self.before, axis=0, out=self.before)


def _told(asked: DataFrame, blocks: DataFrame, look, out: str) -> DataFrame:
    """asked(_q, _i, _c, blk) as ``_q`` and the columns ``out``: what ``look`` tells of a spelled block, places _i and symbols _c.

    A task has the questions in the order of their blocks. Only the first one of a block carries it, so a block passes once, however many
    questions it has, and a task holds one. Neither side is sent to all workers, as sizes that Spark guesses of questions tell nothing.
    """
    numbered = asked.withColumn("_n", F.row_number().over(W.partitionBy("blk").orderBy("_i")))
    carried = F.when(F.col("_n") == 1, F.struct("start_pos", *_BEFORE, "sym", "at")).alias("_b")
    rows = numbered.hint("merge").join(blocks, "blk").select("_q", F.col("_i").cast("long"), F.col("_c").cast("long"), "blk", "_n", carried).sortWithinPartitions("blk", "_n")
    names = [f.split()[0] for f in out.split(", ")]
    kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in out.split(", ")]

    def tell(batches):
        block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            i, c, blk, nth = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            edge = np.append(np.flatnonzero(np.append(True, np.diff(blk) != 0)), len(blk)).tolist()
            found = []
            for a, b in zip(edge, edge[1:]):
                if nth[a] == 1:
                    block = _Spelled(batch.column(5)[a].as_py())
                found.append(look(block, i[a:b], c[a:b]))
            told = [np.concatenate(x) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x).cast(kind) for x, kind in zip(told, kinds))], names=["_q", *names])

    return rows.mapInArrow(tell, StructType([asked.schema["_q"], *StructType.fromDDL(out).fields]))


def _asked_of(at: DataFrame, counts: list[int], pos: str, c: str | None, size: int) -> DataFrame:
    """asked(_q, _i, _c, blk) as ``meet`` deals questions out: one outside, with some block and place 0, is answered beside it."""
    total = sum(counts)
    inside = F.coalesce((F.col(pos) >= 0) & (F.col(pos) < total), F.lit(False))
    asked = at.select(_question(at), F.when(inside, F.col(pos)).cast("long").alias("_p"), (F.coalesce(F.col(c), F.lit(-1)) if c else F.lit(0)).alias("_c"))
    some = F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-total // size))))
    blk = F.when(F.col("_p").isNull(), some).otherwise(cell("_p", size)).cast("long")
    return asked.select("_q", F.coalesce("_p", F.lit(-1).cast("long")).alias("_i"), "_c", blk.alias("blk"))


def _rank_at(block: _Spelled, i: np.ndarray, c: np.ndarray) -> tuple:
    known = (c >= 0) & (c < SIGMA)
    return (np.where(known, block.before[np.maximum(i - block.start, 0), np.where(known, c, 0)], 0),)


def _ranks_at(block: _Spelled, i: np.ndarray, c: np.ndarray) -> list:
    return list(block.before[np.maximum(i - block.start, 0), 1:].T)


def _symbol_at(block: _Spelled, i: np.ndarray, c: np.ndarray) -> tuple:
    o = np.maximum(i - block.start, 0)
    own = block.symbols[o]
    return own.astype(np.int64), block.before[o, own]


def _place_of(block: _Spelled, i: np.ndarray, c: np.ndarray) -> tuple:
    """Where occurrences ``i`` (from 0, in the whole transform) of symbols ``c`` stand."""
    sorted_ = np.argsort(block.symbols, kind="stable")
    first = np.cumsum(np.bincount(block.symbols, minlength=SIGMA)) - np.bincount(block.symbols, minlength=SIGMA)
    return (block.start + sorted_[first[c] + i - block.before[0, c]],)


def meet(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str, size: int, few: bool = False) -> DataFrame:
    """Each question, in the struct ``_q``, with its block, and in ``_o`` its place there; a position outside (``_i`` is null) meets some block, as any will do, and place 0.

    So questions from outside, however many, do not crowd at the first or the last block. Questions pass by their block, one row, and are not gathered beside it.
    The join is an inner one, so the blocks may stay where they are: ``few`` says that at most SENT questions are there, which go to all workers.
    Nothing is met in an empty transform.
    """
    total = sum(counts)
    inside = F.coalesce((F.col(pos) >= 0) & (F.col(pos) < total), F.lit(False))
    asked = at.select(_question(at), F.when(inside, F.col(pos)).cast("long").alias("_i"))
    some = F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-total // size))))
    asked = asked.withColumn("blk", F.when(F.col("_i").isNull(), some).otherwise(cell("_i", size)).cast("long"))
    return (F.broadcast(asked) if few else asked).join(blocks, "blk").withColumn("_o", F.expr("int(coalesce(_i - start_pos, 0L))"))


def _or_outside(inside: str, past: str, pos: str, counts: list[int]) -> str:
    """A rank at a position inside, ``past`` at one past the end, and 0 before the start and for null."""
    return f"CASE WHEN {_asked(pos)} BETWEEN 0 AND {sum(counts) - 1} THEN {inside} WHEN {_asked(pos)} >= {sum(counts)} THEN {past} ELSE 0L END"


def _tidy(met: DataFrame, at: DataFrame, *more) -> DataFrame:
    return met.select(*(F.expr(_asked(n)).alias(n) for n in at.columns), *more)


def _whole(found: DataFrame, at: DataFrame, counts: list[int], out: list[str]) -> DataFrame:
    """Answers; in an empty transform all are 0."""
    return found if sum(counts) else at.select("*", *(F.lit(0).cast("long").alias(n) for n in out))


def rank(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str = "i", c: str = "c", out: str = "rank", size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at`` with how often symbol ``c`` occurs before position ``pos``; 0 for other symbols and null ones; positions past the end count as the end."""
    if not few:
        found = _told(_asked_of(at, counts, pos, c, size), blocks, _rank_at, "_v long")
        value = _or_outside("_v", _one_of(_asked(c), counts), pos, counts)
        return _whole(_tidy(found, at, F.expr(value).alias(out)), at, counts, [out])
    met = meet(at, blocks, counts, pos, size, few).withColumn("_k", F.expr(_run("_o", size)))
    value = f"if({_asked(c)} BETWEEN 0 AND {SIGMA - 1}, {_one_of(_asked(c), _BEFORE)} + {_inside(f'string({_asked(c)})')}, 0L)"
    value = _or_outside(value, _one_of(_asked(c), counts), pos, counts)
    return _whole(_tidy(met, at, F.expr(value).alias(out)), at, counts, [out])


def ranks(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str = "i", size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at`` with r1 to r5: the ranks of all symbols but the end marker, from one look at the block."""
    names = [f"r{k}" for k in range(1, SIGMA)]
    if not few:
        found = _told(_asked_of(at, counts, pos, None, size), blocks, _ranks_at, ", ".join(f"_v{k} long" for k in range(1, SIGMA)))
        value = lambda k: _or_outside(f"_v{k}", f"{counts[k]}L", pos, counts)
        return _whole(_tidy(found, at, *(F.expr(value(k)).alias(f"r{k}") for k in range(1, SIGMA))), at, counts, names)
    met = meet(at, blocks, counts, pos, size, few).withColumn("_k", F.expr(_run("_o", size)))
    return _whole(_tidy(met, at, *(F.expr(_or_outside(f"n{k} + {_inside(repr(str(k)))}", f"{counts[k]}L", pos, counts)).alias(f"r{k}") for k in range(1, SIGMA))), at, counts, names)


def ranks_together(at: DataFrame, blocks: DataFrame, n: int, size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at``(coll, pos, total, ...) with r1 to r5, for the blocks of ``n`` transforms laid out together: block b of transform ``coll`` has the number b * n + coll. total: positions of that transform, more than none."""
    asked = at.select(_question(at), F.least(F.greatest(F.col("pos"), F.lit(0)), F.col("total")).cast("long").alias("_i"), "total", "coll")
    asked = asked.select("_q", "_i", (F.least(cell("_i", size), cell(F.col("total") - 1, size)) * n + F.col("coll")).alias("blk"))
    met = blocks.join(F.broadcast(asked) if few else asked, "blk").withColumn("_o", (F.col("_i") - F.col("start_pos")).cast("int")).withColumn("_k", F.expr(_run("_o", size)))
    return _tidy(met, at, *(F.expr(f"n{k} + {_inside(repr(str(k)))}").alias(f"r{k}") for k in range(1, SIGMA)))


def range_ranks(at: DataFrame, blocks: DataFrame, counts: list[int], lo: str = "lo", hi: str = "hi", size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at`` with r1_lo, r1_hi to r5_lo, r5_hi: the ranks of all symbols at both ends of a half-open range."""
    first = ranks(at, blocks, counts, lo, size, few).withColumnsRenamed({f"r{k}": f"r{k}_lo" for k in range(1, SIGMA)})
    return ranks(first, blocks, counts, hi, size, few).withColumnsRenamed({f"r{k}": f"r{k}_hi" for k in range(1, SIGMA)})


def inverse_select(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str = "i", size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at`` with c and r: the symbol at each position and its rank there, from one look at the block; both 0 outside."""
    if not few:
        found = _told(_asked_of(at, counts, pos, None, size), blocks, _symbol_at, "_c int, _r long")
        inside = lambda v: F.expr(f"if({_asked(pos)} BETWEEN 0 AND {sum(counts) - 1}, {v}, 0)")
        done = _tidy(found, at, inside("_c").alias("c"), inside("_r").cast("long").alias("r"))
        return done if sum(counts) else at.select("*", F.lit(0).alias("c"), F.lit(0).cast("long").alias("r"))
    met = meet(at, blocks, counts, pos, size, few).withColumn("_k", F.expr(_run("_o + 1", size))).withColumn("_c", F.expr("ascii(substr(sym, _k, 1)) - 48"))
    value = f"{_one_of('_c', _BEFORE)} + (get(at, _k - 1) & 65535) + _o - shiftright(get(at, _k - 1), 16)"
    done = _tidy(met, at, F.expr("if(_i IS NULL, 0, _c)").alias("c"), F.expr(f"if(_i IS NULL, 0L, {value})").alias("r"))
    return done if sum(counts) else at.select("*", F.lit(0).alias("c"), F.lit(0).cast("long").alias("r"))


def access(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str = "i", out: str = "c", size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at`` with the symbol at each position; 0 outside."""
    names = [n for n in at.columns if n != out]
    return inverse_select(at.select(*names), blocks, counts, pos, size, few).select(*names, F.col("c").alias(out))


def extract(ranges: DataFrame, blocks: DataFrame, counts: list[int], lo: str = "lo", hi: str = "hi", out: str = "digits", size: int = SAMPLE) -> DataFrame:
    """``ranges`` with the symbols of each half-open range as digits; null where it is empty or passes the end.

    A range goes to the blocks that it covers, in one row a block with all of that block's ranges; a task spells a block once and cuts them out of it. What
    lies in one block is done there, and only the parts of ranges over several blocks are put together.
    """
    keys = ranges.columns
    good = F.coalesce((F.col(lo) >= 0) & (F.col(lo) < F.col(hi)) & (F.col(hi) <= sum(counts)), F.lit(False))
    asked = ranges.where(good).select(_question(ranges), F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi"), F.monotonically_increasing_id().alias("_id"))
    asked = materialize(asked, "ranges") if sum(counts) else asked  # ids are given once
    first, last = cell("_lo", size), cell(F.col("_hi") - 1, size)
    cells = asked.select("_id", "_lo", "_hi", F.explode(F.sequence(first, last)).alias("blk"))
    numbered = cells.withColumn("_n", F.row_number().over(W.partitionBy("blk").orderBy("_lo")))
    carried = [F.when(F.col("_n") == 1, F.col(n)).alias(n) for n in ("sym", "at")]  # by a block's first range only
    rows = numbered.join(blocks, "blk").select("_id", (F.col("_lo") - F.col("start_pos")).alias("a"), (F.col("_hi") - F.col("start_pos")).alias("b"), "blk", "_n", *carried).sortWithinPartitions("blk", "_n")

    def cut(batches):
        text = ""
        for batch in batches:
            parts = []
            for a, b, sym, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), batch.column(6)):
                if sym is not None:
                    text = np.repeat(np.frombuffer(sym.encode(), np.uint8), np.diff(at.values.to_numpy(zero_copy_only=False) >> 16)).tobytes().decode()
                parts.append(text[max(a, 0) : b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(parts, pa.string())], names=["_id", "blk", "p"])

    found = rows.mapInArrow(cut, "_id long, blk long, p string").join(asked, "_id").withColumn("_one", first == last)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "p"))), lambda x: x["p"]), "").alias(out)
    whole = found.where("_one").select("_q", F.col("p").alias(out)).unionByName(found.where("NOT _one").groupBy("_id").agg(F.any_value("_q").alias("_q"), joined).drop("_id"))
    return _tidy(whole, ranges, out).unionByName(ranges.where(~good).select(*keys, F.lit(None).cast("string").alias(out)))


def edges(blocks: DataFrame, counts: list[int]) -> DataFrame:
    """lf(pos, c, r, lf): for each position its symbol, the symbol's rank there, and where it maps to. For the end marker lf only names a row.

    The rank of a run's first symbol lies in its block, so nothing moves and nothing is sorted; a batch of blocks is spelled at once.
    """
    below = np.array(smaller(counts), np.int64)

    def spell(batches):
        for batch in batches:
            row, start, c, length, before = held_in(batch.column(1), batch.column(2))
            own = np.stack([batch.column(3 + k).to_numpy() for k in range(SIGMA)])
            position, rank = batch.column(0).to_numpy()[row] + start, own[c, row] + before
            for a in range(0, len(row), SPELLED):
                part = slice(a, a + SPELLED)
                n = length[part]
                j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                symbol, r = np.repeat(c[part], n), np.repeat(rank[part], n) + j
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(position[part], n) + j), pa.array(symbol), pa.array(r), pa.array(below[symbol] + r)], names=["pos", "c", "r", "lf"])

    return blocks.where("sym <> ''").select("start_pos", "sym", "at", *_BEFORE).mapInArrow(spell, "pos long, c int, r long, lf long")


def occurrences(spark: SparkSession, counts: list[int]) -> DataFrame:
    """(i, c): every occurrence of every symbol, by its number from 1, made in as many tasks as the session has."""
    below = np.array(smaller(counts), np.int64)

    def number(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            c = np.searchsorted(below[1:], at, "right")
            yield pa.RecordBatch.from_arrays([pa.array(at + 1 - below[c]), pa.array(c.astype(np.int32))], names=["i", "c"])

    return spark.range(sum(counts)).mapInArrow(number, "i long, c int")


def directory(blocks: DataFrame, counts: list[int]) -> DataFrame:
    """dir(cell, held): for every STRIDE occurrences of a symbol the blocks that hold some of them, held: array<(before, blk)>, sorted; before: occurrences of the symbol before the block.

    The number of a cell is that of its stretch of occurrences, times 8, and the symbol. A cell has STRIDE blocks at most.
    """
    each = F.array(*(F.struct(F.lit(k).alias("c"), F.col(f"n{k}").alias("n"), F.expr(counted("length(sym)", repr(str(k)))).alias("m")) for k in range(SIGMA)))
    rows = blocks.select("blk", F.explode(each).alias("x")).where("x.m > 0")
    first, last = cell("x.n", STRIDE), cell(F.col("x.n") + F.col("x.m") - 1, STRIDE)
    cells = rows.select("x.c", "x.n", "blk", F.explode(F.sequence(first, last)).alias("g")).select((F.col("g") * 8 + F.col("c")).alias("cell"), F.struct(F.col("n").alias("before"), "blk").alias("b"))
    return cells.groupBy("cell").agg(F.array_sort(F.collect_list("b")).alias("held"))


def select(at: DataFrame, directory: DataFrame, blocks: DataFrame, counts: list[int], i: str = "i", c: str = "c", out: str = "pos", size: int = SAMPLE) -> DataFrame:
    """``at`` with the position of the i-th ``c`` (from 1): 0 for i = 0, the size past the last one or for another symbol.

    The directory names the block by an equi-join on the stretch of occurrences, and a second one looks into that block. Both tables stay where they are,
    and questions are dealt out to them, however few Spark takes them for: made by few rows, they would pass through the driver and meet one task.
    """
    total = sum(counts)
    good = F.expr(f"coalesce(`{i}` >= 1 AND `{i}` <= {_one_of(f'`{c}`', counts)}, false)")
    there = at.where(good).select(_question(at), (F.col(i) - 1).cast("long").alias("_z"), F.col(c).alias("_c"))
    there = there.withColumn("cell", cell("_z", STRIDE) * 8 + F.col("_c"))
    place = _halved(STRIDE, "get(held, {} - 1).before <= _z", "size(held)")
    named = directory.join(there.hint("merge"), "cell").select("_q", "_z", "_c", F.expr(f"get(held, {place} - 1).blk").alias("blk"))
    found = _tidy(_told(named.withColumnRenamed("_z", "_i"), blocks, _place_of, "_v long"), at, F.col("_v").alias(out))
    return found.unionByName(at.where(~good).select("*", F.when(F.col(i) <= 0, 0).otherwise(total).cast("long").alias(out)))


def lf(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str = "i", c: str = "c", out: str = "lf", size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at`` with the position that ``c`` before position ``pos`` maps to: the symbols smaller than c, and c's rank."""
    ranked = rank(at, blocks, counts, pos, c, "_rank", size, few)
    return ranked.withColumn(out, F.expr(f"{_one_of(f'`{c}`', smaller(counts))} + _rank")).drop("_rank")


def lf_all(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str = "i", size: int = SAMPLE) -> DataFrame:
    """``at`` with lf1 to lf5: the mappings of all symbols but the end marker."""
    found = ranks(at, blocks, counts, pos, size)
    return found.select(*at.columns, *((F.col(f"r{k}") + smaller(counts)[k]).alias(f"lf{k}") for k in range(1, SIGMA)))


def step_back(at: DataFrame, blocks: DataFrame, counts: list[int], pos: str = "pos", size: int = SAMPLE, few: bool = False) -> DataFrame:
    """``at`` with ``c``, the symbol before the suffix at each position, and ``pos`` of the suffix that begins with it (unchanged where c is the end marker)."""
    names = [n for n in at.columns if n not in ("c", "r")]
    found = inverse_select(at.select(*names), blocks, counts, pos, size, few)
    return found.select(*(n for n in names if n != pos), "c", F.expr(f"if(c > 0, {_one_of('c', smaller(counts))} + r, `{pos}`)").alias(pos))


def psi(lf_edges: DataFrame) -> DataFrame:
    """(pos, psi): the inverse of lf, for suffixes that do not begin with an end marker."""
    return lf_edges.where("c > 0").select(F.col("lf").alias("pos"), F.col("pos").alias("psi"))


def cumulative(values: DataFrame, i: str = "i", v: str = "v") -> DataFrame:
    """(i, v, sum): a cumulative array of non-negative numbers; ``sum``: all values before i."""
    from ..plans.order import running

    return running(values.select(i, v), i, {"sum": F.col(v)})


def cumulative_inverse(at: DataFrame, array: DataFrame, pos: str = "k", block: int = 1 << 10) -> DataFrame:
    """``at`` with ``i`` of the element whose span [sum, sum + v) holds each ``pos``, and is_last: whether it is the span's last place.

    Spans are dealt out to the blocks of places that they cover, so the range lookup is an equi-join on blocks.
    """
    spans = array.where("v > 0").select("i", "sum", (F.col("sum") + F.col("v")).alias("stop"))
    cells = spans.withColumn("_b", F.explode(F.sequence(cell("sum", block), cell(F.col("stop") - 1, block))))
    asked = at.withColumn("_b", cell(pos, block))
    inside = (asked["_b"] == cells["_b"]) & (asked[pos] >= cells["sum"]) & (asked[pos] < cells["stop"])
    return asked.join(cells, inside).select(*at.columns, "i", (F.col(pos) == F.col("stop") - 1).alias("is_last"))
