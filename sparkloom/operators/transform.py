"""Text collections and their Burrows-Wheeler transforms.

texts(seq_id, s): s holds comp digits 1 to 5; the order of seq_id is the order
of the collection. bwt(pos, c, seq_id, off): c precedes the suffix at off of
the text, in the order of all suffixes; a shorter suffix sorts before those it
begins, and equal suffixes sort by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import encode
from ..plans.order import BLOCK, positions, spread
from ..plans.shared import forget, laid_out, materialize, materialize_counted
from .spelled import HEAD, _heads, _layouts

#: Characters of a read: longer texts are cut into reads of this length, none of their characters is left out.
READ = 101


def texts_of(df: DataFrame, seq_id: Column, text: Column, order: str = "default") -> DataFrame:
    """texts(seq_id, s) of a table; null texts are empty."""
    return df.select(seq_id.cast("long").alias("seq_id"), encode(F.coalesce(text, F.lit("")), order).alias("s"))


#: Reads of a stretch: long texts are cut into stretches first, as places deep in a string are slow to reach.
STRETCH = 96


def reads_of(texts: DataFrame, length: int = READ) -> DataFrame:
    """Texts cut into reads, in order: read k of text i has seq_id i * 2**20 + k. An empty text is one empty read; a text of more reads is an error."""
    others = [c for c in texts.columns if c not in ("s", "seq_id")]
    parts = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil(F.length("s") / n).cast("int") - 1, F.lit(0)))
    far = texts.select(*others, "seq_id", "s", F.explode(parts(length * STRETCH)).alias("j")).select(*others, "seq_id", "j", F.substr("s", F.col("j") * (length * STRETCH) + 1, F.lit(length * STRETCH)).alias("s"))
    near = far.select(*others, "seq_id", "j", "s", F.explode(parts(length)).alias("i"))
    k = F.col("j") * STRETCH + F.col("i")
    number = F.when(k < 1 << 20, k).otherwise(F.raise_error(F.lit("a text of more than 2**20 reads")))
    return near.select(*others, (F.col("seq_id") * (1 << 20) + number).alias("seq_id"), F.substr("s", F.col("i") * length + 1, F.lit(length)).alias("s"))


#: Symbols of a suffix that one long holds, as decimal digits.
PACKED = 18
#: What orders suffixes: a number of PACKED symbols, and the rest of those that are longer, two symbols a byte.
SUFFIX_ORDER = ["head", "rest"]


def suffixes(texts: DataFrame) -> DataFrame:
    """(seq_id, off, head, rest, c) and other columns of ``texts``: every suffix, the empty one too, and the digit before it (0 at the start).

    Its first 18 symbols are a number, so sorting mostly compares longs and moves 8 bytes for them; the rest are half bytes. A shorter suffix has zeros
    there, which no symbol is, and so comes first. Made for reads: what is spelled grows with the square of a text's length.
    """
    others = [c for c in texts.columns if c != "s"]
    cut = spread(texts, "seq_id").select(*others, "s", F.concat("s", F.lit("0" * PACKED)).alias("padded"), F.explode(F.sequence(F.lit(0), F.length("s"))).alias("off"))
    before = F.when(F.col("off") == 0, 0).otherwise(F.ascii(F.substr("s", F.col("off"), F.lit(1))) - 48)
    head = F.substr("padded", F.col("off") + 1, F.lit(PACKED)).cast("long").alias("head")
    far = F.length("s") - F.col("off") - PACKED  # symbols beyond the head; with one zero where they are odd
    rest = F.unhex(F.substr("padded", F.col("off") + 1 + PACKED, F.greatest(far + far % 2, F.lit(0)))).alias("rest")
    return cut.select(*others, F.col("off").cast("long").alias("off"), head, rest, before.alias("c"))


def build(texts: DataFrame) -> DataFrame:
    """The transform of a collection with its lineage: bwt(pos, c, seq_id, off)."""
    return positions(suffixes(texts), [*SUFFIX_ORDER, "seq_id"], ["c", "seq_id", "off"]).select("pos", "c", "seq_id", "off")


def build_long(texts: DataFrame) -> DataFrame:
    """As ``build`` for texts of any length, by prefix doubling from the first HEAD symbols on, which are sorted as one number.

    Only suffixes that agree with another in their first h symbols go on: each asks for the rank of the one h symbols further on, and h doubles. Suffixes
    that end in these symbols are told apart by their texts. Ranks lie in buckets of their suffixes, so a round moves what is still tied, and nothing
    but a row a task passes through the driver: the joins sort, as tables that are small in files are not small in memory.
    """
    held = materialize(texts.select(F.lit(0).cast("long").alias("coll"), "seq_id", "s"), "texts", "zstd")
    first = ranked(held.mapInArrow(_headed, "g long, a long, b long, seq_id long, off long, left long, c int"))
    forget(held)
    state, n = materialize_counted(first.where("tied"), "tied")
    base, h = laid_out(first.select("seq_id", F.col("off").alias("to"), F.col("r").alias("base")), ["seq_id", "to"], "ranks") if n else None, HEAD
    while n:
        live = state.where("tied")
        far = live.where(F.col("left") >= h).withColumn("to", F.col("off") + h)
        newer = state.select("seq_id", F.col("off").alias("to"), F.col("r").alias("newer"))  # what the rounds before told of those that were tied at first
        met = base.join(far.hint("merge"), ["seq_id", "to"]).join(newer.hint("merge"), ["seq_id", "to"], "left").withColumn("a", F.coalesce("newer", "base"))
        asked = met.drop("base", "newer").unionByName(live.where(F.col("left") < h).withColumn("a", F.col("seq_id")), allowMissingColumns=True)
        found = ranked(asked.select(F.col("r").alias("g"), "a", F.lit(0).cast("long").alias("b"), "seq_id", "off", "left", "c"))
        after = materialize(found.unionByName(state.where("NOT tied")), "tied")
        n, state, h = after.where("tied").count(), after, 2 * h
    return first.where("NOT tied").unionByName(state).select(F.col("r").alias("pos"), "c", "seq_id", "off")


def _headed(batches):
    """Every suffix of texts by its first HEAD symbols, and by its text where it ends in them."""
    for _, seq, digits, left, text in _layouts(batches):
        heads, own = _heads(digits, left), seq[text]
        off = np.arange(len(text)) - np.flatnonzero(np.diff(text, prepend=-1))[text]
        before = np.append(np.uint8(0), digits[:-1]).astype(np.int32)
        tie = np.where(left < HEAD, own, 0)
        for a in range(0, len(text), BLOCK):
            part = slice(a, a + BLOCK)
            columns = [np.zeros(len(off[part]), np.int64), heads[part], tie[part], own[part], off[part], left[part], before[part]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "a", "b", "seq_id", "off", "left", "c"])


def ranked(rows: DataFrame) -> DataFrame:
    """(seq_id, off, left, c, r, tied) of rows(g, a, b, seq_id, off, left, c), g: the rank of a group of equal suffixes. r: the rank in the order of g, a, b, the same for rows that agree in all, which are ``tied``.

    Rows are dealt out by ranges of that order and numbered where they lie, one after another; equal ones are in one range, but none holds them at once.
    A group may begin in ranges before, so each range says, in one row, how its first and its last group begin and end.
    """
    schema = "g long, seq_id long, off long, left long, c int, part int, rel long, tied boolean, first long"
    found = materialize(rows.repartitionByRange("g", "a", "b").sortWithinPartitions("g", "a", "b").mapInArrow(_numbered, schema), "ranked", "zstd")
    carried, run, size = [], None, 0  # the group that the ranges so far end with, and how many rows it has there
    for e in sorted(found.where("first IS NOT NULL").select("part", "first", "g", "rel").collect()):
        carry = size if e["first"] == run else 0
        carried.append((e["part"], e["first"], carry))
        run, size = e["g"], e["rel"] + (carry if e["first"] == e["g"] else 0)
    before = F.broadcast(rows.sparkSession.createDataFrame(carried, "part int, opens long, carry long"))
    rank = F.col("g") + F.col("rel") + F.when(F.col("g") == F.col("opens"), F.col("carry")).otherwise(0)
    return found.where("first IS NULL").join(before, "part").select("seq_id", "off", "left", "c", rank.alias("r"), "tied")


def _numbered(batches):
    """rel: how many rows of a row's group in this range come before those equal to it. The last row, with ``first``: the first group, the last one (g) and how many rows that has."""
    part, names = TaskContext.get().partitionId(), ["g", "seq_id", "off", "left", "c", "part", "rel", "tied", "first"]
    kept, key, first = None, None, None  # the last row so far, of which the next one is not known
    n = group = equal = 0  # rows so far, and where the last group and the last equal rows begin

    def out(table, rel, tied):
        own = [table.column(k) for k in (0, 3, 4, 5, 6)]
        size = table.num_rows
        return pa.RecordBatch.from_arrays([*own, pa.array(np.full(size, part, np.int32)), pa.array(rel), pa.array(tied), pa.nulls(size, pa.int64())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        g, a, b = keys = [batch.column(k).to_numpy() for k in range(3)]
        last = key or (int(g[0]) - 1, 0, 0)
        moved = [np.append(x[0] != y, np.diff(x) != 0) for x, y in zip(keys, last)]
        other = moved[0] | moved[1] | moved[2]
        at = n + np.arange(len(g))
        groups = np.maximum.accumulate(np.where(moved[0], at, group))
        equals = np.maximum.accumulate(np.where(other, at, equal))
        rel = equals - groups
        if kept is not None:
            yield out(kept[0], kept[1], np.array([kept[2] or not other[0]]))
        tied = ~other | np.append(~other[1:], False)
        yield out(batch.slice(0, len(g) - 1), rel[:-1], tied[:-1])
        kept = batch.slice(len(g) - 1), rel[-1:], bool(tied[-1])
        first = int(g[0]) if first is None else first
        n, group, equal, key = n + len(g), int(groups[-1]), int(equals[-1]), (int(g[-1]), int(a[-1]), int(b[-1]))
    if kept is not None:
        yield out(kept[0], kept[1], np.array([kept[2]]))
        none = [pa.nulls(1, pa.int64()) for _ in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), *none, pa.nulls(1, pa.int32()), pa.array([part], pa.int32()), pa.array([n - group]), pa.nulls(1, pa.bool_()), pa.array([first])], names=names)
