"""Merging transforms of collections, in the order in which the collections are given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import SIGMA
from ..plans.order import cell, positions, running
from ..plans.shared import laid_out, materialize, materialize_counted
from . import lookups, search, transform
from .runs import start_of


def together(collections: list[DataFrame]) -> DataFrame:
    """texts(coll, seq_id, s) of several collections; coll: the collection's number. Texts of earlier ones come first."""
    return reduce(DataFrame.unionByName, (t.select(F.lit(k).alias("coll"), "seq_id", "s") for k, t in enumerate(collections)))


def build(texts: DataFrame) -> DataFrame:
    """bwt(pos, c, coll, seq_id, off) of texts(coll, seq_id, s): all suffixes are sorted once, however many collections there are."""
    return positions(transform.suffixes(texts), [*transform.SUFFIX_ORDER, "coll", "seq_id"], ["c", "coll", "seq_id", "off"]).select("pos", "c", "coll", "seq_id", "off")


def merge(*collections: DataFrame) -> DataFrame:
    """The transform of all texts of the collections, those of the first one first."""
    return build(together(list(collections)))


def merge_indexes(indexes: list):
    """The index of all collections of indexes without texts, those of the first one first. Nothing is inverted or sorted again.

    One traversal of all indexes together says where the symbols of each go, however many there are.
    """
    from .index import Index

    spans = materialize(spans_of_indexes(indexes), "spans")
    parts = [spans.where(F.col("coll") == k).select("lo", "hi", "to") for k in range(len(indexes))]
    moved = [placed(index, part) for index, part in zip(indexes, parts)]
    return Index.of_pieces(reduce(DataFrame.unionByName, moved), indexes[0].order, indexes[0].block_size)


def spans_of_indexes(indexes: list) -> DataFrame:
    """(coll, lo, hi, to): positions [lo, hi) of index ``coll`` go to ``to`` and on in the merged transform.

    All suffixes of all indexes are spelled right to left, level by level; a suffix is its range in each index. Before the rows of a suffix come
    the rows before its range in every index, and those of it in the indexes before. Rounds: one more than the longest
    text. The blocks of all indexes are laid out together once, so a round asks them all in one join that does not move
    them, and maps each suffix by every symbol; suffixes that no index has drop out.
    """
    spark, every, n = indexes[0].blocks.sparkSession, range(len(indexes)), len(indexes)
    size = indexes[0].block_size
    if any(index.block_size != size for index in indexes):
        raise ValueError("the indexes' blocks differ in size")
    together = laid_out(reduce(DataFrame.unionByName, (x.blocks.withColumn("blk", F.col("blk") * n + i) for i, x in enumerate(indexes))), "blk", "together")
    level = spark.createDataFrame([tuple(x for index in indexes for x in (0, index.sequences))], ", ".join(f"lo{i} long, hi{i} long" for i in every))
    level, count = materialize_counted(level.withColumn("id", F.monotonically_increasing_id()), "level")
    below, levels = [lookups.smaller(index.counts) for index in indexes], []
    while count:
        levels.append(level)
        ends = F.array(*(F.struct(F.lit(i).alias("coll"), F.lit(e).alias("end"), F.col(f"{e}{i}").alias("pos"), F.lit(index.bases).cast("long").alias("total")) for i, index in enumerate(indexes) for e in ("lo", "hi") if index.bases))
        asked = level.select("id", F.explode(ends).alias("x")).select("id", "x.*")
        found = lookups.ranks_together(asked, together, n, size, 2 * n * count <= lookups.SENT)
        values = [F.any_value(F.when((F.col("coll") == i) & (F.col("end") == e), F.array(*(F.col(f"r{k}") for k in range(1, SIGMA)))), ignoreNulls=True).alias(f"{e}{i}") for i in every for e in ("lo", "hi")]
        at = lambda i, e, k: F.coalesce(F.get(f"{e}{i}", F.lit(k - 1)), F.lit(0)) + below[i][k]
        steps = F.array(*(F.struct(*(at(i, e, k).alias(f"{e}{i}") for i in every for e in ("lo", "hi"))) for k in range(1, SIGMA)))
        any_left = reduce(lambda x, y: x | y, (F.col(f"lo{i}") < F.col(f"hi{i}") for i in every))
        following = found.groupBy("id").agg(*values).select(F.explode(steps).alias("x")).select("x.*").where(any_left)
        level, count = materialize_counted(following.withColumn("id", F.monotonically_increasing_id()), "level")
    before = reduce(lambda x, y: x + y, (F.col(f"lo{i}") for i in every))
    rows, ahead = [], before
    for i in every:
        rows.append(F.struct(F.lit(i).alias("coll"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), ahead.alias("to")))
        ahead = ahead + F.col(f"hi{i}") - F.col(f"lo{i}")
    whole = reduce(DataFrame.unionByName, levels) if levels else level
    return whole.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("lo < hi")


def placed(index, spans: DataFrame) -> DataFrame:
    """(start, c, len): the runs of an index, cut at the bounds of spans(lo, hi, to) and moved there. Spans are dealt out to the blocks that they cover; the blocks stay."""
    size = index.block_size
    cells = spans.withColumn("blk", F.explode(F.sequence(cell("lo", size), cell(F.col("hi") - 1, size))))
    met = index.blocks.select("blk", "start_pos", "sym", "at").join(cells, "blk")
    low, high = F.greatest(F.col("lo") - F.col("start_pos"), F.lit(0)), F.col("hi") - F.col("start_pos")
    each = F.transform(F.sequence(F.lit(1), F.length("sym")), lambda j: F.struct(F.greatest(start_of(F.get("at", j - 1)), low).alias("a"), F.least(start_of(F.get("at", j)), high).alias("b"), (F.ascii(F.substr("sym", j, F.lit(1))) - 48).alias("c")))
    kept = met.select("start_pos", "lo", "to", F.explode(F.filter(each, lambda x: x["a"] < x["b"])).alias("x"))
    return kept.select((F.col("to") + F.col("start_pos") + F.col("x.a") - F.col("lo")).alias("start"), "x.c", (F.col("x.b") - F.col("x.a")).cast("long").alias("len"))


def sources(merged: DataFrame, coll: int = 1) -> DataFrame:
    """(pos, from_coll): one bit for each merged position, set where the suffix is of collection ``coll`` or a later one."""
    return merged.select("pos", (F.col("coll") >= coll).cast("int").alias("from_coll"))


def rank_array(merged: DataFrame, coll: int = 1) -> DataFrame:
    """ra(b_pos, a_rank): for each suffix of collection ``coll`` and later ones, how many of the earlier collections are smaller or equal."""
    bits = running(merged.select("pos", (F.col("coll") >= coll).alias("is_b")), "pos", {"b_pos": F.col("is_b").cast("int")})
    return bits.where("is_b").select("b_pos", (F.col("pos") - F.col("b_pos")).alias("a_rank"))


def rank_runs(ra: DataFrame) -> DataFrame:
    """ra_runs(a_rank, len)."""
    return ra.groupBy("a_rank").agg(F.count("*").alias("len"))


def merge_rank_runs(*parts: DataFrame) -> DataFrame:
    """One list of runs from several: lengths of equal ranks add up."""
    return reduce(DataFrame.unionByName, parts).groupBy("a_rank").agg(F.sum("len").alias("len"))


def interleave(a: DataFrame, b: DataFrame, ra: DataFrame) -> DataFrame:
    """bwt(pos, c) of bwt(pos, c) tables and their rank array: symbol i of b goes behind its a_rank symbols of a, those of a fill the rest."""
    ahead = rank_runs(ra)
    counted = a.select(F.col("pos").alias("a_pos"), "c").join(ahead.withColumnRenamed("a_rank", "a_pos"), "a_pos", "left")
    before = running(counted, "a_pos", {"b_before": F.coalesce("len", F.lit(0))})
    from_a = before.select((F.col("a_pos") + F.col("b_before") + F.coalesce("len", F.lit(0))).alias("pos"), "c")
    from_b = b.select(F.col("pos").alias("b_pos"), "c").join(ra, "b_pos").select((F.col("b_pos") + F.col("a_rank")).alias("pos"), "c")
    return from_a.unionByName(from_b)


def rank_array_of_indexes(a, b) -> DataFrame:
    """ra(b_pos, a_rank) of two indexes without texts: for each suffix of b, how many of a are smaller or equal, from the traversal of both."""
    spans = spans_of_indexes([a, b]).where("coll = 1")  # such a span goes behind as many of a as it moves by
    return spans.select((F.col("to") - F.col("lo")).alias("a_rank"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("b_pos")).select("b_pos", "a_rank")


def verify(patterns: DataFrame, parts: list, whole) -> DataFrame:
    """(pattern_id, in_parts, in_whole, same): whether counts in the inputs add up to the count in the merged index."""
    named = patterns.select("pattern_id", "pattern")
    every = reduce(DataFrame.unionByName, (search.counts(p.find(named)).select("pattern_id", "matches") for p in parts))
    summed = every.groupBy("pattern_id").agg(F.sum("matches").alias("in_parts"))
    own = search.counts(whole.find(named)).select("pattern_id", F.col("matches").alias("in_whole"))
    return summed.join(own, "pattern_id").withColumn("same", F.col("in_parts") == F.col("in_whole"))
