"""Pattern search: suffix ranges and occurrence counts for whole tables of patterns.

patterns(pattern_id, pattern): characters as users write them. Unknown characters mean
N, and $ anchors a pattern at either end of a text; what stands left of a $
inside a pattern has no meaning.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import SIGMA, encode_pattern
from ..plans.order import spread
from ..plans.shared import materialize, materialize_counted
from . import lookups
from .runs import SAMPLE

def read_patterns(spark, path: str) -> DataFrame:
    """One pattern a line, empty lines and carriage returns left out; a missing file is an error. Ids are places in the file's order of lines."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("pattern"), F.monotonically_increasing_id().alias("pattern_id"))
    return lines.where("pattern <> ''").select("pattern_id", "pattern")


def reverse_tree(strings: DataFrame) -> DataFrame:
    """(key, p, n, parts, origin) of distinct strings(p) of n symbols: strings that end alike share that end.

    Read from the right, a string leaves the one with the number ``origin`` after ``parts`` symbols (null and 0 where it shares nothing), so all its ends of
    up to ``parts`` symbols are ends of that one. Strings are dealt out and sorted from the right; those of different tasks share nothing, which costs lookups only.
    """
    ordered = strings.select("p", F.reverse("p").alias("back")).repartitionByRange("back").sortWithinPartitions("back").select("p", "back", F.monotonically_increasing_id().alias("key"))

    def walk(batches):
        before, path = "", []  # the string before, and whose its ends are: (from how many symbols on, key)
        for batch in batches:
            parts, origins = [], []
            for back, key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = len(commonprefix((before, back)))
                while path and path[-1][0] >= n:
                    path.pop()
                parts.append(n)
                origins.append(path[-1][1] if path and n else None)
                path.append((n, key))
                before = back
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([len(p) for p in batch.column(0).to_pylist()], pa.int32()), pa.array(parts, pa.int32()), pa.array(origins, pa.int64())], names=["key", "p", "n", "parts", "origin"])

    return materialize(ordered.mapInArrow(walk, "key long, p string, n int, parts int, origin long"), "patterns")


def find(patterns: DataFrame, blocks: DataFrame, counts: list[int], order: str = "default", size: int = SAMPLE) -> DataFrame:
    """``patterns`` with the half-open suffix range [lo, hi) of each, by backward search over all patterns at once.

    Round d takes the d-th symbol from the right of every pattern that is as long, whose range is not empty and that shares those
    d symbols with no pattern before it; the others join in where they part. Patterns that end or occur no more leave. So what is asked is
    a node of the patterns' reverse tree, once, and only questions move: the blocks stay in their buckets. An empty pattern has the whole range;
    null patterns too count as empty. Patterns that do not occur have an empty range (lo = hi).
    """
    named = patterns.select("pattern_id", F.coalesce(encode_pattern(F.col("pattern"), order), F.lit("")).alias("p")).distinct()
    tree = reverse_tree(named.select("p").distinct())
    total, below = sum(counts), lookups.smaller(counts)
    lengths = {r[0] for r in tree.select("n").distinct().collect()}  # numbers up to the longest pattern's
    leaves = {r[0] for r in tree.where("parts > 0").select("parts").distinct().collect()}
    live = tree.where("parts = 0").select("key", "p", "n", F.lit(0).cast("long").alias("lo"), F.lit(total).cast("long").alias("hi"))
    done = [live.where("n = 0").select("p", "lo", "hi")]
    for d in range(1, max(lengths, default=0) + 1):
        asked = live.where(F.col("n") >= d).withColumn("c", F.ascii(F.substr("p", F.col("n") - (d - 1), F.lit(1))) - 48)
        if d == 1:  # the first symbol's range follows from the counts alone
            start = lambda n: F.element_at(F.array(*(F.lit(x).cast("long") for x in n)), F.col("c") + 1)
            mapped = asked.select("key", "p", "n", start(below).alias("lo"), start([b + n for b, n in zip(below, counts)]).alias("hi"))
        else:
            mapped = mapped_ends(asked, blocks, counts, size, size_of_live <= lookups.SENT // 2)
        after, left = materialize_counted(mapped.where("lo < hi"), "search")
        kept = [after]
        if d in leaves:
            joining = tree.where(F.col("parts") == d).select("key", "p", "n", F.col("origin").alias("_origin"))
            whose = after.select(F.col("key").alias("_origin"), "lo", "hi")
            joined, more = materialize_counted(joining.join(F.broadcast(whose) if left <= lookups.SENT else whose, "_origin").select("key", "p", "n", "lo", "hi"), "search")
            kept.append(joined)
            left += more
        if d in lengths:
            done += [part.where(F.col("n") == d).select("p", "lo", "hi") for part in kept]
        live, size_of_live = reduce(DataFrame.unionByName, kept).where(F.col("n") > d), left
        if not left:
            break
    found = named.join(reduce(DataFrame.unionByName, done), "p", "left").select("pattern_id", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi"))
    return patterns.join(found, "pattern_id", "left")


def mapped_ends(asked: DataFrame, blocks: DataFrame, counts: list[int], size: int, few: bool) -> DataFrame:
    """(key, p, n, lo, hi) of asked(key, p, n, lo, hi, c): both ends of each range mapped by c, in one pass by the blocks."""
    ends = asked.select("key", "p", "n", "c", F.explode(F.array("lo", "hi")).alias("end"))
    mapped = lookups.lf(ends, blocks, counts, "end", "c", "to", size, few)
    return mapped.groupBy("key").agg(F.any_value("p").alias("p"), F.any_value("n").alias("n"), F.min("to").alias("lo"), F.max("to").alias("hi"))


def counts(found: DataFrame) -> DataFrame:
    """``found`` with ``matches``: how often each pattern occurs, overlaps included."""
    return found.withColumn("matches", F.col("hi") - F.col("lo"))


def totals(found: DataFrame) -> DataFrame:
    """One row: patterns, found (those that occur), matches."""
    n = F.col("hi") - F.col("lo")
    return found.agg(F.count("*").alias("patterns"), F.count_if(n > 0).alias("found"), F.coalesce(F.sum(n), F.lit(0)).alias("matches"))


#: Symbols of a seed, and bytes of patterns that are sent to all workers at most.
SEED, SENT_BYTES = 16, 32 << 20
#: Symbols that are looked at together; and symbols of a stretch up to which all numbers are counted.
WINDOW, SHORT = 1 << 20, 8


def in_texts(patterns: DataFrame, texts: DataFrame, order: str = "default") -> DataFrame:
    """(pattern_id, matches): the same counts from the texts themselves, of any length, without an index.

    A stretch of up to SEED symbols is a number. Stretches of up to SHORT symbols are counted in the tasks that read the texts, all numbers at once, and a task gives
    a row for each that occurs, so their work does not grow with the patterns and only counts move. Longer ones, and the first SEED symbols of longer patterns,
    meet the patterns by a join on the number, and the rest of a pattern is compared where its seed occurs. Small pattern tables are broadcast after a look at
    their size, others meet in a shuffle. Anchored and empty patterns are left to ``find`` and ``anchored``.
    """
    named = materialize(patterns.select("pattern_id", encode_pattern(F.col("pattern"), order).alias("p")).where("p <> '' AND instr(p, '0') = 0"), "patterns")
    asked = named.select("p").distinct().select("p", F.substr("p", F.lit(1), F.lit(SEED)).alias("seed"))
    sizes = sorted(r[0] for r in asked.select(F.length("seed")).distinct().collect())  # SEED rows at most
    brief = [n for n in sizes if n <= SHORT]
    whole = spread(texts, "seq_id")

    def count(batches):
        sums = {n: np.zeros(SIGMA**n, np.int64) for n in brief}
        for batch in batches:
            for _, symbols, own in _windows(batch.column(0), max(brief)):
                for n in brief:
                    sums[n] += np.bincount(_codes(symbols, n, own, SIGMA), minlength=SIGMA**n)
        for n, held in sums.items():
            found = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([np.base_repr(x, SIGMA).zfill(n) for x in found.tolist()], pa.string()), pa.array(held[found])], names=["p", "m"])

    met = []
    if brief:
        met.append(whole.select("s").mapInArrow(count, "p string, m long"))
    longer = [n for n in sizes if n > SHORT]
    if longer:
        size = named.agg(F.sum(F.length("p") + 64)).first()[0] or 0

        def cut(batches):
            for batch in batches:
                keys = batch.column(0).to_numpy()
                starts = np.cumsum([0, *(len(t) + 1 for t in batch.column(1).to_pylist())])[:-1]
                for at, symbols, own in _windows(batch.column(1), SEED):
                    ends = np.cumsum(np.append(0, symbols == 0))
                    for n in longer:
                        codes = _codes(symbols, n, own, 8)
                        k = np.flatnonzero(ends[n : n + len(codes)] == ends[: len(codes)])  # stretches of one text
                        text = np.searchsorted(starts, at + k, "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(keys[text]), pa.array(at + k - starts[text] + 1), pa.array(codes[k]), pa.array(np.full(len(k), n, np.int32))], names=["seq_id", "k", "code", "n"])

        seeds = asked.where(F.length("seed") > SHORT).select("p", F.conv(F.substr("p", F.lit(1), F.lit(SEED)), 8, 10).cast("long").alias("code"), F.length("seed").alias("n"))
        hits = whole.select("seq_id", "s").mapInArrow(cut, "seq_id long, k long, code long, n int").join(F.broadcast(seeds) if size <= SENT_BYTES else seeds, ["code", "n"])
        met.append(hits.where(F.length("p") <= SEED).select("p", F.lit(1).cast("long").alias("m")))
        if not named.where(F.length("p") > SEED).isEmpty():
            far = hits.where(F.length("p") > SEED).select("seq_id", "k", "p").join(texts.select("seq_id", "s"), "seq_id")
            met.append(far.where(F.substr("s", F.col("k").cast("int"), F.length("p")) == F.col("p")).select("p", F.lit(1).cast("long").alias("m")))
    if not met:
        return named.select("pattern_id", F.lit(0).cast("long").alias("matches"))
    counts = reduce(DataFrame.unionByName, met).groupBy("p").agg(F.sum("m").alias("matches"))
    return named.join(counts, "p", "left").select("pattern_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def _windows(texts: pa.Array, most: int):
    """(at, symbols, own): the texts of a batch, a 0 behind each, in windows that begin every WINDOW symbols and hold ``most`` - 1 more, so that a stretch of up to ``most`` symbols lies whole in the one whose first ``own`` places it begins in."""
    digits = np.frombuffer("".join(f"{t}0" for t in texts.to_pylist()).encode(), np.uint8)
    for at in range(0, len(digits), WINDOW):
        yield at, digits[at : at + WINDOW + most - 1].astype(np.int64) - 48, min(WINDOW, len(digits) - at)


def _codes(symbols: np.ndarray, n: int, own: int, base: int) -> np.ndarray:
    """The stretches of ``n`` symbols that begin at the first ``own`` places, as numbers in ``base``; those that pass the end are left out."""
    codes = np.zeros(max(0, min(len(symbols) - n + 1, own)), np.int64)
    for k in range(n):
        codes = codes * base + symbols[k : k + len(codes)]
    return codes


def anchored(patterns: DataFrame, texts: DataFrame, order: str = "default") -> DataFrame:
    """(pattern_id, ends, starts, equals): texts that end with, start with and equal each pattern; all texts for the empty one."""
    named = patterns.select("pattern_id", F.coalesce(encode_pattern(F.col("pattern"), order), F.lit("")).alias("p"))
    sizes = [r[0] for r in named.select(F.length("p")).distinct().collect()]  # as many rows as there are lengths
    rows = texts.select("s", F.explode(F.array(*(F.lit(n) for n in sorted(sizes)))).alias("n")).where(F.length("s") >= F.col("n")) if sizes else texts.select("s", F.lit(0).alias("n"))
    kinds = F.explode(F.array(F.struct(F.lit("e").alias("kind"), F.substr("s", F.length("s") - F.col("n") + 1).alias("p")), F.struct(F.lit("s").alias("kind"), F.substr("s", F.lit(1), "n").alias("p")), F.struct(F.lit("q").alias("kind"), F.when(F.length("s") == F.col("n"), F.col("s")).alias("p"))))
    met = rows.select(kinds.alias("x")).select("x.*").where("p IS NOT NULL").groupBy("p").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("e", "ends"), ("s", "starts"), ("q", "equals"))))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return named.join(met, "p", "left").select("pattern_id", zero("ends"), zero("starts"), zero("equals"))
