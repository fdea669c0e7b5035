"""The six-letter alphabet: characters as comp values 0 to 5, and what follows from their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The characters of comp values 0 to 5 in each order.
ORDERS = {"default": "$ACGTN", "sorted": "$ACGNT"}
SIGMA = 6
SCHEMA = "comp int, ch string, cnt long, c_before long"


def encode(text: Column, order: str = "default") -> Column:
    """Characters to digits 1 to 5: ACGT in either case, all others (a literal $ too) as N. Digits sort as comp values do."""
    letters = ORDERS[order]
    digits = "".join(str(letters.index(c)) for c in "ACGTACGT")
    return F.translate(F.regexp_replace(text, "[^ACGTacgt]", str(letters.index("N"))), "ACGTacgt", digits)


def encode_pattern(text: Column, order: str = "default") -> Column:
    """As ``encode``, but $ and NUL stay the end marker, digit 0, so that a pattern may be anchored."""
    letters = ORDERS[order]
    digits = "".join(str(letters.index(c)) for c in "ACGTACGT")
    return F.translate(F.regexp_replace(text, r"[^ACGTacgt$\x00]", str(letters.index("N"))), "ACGTacgt$\0", digits + "00")


def decode(digits: Column, order: str = "default") -> Column:
    """Digits 0 to 5 to characters."""
    return F.translate(digits, "012345", ORDERS[order])


def prose_as_bases(text: Column) -> Column:
    """Prose as a test collection: each letter a-z stands for one of four bases, all else for N."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", "5"), "abcdefghijklmnopqrstuvwxyz", "12234233123134241123414321")


def of_counts(counts: DataFrame, order: str = "default") -> DataFrame:
    """alphabet(comp, ch, cnt, c_before) of (comp, cnt) rows, with all six comp values; c_before: how many symbols are smaller."""
    spark = counts.sparkSession
    every = spark.range(0, SIGMA, 1, 1).select(F.col("id").cast("int").alias("comp"), F.substr(F.lit(ORDERS[order]), F.col("id").cast("int") + 1, F.lit(1)).alias("ch"))
    full = every.join(F.broadcast(counts.groupBy("comp").agg(F.sum("cnt").alias("cnt"))), "comp", "left")  # six rows
    cnt = F.coalesce("cnt", F.lit(0)).cast("long")
    before = F.coalesce(F.sum(cnt).over(W.orderBy("comp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return full.select("comp", "ch", cnt.alias("cnt"), before.alias("c_before"))


def of_bwt(bwt: DataFrame, order: str = "default") -> DataFrame:
    """The alphabet of bwt(pos, c)."""
    return of_counts(bwt.groupBy(F.col("c").alias("comp")).agg(F.count("*").alias("cnt")), order)


def of_texts(texts: DataFrame, order: str = "default") -> DataFrame:
    """The alphabet of the transform of texts(s), without making it: its symbols are those of the texts, and an end marker for each."""
    held = [F.count("*").alias("n0"), *(F.sum(F.length("s") - F.length(F.replace("s", F.lit(str(k)), F.lit("")))).alias(f"n{k}") for k in range(1, SIGMA))]
    each = F.array(*(F.struct(F.lit(k).alias("comp"), F.col(f"n{k}").cast("long").alias("cnt")) for k in range(SIGMA)))
    return of_counts(texts.agg(*held).select(F.explode(each).alias("x")).select("x.*"), order)


def merged(*alphabets: DataFrame) -> DataFrame:
    """The alphabet of merged collections: counts add up. Their characters must be the same."""
    names = [identify(a) for a in alphabets]
    if len(set(names)) != 1:
        raise ValueError(f"alphabets differ: {', '.join(names)}")
    every = alphabets[0]
    for a in alphabets[1:]:
        every = every.unionByName(a)
    return of_counts(every.select("comp", "cnt"), names[0])


def identity(counts: DataFrame) -> DataFrame:
    """The alphabet of (comp, cnt) rows whose characters are the comp values themselves."""
    return of_counts(counts).withColumn("ch", F.col("comp").cast("string"))


def identify(alphabet: DataFrame) -> str:
    """The name of an alphabet's order; ``unknown`` if it is neither. Counts do not matter."""
    letters = "".join(r["ch"] for r in sorted(alphabet.select("comp", "ch").collect()))
    return next((name for name, known in ORDERS.items() if known == letters), "unknown")


def compatible(alphabet: DataFrame, order: str) -> bool:
    """Whether an alphabet can be written in a format of that order; ``any`` takes all, and an alphabet or order that is not known fits no other."""
    return order == "any" or order in ORDERS and identify(alphabet) == order


def is_sorted(alphabet: DataFrame) -> bool:
    """Whether the characters ascend with their comp values."""
    letters = [r["ch"] for r in sorted(alphabet.select("comp", "ch").collect())]
    return letters == sorted(letters)


def has_char(alphabet: DataFrame) -> DataFrame:
    """(comp, present)."""
    return alphabet.select("comp", (F.col("cnt") > 0).alias("present"))


def char_ranges(alphabet: DataFrame) -> DataFrame:
    """(comp, lo, hi): the half-open range of suffixes that begin with each comp value."""
    return alphabet.select("comp", F.col("c_before").alias("lo"), (F.col("c_before") + F.col("cnt")).alias("hi"))


def find_char(at: DataFrame, alphabet: DataFrame) -> DataFrame:
    """``at``(pos) with the first character ``comp`` of the suffix at each position; positions outside have none and drop out."""
    a = F.broadcast(alphabet.select("comp", "cnt", "c_before"))  # six rows
    return at.join(a, (F.col("pos") >= F.col("c_before")) & (F.col("pos") < F.col("c_before") + F.col("cnt"))).drop("cnt", "c_before")
