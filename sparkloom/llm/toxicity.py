"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of lexicon words, how near second-person pronouns
stand to them, and the rates of capitals, punctuation and obfuscation. One
lexicon is a fixed list; another is learned from labelled rows, as words and word
beginnings whose odds are far higher in toxic texts. Lexicon, trees and
calibration are fitted on a bounded sample of labelled rows; every text is scored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize, packed, slices

#: Labelled rows that the classifier, its lexicon included, is fitted on at most.
MOST_ROWS = 12_000

#: Insults in common use, and pronouns that address a reader in four languages.
INSULTS = frozenset(b"idiot idiots stupid moron morons loser losers scum pathetic worthless disgusting trash clown clowns dumb fool ugly hate kill garbage jerk liar vermin filth filthy imbecile cretin bastard".split())
PRONOUNS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".encode().split())

_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "u"}
_PLAIN = bytes(ord(_LEET[chr(b)]) if b < 128 and chr(b) in _LEET else _WORDS[b] for b in range(256))
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SYMBOLS = b"@$*!#%&"

FEATURES = (
    "words", "insults", "insult_density", "learned", "learned_density", "beginnings", "beginning_density", "top_odds", "odds_density",
    "second_person", "near_person", "capitals", "punctuation", "exclamations", "digits", "symbols", "disguised",
)


def entries(word: bytes) -> tuple[bytes, ...]:
    """What of a word the learned lexicon may hold: the word, and its first four and five bytes where it is longer."""
    return (b"=" + word, *(b"^" + word[:n] for n in (4, 5) if len(word) > n))


def features(text: bytes, learned: dict[bytes, float]) -> list[float]:
    """The features of one whole text; ``learned``: log odds of lexicon entries."""
    words = text.translate(_WORDS).split()
    n, size = max(1, len(words)), max(1, len(text))
    known: dict[bytes, tuple[float, float]] = {}
    insults = whole = begun = 0
    odds, top, marked = 0.0, 0.0, []
    for i, w in enumerate(words):
        found = known.get(w)
        if found is None:
            ways = entries(w)
            found = known[w] = (learned.get(ways[0], 0.0), max((learned.get(x, 0.0) for x in ways[1:]), default=0.0))
        insult = w in INSULTS
        if insult or found[0] or found[1]:
            insults += insult
            whole += found[0] > 0
            begun += found[1] > 0
            best = max(found)
            odds += best
            top = max(top, best)
            marked.append(i)
    persons = [i for i, w in enumerate(words) if w in PRONOUNS]
    near, k = 0, 0
    for i in marked:
        while k < len(persons) and persons[k] < i - 5:
            k += 1
        near += k < len(persons) and persons[k] <= i + 5
    disguised = sum(b"=" + w in learned or w in INSULTS for w in text.translate(_PLAIN).split()) - sum(b"=" + w in learned or w in INSULTS for w in words) if any(c in text for c in b"013457@$!*") else 0
    share = lambda letters: (len(text) - len(text.translate(None, letters))) / size
    return [
        math.log1p(len(words)), float(insults), insults / n, float(whole), whole / n, float(begun), begun / n, top, odds / n,
        len(persons) / n, float(near), share(_CAPITALS), share(_PUNCTUATION), share(b"!"), share(_DIGITS), share(_SYMBOLS), float(max(0, disguised)),
    ]


def learn_lexicon(rows: DataFrame, text: str = "text", label: str = "label", fold: str = "fold") -> dict[int | None, dict[bytes, float]]:
    """Log odds of entries by fold (0, 1: learned from the other fold; None: from both), from labelled rows.

    Every entry of three toxic rows (one in two hundred, if that is more) whose odds are high enough is kept, so their number is bounded by the words of the rows.
    """

    def count(batches):
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                seen = Counter()
                for t, y, f in zip(part.column(text).cast(pa.binary()).to_pylist(), part.column(label).to_pylist(), part.column(fold).to_pylist()):
                    seen.update((e, y, f) for e in {e for w in set((t or b"").translate(_WORDS).split()) for e in entries(w)})
                keys = list(seen)
                yield pa.RecordBatch.from_pydict({"entry": pa.array([k[0] for k in keys], pa.binary()), "label": pa.array([k[1] for k in keys], pa.int32()), "fold": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = rows.select(text, label, fold).mapInArrow(count, "entry binary, label int, fold int, n long")
    sums = [F.sum(F.when((F.col("label") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{y}{f}") for y in (0, 1) for f in (0, 1)]
    totals = {(r["y"], r["f"]): r["n"] for r in rows.groupBy(F.col(label).alias("y"), F.col(fold).alias("f")).agg(F.count("*").alias("n")).collect()}
    by_entry = materialize(counts.groupBy("entry").agg(*sums), "entries")
    out: dict = {}
    for name, used in ((0, (1,)), (1, (0,)), (None, (0, 1))):
        pos, neg = (sum(totals.get((y, f), 0) for f in used) for y in (1, 0))
        plus, minus = (sum((F.col(f"n{y}{f}") for f in used), F.lit(0)) for y in (1, 0))
        odds = F.log((plus + 0.5) / (pos + 1.0)) - F.log((minus + 0.5) / (neg + 1.0))
        kept = by_entry.where((plus >= max(3, 0.005 * pos)) & (odds >= 2.5)).select("entry", odds.alias("odds"))
        out[name] = {bytes(r["entry"]): r["odds"] for r in kept.collect()}
    return out


def with_features(df: DataFrame, lexicons: dict, text: str = "text", name: str = "features", fold: str | None = None) -> DataFrame:
    """``df`` with the features of each whole text (array<double>); with ``fold``, by the lexicon that did not see the row."""
    sent = df.sparkSession.sparkContext.broadcast(lexicons)

    def make():
        def work(batch):
            texts = batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist()
            folds = batch.column(batch.schema.names.index(fold)).to_pylist() if fold else [None] * len(texts)
            return [pa.array([features(t or b"", sent.value[f]) for t, f in zip(texts, folds)], pa.list_(pa.float64()))]

        return work

    return append_columns(df, T.StructType([T.StructField(name, T.ArrayType(T.DoubleType(), True), False)]), make, text)


def score(
    df: DataFrame, labels: DataFrame, usable, id_column: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, most_rows: int = MOST_ROWS, trees: int = 20
) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from ``threshold``), replacing columns of these names.

    ``labels`` has the id and the 0/1 column ``label``; only rows for which the
    Column ``usable`` over the id holds are learned from, at most ``most_rows`` of
    them (those with the smallest hash of the id). Null labels are not used;
    where an id has several, the largest counts; where a labelled id has several texts, the smallest is learned from. Without labelled rows of both kinds, all
    scores are the share of toxic rows among them (0 without any). Null and empty
    texts are scored as empty ones, repeated rows alike. No other column name can clash.
    """
    spark = df.sparkSession
    chosen = (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    )
    known = F.broadcast(materialize(chosen, "labelled"))  # at most most_rows pairs of numbers
    part = F.pmod(F.xxhash64(F.col("_id"), F.lit("part")), F.lit(20)).cast("int")
    matched = df.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(known, "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))
    rows = materialize(matched.select("text", "label", (part % 2).alias("fold"), part.alias("part")), "training")
    lexicons = learn_lexicon(rows)
    trained = materialize(with_features(rows, lexicons, "text", "features", "fold").select("label", "part", "features"), "features")
    count, toxic, fitted = (x or 0 for x in trained.agg(F.count("*"), F.sum("label"), F.sum(F.when(F.col("part") < 14, F.col("label")))).first())
    base = df.drop("score", "predicted")
    if not (0 < toxic < count and fitted):
        share = float(toxic) / count if count else 0.0
        return base.withColumn("score", F.lit(share)).withColumn("predicted", F.lit(int(share >= threshold)))
    ready = trained.select(F.col("label").cast("double").alias("label"), "part", array_to_vector("features").alias("features")).coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.25, minInstancesPerNode=3, seed=7, labelCol="label", featuresCol="features").fit(ready.where("part < 14"))
    likely = vector_to_array("probability")[1]
    held = model.transform(ready.where("part >= 14")).select("label", likely.alias("p"))
    if held.agg(F.count_distinct("label")).first()[0] < 2:
        held = model.transform(ready).select("label", likely.alias("p"))
    curve = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(held)
    rows, back = packed(base, text)
    scored = with_features(rows, {None: lexicons[None]}, "text", "dense").withColumn("features", array_to_vector("dense")).drop("dense")
    marked = curve.transform(model.transform(scored).withColumn("p", likely))
    # a little of the trees' own order breaks the ties of the calibrated steps
    return marked.withColumn("score", 0.999 * F.col("calibrated") + 0.001 * F.col("p")).select(*back, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
