"""Hard negatives by blocked dense products.

Anchors go out to all workers in blocks of bounded size, and the candidates pass by where they
are: every task multiplies its rows with the block in float64, in which integer products are exact below 2**53. A first
pass keeps, for each anchor, the best rows of its label, a second one the best rows of other
labels inside the window of scores below each positive. What a task keeps is k rows for each anchor or pair, and
such lists merge, so neither pass moves candidates.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices

#: Bytes of the anchors' vectors in a block that is sent out, and rows of both sides of one product.
BLOCK_BYTES, ANCHORS, ROWS = 16 << 20, 1024, 2048


def finite(vector: Column) -> Column:
    """Whether an array column is not null and holds no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Best:
    """The k best (score, id) of each of several rows, highest score first, ties to smaller ids; parts merge in any order."""

    def __init__(self, rows: int, k: int):
        self.k, self.scores, self.ids = k, np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, able: np.ndarray) -> None:
        """Take in a matrix of scores, a line for each of ``rows``, a column for each of ``ids``, where ``able`` holds."""
        worst, last = self.scores[rows, -1][:, None], self.ids[rows, -1][:, None]
        able = able & ((scores > worst) | (scores == worst) & (ids[None, :] < last))
        if not able.any():
            return
        if scores.shape[1] > self.k:  # no row below the k-th best of the matrix itself
            masked = np.where(able, scores, -np.inf)
            able &= masked >= np.partition(masked, scores.shape[1] - self.k, axis=1)[:, [scores.shape[1] - self.k]]
        line, column = np.nonzero(able)
        held = np.unique(line)
        row = np.concatenate((rows[line], np.repeat(rows[held], self.k)))
        score = np.concatenate((scores[line, column], self.scores[rows[held]].ravel()))
        name = np.concatenate((ids[column], self.ids[rows[held]].ravel()))
        order = np.lexsort((name, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.scores[row[kept], place[kept]], self.ids[row[kept], place[kept]] = score[order][kept], name[order][kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        line, place = np.nonzero(self.scores > -np.inf)
        return line, self.ids[line, place], self.scores[line, place]


def _matrices(batch: pa.RecordBatch, scale: int):
    """(ids, labels, matrix) for each length of the vectors in a batch of (id, label, v), components scaled and rounded down."""
    column = batch.column(2)
    sizes = np.diff(column.offsets.to_numpy())
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield ids[own], labels[own], np.floor(scale * flat[(starts[own][:, None] + np.arange(size)).ravel()]).reshape(len(own), size)


def _blocks(anchors: DataFrame, block_bytes: int):
    """The anchors as {length: (ids, labels, vectors)}, at most ``block_bytes`` of vectors at a time (one anchor at least)."""
    held, size = [], 0
    for row in anchors.toLocalIterator():
        if held and size + 8 * len(row["v"]) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["id"], row["label"], row["v"]))
        size += 8 * len(row["v"])
    if held:
        yield held


def _by_length(block: list, scale: int) -> dict:
    out: dict = {}
    for name, label, v in block:
        out.setdefault(len(v), []).append((name, label, v))
    return {n: (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.floor(scale * np.array([r[2] for r in rows], np.float64).reshape(len(rows), n))) for n, rows in out.items()}


def _products(batches, asked: dict, scale: int):
    """(length, anchors' places, their labels, candidates' ids and labels, products) of every block of anchors with every slice of candidates."""
    for batch in batches:
        for part in slices(batch, "v", 1 << 20):
            for ids, labels, x in _matrices(part, scale):
                names, own, q = asked.get(x.shape[1], (np.zeros(0, np.int64),) * 3)
                for c in range(0, len(ids), ROWS):
                    for a in range(0, len(names), ANCHORS):
                        yield x.shape[1], np.arange(a, min(len(names), a + ANCHORS)), own[a : a + ANCHORS], ids[c : c + ROWS], labels[c : c + ROWS], q[a : a + ANCHORS] @ x[c : c + ROWS].T


def _best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Merges what the tasks kept: the k best of each key, with ``rank`` from 1."""
    by = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(
    candidates: DataFrame, anchors: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels with low * positive <= 100 * negative <= high * positive.

    Components become floor(scale * x); scores are integer inner products, exact below 2**53 (beyond, rounded as doubles are). Higher scores come first,
    ties go to smaller ids. Rows without id or label, and rows whose vector is null or holds null or non-finite components, take no part; zero and empty
    vectors do. Vectors meet those of their own length. Repeated candidates count as often as they stand there; of rows that repeat an anchor's id the
    smallest (label, vector) is the anchor, and no row is its own positive. Anchors without positives, and positives without negatives, give no
    rows; empty tables give none. Other columns are not read. An anchor of each block meets every candidate; ``block_bytes`` bounds what is sent at once.
    """
    def clean(df):
        rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("v"))
        return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))

    rows = clean(candidates)
    asked = materialize(clean(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "anchors")
    none = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    parts = [_mine_block(rows, block, positives, negatives, low, high, scale) for block in _blocks(asked, block_bytes)]
    return reduce(DataFrame.unionByName, parts) if parts else none


def _mine_block(rows: DataFrame, block: list, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """Both passes for one block of anchors, of which positives * anchors rows come back between them."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def same_label(batches):
        asked = _by_length(sent.value, scale)
        best = {n: Best(len(x[0]), positives) for n, x in asked.items()}
        for n, place, own, ids, labels, scores in _products(batches, asked, scale):
            best[n].add(place, scores, ids, (own[:, None] == labels[None, :]) & (asked[n][0][place][:, None] != ids[None, :]))
        for n, kept in best.items():
            line, name, score = kept.rows()
            yield pa.RecordBatch.from_arrays([pa.array(asked[n][0][line]), pa.array(name), pa.array(score)], names=["anchor", "id", "score"])

    near = _best_of(rows.mapInArrow(same_label, "anchor long, id long, score double"), ["anchor"], positives)
    found: dict = {}
    for r in near.collect():  # positives rows at most for each anchor of the block
        found.setdefault(r["anchor"], {})[r["rank"] - 1] = (r["id"], r["score"])
    kept = rows.sparkSession.sparkContext.broadcast(found)

    def other_labels(batches):
        asked = _by_length(sent.value, scale)
        best = {n: Best(len(x[0]) * positives, negatives) for n, x in asked.items()}
        tops = {n: np.array([[kept.value.get(a, {}).get(j, (0, np.nan))[1] for j in range(positives)] for a in x[0].tolist()]).reshape(-1, positives) for n, x in asked.items()}
        for n, place, own, ids, labels, scores in _products(batches, asked, scale):
            able = own[:, None] != labels[None, :]
            for j in range(positives):
                top = tops[n][place, j][:, None]  # nan where there is no such positive, which nothing fits
                best[n].add(place * positives + j, scores, ids, able & (100 * scores >= low * top) & (100 * scores <= high * top))
        for n, held in best.items():
            line, name, score = held.rows()
            yield pa.RecordBatch.from_arrays([pa.array(asked[n][0][line // positives]), pa.array(line % positives), pa.array(name), pa.array(score)], names=["anchor", "j", "id", "score"])

    pairs = rows.sparkSession.createDataFrame([(a, j, p, s) for a, own in found.items() for j, (p, s) in own.items()], "anchor long, j long, positive long, positive_score double")
    hard = _best_of(rows.mapInArrow(other_labels, "anchor long, j long, id long, score double"), ["anchor", "j"], negatives)
    met = hard.join(F.broadcast(pairs), ["anchor", "j"])  # bounded by the block
    return met.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))
