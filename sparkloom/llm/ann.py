"""Approximate nearest neighbours with a hash-prefix forest.

Every tree hashes a vector to a long bit string, one bit for the side of each
random hyperplane, and keeps the strings in a sorted array. The rows are dealt out to shards of
bounded size, and the forest of each shard is grown once and written to the shared folder.

A search has two phases. Queries first descend each tree to their longest matching
prefix, a contiguous range of the array, and ascend all trees together, a bit at a
time, until the ranges hold a few times k candidates. Their exact scores
give a lower bound of the k-th best score of each query over all shards. A row that
beats this bound lies within a known angle of the query, so the chance that it
shares no prefix of a given length with it in any tree is known too. Queries whose
prefixes are too long for that chance ascend once more, all trees
together, to the longest prefix at which it is at most MISS. Only candidates are scored.
So near neighbours end a search deep in the trees, and evenly spread ones high up, without a share or size to set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a shard and queries of a block, on average.
SHARD, BLOCK = 16_384, 4_096
#: Trees, bits of a string, and the chance that all trees miss a row which is just as near as the k-th best known.
TREES, DEPTH, MISS = 96, 24, 0.2
#: Candidates before the first bound, as a multiple of k.
FIRST = 12
_SEED = 11


def usable(vector):
    """Whether an array column takes part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def hash_strings(data: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = _SEED) -> np.ndarray:
    """The bit strings of the rows of a matrix as numbers, one row of the result for each tree."""
    powers = 1 << np.arange(depth - 1, -1, -1, dtype=np.int64)
    rng = np.random.default_rng(seed)
    return np.stack([((data @ rng.standard_normal((data.shape[1], depth))) > 0) @ powers for _ in range(trees)]).astype(np.uint32)


class Forest:
    """Sorted arrays of hash strings: for each tree, the strings in order and the rows that they belong to."""

    def __init__(self, strings: np.ndarray, order: np.ndarray, depth: int = DEPTH):
        self.strings, self.order, self.depth, self.size = strings, order, depth, strings.shape[1]

    @classmethod
    def grow(cls, data: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> "Forest":
        strings = hash_strings(data, trees, depth)
        order = np.argsort(strings, axis=1, kind="stable")
        return cls(np.take_along_axis(strings, order, axis=1), order.astype(np.uint16 if len(data) <= 1 << 16 else np.uint32), depth)

    def ranges(self, asked: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows that share the first ``lengths`` bits with each asked string begin and end in each tree; asked: (trees, queries)."""
        drop = (self.depth - lengths).astype(np.int64)
        first = asked.astype(np.int64) >> drop << drop
        low, high = np.empty(first.shape, np.int64), np.empty(first.shape, np.int64)
        for t, strings in enumerate(self.strings):
            low[t], high[t] = np.searchsorted(strings, first[t]), np.searchsorted(strings, first[t] + (1 << drop))
        return low, high

    def descend(self, asked: np.ndarray, least: int) -> np.ndarray:
        """For each query the longest prefix, the same in all trees, that ``least`` different rows share with it in some tree, or the empty one."""
        lengths = np.zeros(asked.shape[1], np.int64)
        open_ = np.arange(asked.shape[1])
        for bits in range(self.depth, 0, -1):
            low, high = self.ranges(asked[:, open_], np.full(len(open_), bits))
            for place in np.flatnonzero((high - low).sum(axis=0) >= least):
                if np.count_nonzero(self._held(low[:, place], high[:, place])) >= least:
                    lengths[open_[place]] = bits
            open_ = open_[lengths[open_] == 0]
            if not len(open_):
                break
        return lengths

    def _held(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        held = np.zeros(self.size, bool)
        held[np.concatenate([order[a:b] for order, a, b in zip(self.order, low.tolist(), high.tolist())])] = True
        return held

    def candidates(self, asked: np.ndarray, lengths: np.ndarray):
        """For each query, the rows that share a prefix of its length with it in some tree."""
        low, high = self.ranges(asked, lengths)
        for q in range(asked.shape[1]):
            yield np.flatnonzero(self._held(low[:, q], high[:, q])) if lengths[q] else np.arange(self.size)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, ties to smaller ids."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(~(scores < np.partition(scores, len(scores) - k)[len(scores) - k]))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _matrix(column) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(data: DataFrame, shards: int) -> DataFrame:
    """(size, shard, ids, vectors, strings, trees): the forest of every shard of data(id, v, size), as packed arrays."""

    def grow(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"])
        forest = Forest.grow(x.astype(np.float64))
        found = {"size": table["size"][:1], "shard": table["shard"][:1], "ids": [table["id"].combine_chunks().to_numpy().astype(np.int64).tobytes()], "vectors": [x.tobytes()], "strings": [forest.strings.tobytes()], "trees": [forest.order.tobytes()]}
        return pa.table({n: x if n in ("size", "shard") else pa.array(x, pa.binary()) for n, x in found.items()})

    dealt = data.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("size", "shard").applyInArrow(grow, "size int, shard int, ids binary, vectors binary, strings binary, trees binary")


def _visit(shards: DataFrame, n_shards: int, asked: DataFrame, n_asked: int, kind: str, k: int, block: int) -> DataFrame:
    """(query_id, id, score, length): the best k candidates in each shard for asked(id, v, size, length).

    Without a length, a query descends to its own. Every block of queries meets every shard of vectors of its length.
    """
    blocks = max(1, -(-n_asked // block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = shards.withColumn("block", spread(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", spread(n_shards))

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = [], [], [], []
        if len(held) and len(asking):
            row = held.to_pylist()[0]
            ids, size = np.frombuffer(row["ids"], np.int64), row["size"]
            x = np.frombuffer(row["vectors"], kind).reshape(len(ids), size).astype(np.float64)
            forest = Forest(np.frombuffer(row["strings"], np.uint32).reshape(TREES, -1), np.frombuffer(row["trees"], np.uint16 if len(ids) <= 1 << 16 else np.uint32).reshape(TREES, -1))
            q, names = _matrix(asking["v"]).astype(np.float64), asking["id"].combine_chunks().to_numpy()
            strings = hash_strings(q)
            lengths = asking["length"].combine_chunks().fill_null(-1).to_numpy().astype(np.int64)
            new = lengths < 0
            if new.any():
                lengths = lengths.copy()
                lengths[new] = forest.descend(strings[:, new], FIRST * k)
            for j, near in enumerate(forest.candidates(strings, lengths)):
                near = near[ids[near] != names[j]]
                scores = (x[near] * q[j]).sum(axis=1)  # summed alike for every row, so equal vectors tie
                first = best(scores, ids[near], k)
                for to, part in zip(out, (np.full(len(first), names[j]), ids[near[first]], scores[first], np.full(len(first), lengths[j]))):
                    to.append(part)
        kinds = (("query_id", np.int64), ("id", np.int64), ("score", np.float64), ("length", np.int32))
        return pa.table({name: np.concatenate([np.zeros(0, t), *parts]).astype(t) for (name, t), parts in zip(kinds, out)})

    keys = ("size", "shard", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score double, length int")


def longest_safe(bound: Column, lengths: Column, trees: int = TREES, depth: int = DEPTH, miss: float = MISS) -> Column:
    """The longest prefix at which all trees miss a row with an inner product of ``bound`` with a chance of at most ``miss``; ``lengths``: the product of both lengths.

    A hyperplane parts two vectors with a chance of their angle over pi, so a prefix of n bits is shared with (1 - angle / pi) ** n.
    """
    same = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), bound / lengths))) / math.pi
    exact = F.floor(F.lit(math.log(1 - miss ** (1 / trees))) / F.log(same)).cast("int")
    return F.when(same >= 1, depth).when(same <= 0, 0).otherwise(F.least(exact, F.lit(depth)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank from 1, id, score): the ``k`` nearest rows of ``vectors`` that the forest finds for each row of ``queries``.

    Nearness is the inner product in double precision, ties go to the smaller
    id, and a row never answers a query of the same id. Rows without id, or whose
    vector is null, empty, zero or holds null or non-finite components, take no part; repeated ids
    count once (their smallest vector). Vectors meet those of their own length only. Fewer than k rows give them all;
    empty tables give none. Other columns are dropped. Vectors of very unlike
    norms are found too, but with more candidates, as the angle of a bound is that of the longest vector.
    """
    kind = "float" if vectors.schema[vector].dataType.simpleString() == queries.schema[vector].dataType.simpleString() == "array<float>" else "double"

    def clean(df):
        rows = df.select(F.col(id_column).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    data, asked = clean(vectors), materialize(clean(queries).withColumn("norm", norm), "queries")
    count, longest = data.agg(F.count("*"), F.max(norm)).first()
    shards = max(1, -(-count // shard))
    forests = materialize(index(data, shards), "forest")
    numpy_kind = {"float": "<f4", "double": "<f8"}[kind]
    visit = lambda some, n: _visit(forests, shards, some.select("id", "v", "size", "length"), n, numpy_kind, k, block)
    best_first = lambda by: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), by))

    first = materialize(visit(asked.withColumn("length", F.lit(None).cast("int")), asked.count()), "descended")
    top = first.withColumn("rank", best_first("id")).where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound"))
    reached = top.join(first.groupBy("query_id").agg(F.max("length").alias("reached")), "query_id")
    met = asked.join(reached.withColumnRenamed("query_id", "id"), "id", "left")
    length = F.when(F.col("n") == k, longest_safe(F.col("bound"), F.col("norm") * F.lit(longest))).otherwise(0)
    open_ = materialize(met.withColumn("length", F.coalesce(length, F.lit(0))).where(F.col("reached").isNull() | (F.col("length") < F.col("reached"))), "open")
    found = first.unionByName(visit(open_, open_.count())).dropDuplicates(["query_id", "id"])
    return found.withColumn("rank", best_first("id")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
