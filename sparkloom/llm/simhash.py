"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification and groups of linked fingerprints.

A fingerprint of 64 bits is cut into blocks; two fingerprints that differ in
few bits agree in so many blocks that some combination of blocks is the same
for both. Distinct fingerprints meet on these combinations, are verified, and
each meeting place keeps only a spanning forest of its links, so a dense group
never yields all its pairs. Linked fingerprints then form components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, forget, join_heavy, materialize

#: Fingerprints of one meeting place that a task compares at a time; a larger place is dealt out as pairs of such tiles.
TILE = 1024


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, or of all words where there are fewer."""
    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set; zero for none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, name: str = "fingerprint") -> DataFrame:
    """``df`` with the SimHash of each whole text as a long, in place of any column of that name.

    Null and empty texts, and texts of white space, have fingerprint zero.
    """

    def make():
        def work(batch):
            texts = batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(shingle_hashes(t or b"", width)) for t in texts], np.uint64)
            return [pa.array(found.view(np.int64))]

        return work

    return append_columns(df, T.StructType([T.StructField(name, T.LongType(), False)]), make, text)


def block_keys(value, bits: int, blocks: int):
    """One key for each combination of ``blocks - bits`` blocks: fingerprints within ``bits`` bits share one at least."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*(F.struct(F.lit(k).alias("part"), value.bitwiseAND(F.lit(signed(sum(masks[i] for i in chosen)))).alias("value")) for k, chosen in enumerate(combinations(range(blocks), blocks - bits))))


def links(distinct: DataFrame, name: str, bits: int = 3, blocks: int = 6, tile: int = TILE) -> DataFrame:
    """(a, b): links between fingerprints that differ in at most ``bits`` bits, enough to reach whatever all links reach.

    ``distinct`` holds each fingerprint once. Every two fingerprints that share
    a key are compared; of the links inside a tile a spanning forest is kept.
    """
    keyed = distinct.select(F.col(name).alias("f"), F.explode(block_keys(F.col(name), bits, blocks)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    met = keyed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("f"), tiles).cast("int"))
    dealt = met.select("key", "f", F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))).alias("cell"))
    place = dealt.select(F.xxhash64("key", "cell").alias("place"), "f").repartition("place").sortWithinPartitions("place", "f")

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            places, values = (np.concatenate(c) for c in zip(*kept))
            done = np.searchsorted(places, places[-1]) if len(places) else 0
            yield from _forests(places[:done], values[:done], bits)
            kept = [(places[done:], values[done:])]
        if kept:
            yield from _forests(*kept[0], bits)

    return place.mapInArrow(run, "a long, b long").distinct()


def _forests(places: np.ndarray, values: np.ndarray, bits: int):
    """Spanning forests of the links within each place; places: sorted."""
    if not len(places):
        return
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1, [len(places)]))
    sizes = np.diff(cuts)
    pairs = cuts[:-1][sizes == 2]
    near = np.bitwise_count((values[pairs] ^ values[pairs + 1]).view(np.uint64)) <= bits
    a, b = [values[pairs][near]], [values[pairs + 1][near]]
    for k in np.flatnonzero(sizes > 2):
        group = np.unique(values[cuts[k] : cuts[k + 1]])
        for x, y in _forest(group, bits):
            a.append(x), b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _forest(group: np.ndarray, bits: int):
    """Breadth first: each value not yet reached is linked to one that is."""
    left = group
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            near = np.bitwise_count((left[:, None] ^ edge[None, :256]).view(np.uint64)) <= bits
            hit = near.any(axis=1)
            if hit.any():
                yield edge[:256][near[hit].argmax(axis=1)], left[hit]
            edge, left = np.concatenate((edge[256:], left[hit])), left[~hit]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: long) reaches, for nodes that are not their own root.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until the edges no longer change; every round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node != root").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).withColumn("m", F.least("node", "m"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(least.select("node", F.col("m").alias("root"))).where("node != root").distinct()
        after = materialize(small, "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if mark == seen:
            return now
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", bits: int = 3, width: int = 3, blocks: int = 6) -> DataFrame:
    """(id, fingerprint long, component_id): every row of ``df`` and the smallest id that its fingerprint's links reach.

    Rows whose fingerprints are equal are linked, texts without words too (fingerprint
    zero). Copies and texts without words may be many: a fingerprint that many rows have is not shuffled.
    Null ids are never the smallest; a component of null ids alone has component_id null. The id may be of any type that has an order. Repeated rows stay repeated. Columns other than the id
    are dropped, so clashing names cannot occur. An empty table gives none.
    """
    marks = materialize(fingerprints(df.select(F.col(id_column), F.col(text)), text, width, "fingerprint").select(F.col(id_column).alias(id_column), "fingerprint"), "fingerprints")
    distinct = materialize(marks.groupBy("fingerprint").agg(F.min(id_column).alias("least_id"), F.count("*").alias("n")), "distinct")
    root = components(links(distinct.select("fingerprint"), "fingerprint", bits, blocks))
    rooted = distinct.join(root.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(rooted.join(smallest, "root").select("fingerprint", "component_id", "n"), "named")
    return join_heavy(marks, named, "fingerprint", "n").select(id_column, "fingerprint", "component_id")
