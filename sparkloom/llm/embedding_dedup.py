"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the principal directions is learned on a bounded sample so that signs lose as little of
the vectors as possible, which makes short balanced binary codes; several rotations from different beginnings
make longer ones. Codes are cut into substrings, a table each: vectors whose substrings are equal meet there and are
compared with their original components in double precision. As many tables are used as the
sample needs for pairs at the very threshold to meet in one with a chance of 1 - MISS.

Equal vectors are one vertex. A pair that meets in several tables is counted in the first of them, which both codes tell,
so no pairs are emitted: a meeting place sends a count for each of its vertices and a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize
from .hard_negatives import finite
from .simhash import components

#: Distinct vectors that the rotations are learned on: those with the smallest hashes.
SAMPLE = 8192
#: Chance that a pair at the threshold meets in no table, steps of the iteration, and tables at most (random-like data of a few dimensions reach it).
MISS, STEPS, TABLES = 0.01, 25, 256
#: Vertices of a meeting place that a task compares at a time; larger places are dealt out as pairs of such tiles. Groups of at most SMALL are compared side by side.
TILE, SMALL = 4096, 8
#: Crowded places that are sent to all workers at most, a few numbers each; more meet in a shuffle.
SENT = 1 << 18
_SEED = 12


class Codes:
    """Rotations and the substrings of the codes they give: ``of(x)`` has a number for each table."""

    def __init__(self, mean: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int):
        self.mean, self.rotations, self.bits, self.tables = mean, rotations, bits, tables

    def of(self, x: np.ndarray) -> np.ndarray:
        signs = np.concatenate([(x - self.mean) @ r > 0 for r in self.rotations], axis=1)[:, : self.bits * self.tables]
        return (signs.reshape(len(x), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))).astype(self.kind)

    @property
    def kind(self):
        return np.int32 if self.bits < 32 else np.int64


def rotation(y: np.ndarray, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    """The rotation that iterative quantisation reaches from a random one: signs and the best rotation towards them by turns."""
    r = np.linalg.qr(rng.standard_normal((y.shape[1], y.shape[1])))[0]
    for _ in range(steps):
        u, _, v = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
        r = (u @ v).T
    return r


def learn(sample: np.ndarray, count: int, cosine: float, miss: float = MISS, seed: int = _SEED) -> Codes:
    """Codes for ``count`` vectors like the normalised rows of ``sample``.

    Substrings are so long that a table has as many places as there are vectors. Tables are added until of the pairs
    that a random step from each row of the sample to the very threshold makes no more than ``miss`` meet in none.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    axes = np.linalg.qr(np.vstack((axes, rng.standard_normal((max(0, sample.shape[1] - len(axes)), sample.shape[1])))).T)[0]
    step = rng.standard_normal(sample.shape)
    step -= (step * sample).sum(axis=1, keepdims=True) * sample
    near = cosine * sample + np.sqrt(1 - cosine**2) * step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-300)
    bits = min(62, max(4, int(np.ceil(np.log2(max(2, count))))))
    rotations: list[np.ndarray] = []
    unmet, tables, left = np.ones(len(sample), bool), 0, None
    while tables < TABLES:
        rotations.append(axes @ rotation((sample - mean) @ axes, rng))
        same = ((sample - mean) @ rotations[-1] > 0) == ((near - mean) @ rotations[-1] > 0)
        left = same if left is None else np.concatenate((left, same), axis=1)
        while left.shape[1] >= bits and tables < TABLES:
            unmet &= ~left[:, :bits].all(axis=1)
            left, tables = left[:, bits:], tables + 1
            if unmet.mean() <= miss:
                return Codes(mean, rotations, bits, tables)
    return Codes(mean, rotations, bits, tables)


def matrix(rows: list[bytes], size: int, kind: str) -> np.ndarray:
    """Vectors of up to ``size`` components each as a matrix of doubles, shorter ones filled up with zeros."""
    held = [np.frombuffer(r, kind) for r in rows]
    out = np.zeros((len(rows), size))
    for k, r in enumerate(held):
        out[k, : len(r)] = r
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length one; by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Place:
    """Vertices that meet: what of them links, counted once over all tables, and a forest of the links."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, table: int, cosine: float):
        self.x, self.codes, self.table, self.cosine = x, codes, table, cosine

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the rows ``a`` and ``b`` link; scores at the threshold's edge are added up alike in any order of the two."""
        scores = self.x[a] @ self.x[b].T
        out = scores >= self.cosine
        for i, j in np.argwhere(np.abs(scores - self.cosine) < 1e-12):
            out[i, j] = (self.x[a[i]] * self.x[b[j]]).sum() >= self.cosine
        return out

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs meet in no table before this one."""
        out = np.ones((len(a), len(b)), bool)
        for t in range(self.table):
            out &= self.codes[a, t][:, None] != self.codes[b, t][None, :]
        return out

    def counts(self, one: np.ndarray, two: np.ndarray, weight: np.ndarray, step: int = 512) -> np.ndarray:
        """For each vertex the weight of those that it links with, of pairs between ``one`` and ``two`` (or inside, if both are the same)."""
        out, inside = np.zeros(len(weight), np.int64), one is two
        for k in range(0, len(one), step):
            a = one[k : k + step]
            hit = self.near(a, two)
            if hit.any():
                hit &= self.first(a, two)
                if inside:
                    hit[np.arange(len(a)), np.arange(k, k + len(a))] = False
                out[a] += hit @ weight[two]
                if not inside:
                    out[two] += hit.T @ weight[a]
        return out

    def forest(self, group: np.ndarray, step: int = 256):
        """Links that reach what all links reach, breadth first."""
        left = group
        while len(left):
            edge, left = left[:1], left[1:]
            while len(edge) and len(left):
                hit = self.near(left, edge[:step])
                found = hit.any(axis=1)
                if found.any():
                    yield edge[:step][hit[found].argmax(axis=1)], left[found]
                edge, left = np.concatenate((edge[step:], left[found])), left[~found]


def _meet(table: pa.Table, size: int, cosine: float, kind: str, codes_kind):
    """(a, b, n) of sorted (place, part, side, node, n, v, codes): links a-b with n = 0, and counts n of vertex a with b = a."""
    place, part, side, node, n = (table[c].to_numpy() for c in ("place", "part", "side", "node", "n"))
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
    sizes = np.diff(cuts)
    live = np.repeat(sizes > 1, sizes)
    if not live.any():
        return
    place, part, side, node, n = (c[live] for c in (place, part, side, node, n))
    kept = table.filter(pa.array(live))
    x = normalised(matrix(kept["v"].to_pylist(), size, kind))
    codes = np.frombuffer(b"".join(kept["codes"].to_pylist()), codes_kind).reshape(len(node), -1)
    sizes = sizes[sizes > 1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out: list[tuple] = []
    for g in range(2, SMALL + 1):  # all groups of one size side by side
        first = starts[(sizes == g) & (side[starts] == -1)]
        for i in range(g):
            for j in range(i + 1, g):
                a, b = first + i, first + j
                scores = np.einsum("ij,ij->i", x[a], x[b])
                for e in np.flatnonzero(np.abs(scores - cosine) < 1e-12):
                    scores[e] = (x[a[e]] * x[b[e]]).sum()
                hit = scores >= cosine
                a, b = a[hit], b[hit]
                new = ~((codes[a] == codes[b]) & (np.arange(codes.shape[1]) < part[a][:, None])).any(axis=1)
                a, b = a[new], b[new]
                out += [(node[a], node[b], np.zeros(len(a), np.int64)), (node[a], node[a], n[b]), (node[b], node[b], n[a])]
    for s, g in zip(starts.tolist(), sizes.tolist()):
        if g > SMALL or side[s] != -1:
            meet = Place(x, codes, int(part[s]), cosine)
            rows = np.arange(s, s + g)
            own, weight = side[rows], np.zeros(len(node), np.int64)
            weight[rows] = n[rows]
            one, two = (rows, rows) if own[0] == own[-1] else (rows[own == own[0]], rows[own != own[0]])
            found = meet.counts(one, rows if one is rows else two, weight)[rows]
            out.append((node[rows][found > 0], node[rows][found > 0], found[found > 0]))
            for a, b in meet.forest(rows):
                out.append((node[a], node[b], np.zeros(len(a), np.int64)))
    if out:
        a, b, counts = (np.concatenate(c) for c in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(counts)], names=["a", "b", "n"])


def links(vertices: DataFrame, codes: Codes, size: int, cosine: float, kind: str = "<f8", tile: int = TILE) -> DataFrame:
    """(a, b, n) over vertices(node, n, v binary, length): a > b with n = 0 for links, enough to reach whatever all links reach; a = b with the number n of rows that vertex a links with."""
    held, of_codes = vertices.sparkSession.sparkContext.broadcast((codes.mean, codes.rotations, codes.bits, codes.tables)), codes.kind

    def code(batches):
        own = Codes(*held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                found = own.of(normalised(matrix(part.column(part.schema.names.index("v")).to_pylist(), size, kind)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.tolist(), pa.list_(pa.int64())), pa.array([r.tobytes() for r in found], pa.binary())], names=[*part.schema.names, "keys", "codes"])

    coded = materialize(vertices.mapInArrow(code, "node long, n long, v binary, length int, keys array<long>, codes binary"), "coded")
    keyed = coded.select("node", F.col("length"), F.posexplode("keys").alias("part", "key"))
    crowded = materialize(keyed.groupBy("part", "length", "key").agg(F.count("*").alias("crowd")).where(F.col("crowd") > tile), "crowded")
    few = crowded.count() <= SENT
    met = coded.select("node", "n", "v", "length", "codes", F.posexplode("keys").alias("part", "key")).join(F.broadcast(crowded) if few else crowded, ["part", "length", "key"], "left")
    # a crowded place is dealt out: every vertex has a tile of its own and meets each tile once
    tiles = F.coalesce(F.ceil(F.col("crowd") / tile), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = met.select("part", "length", "key", "node", "n", "v", "codes", F.when(tiles > 1, own).otherwise(-1).alias("side"), F.explode(pairs).alias("cell"))
    placed = dealt.select(F.xxhash64("part", "length", "key", "cell").alias("place"), "part", "length", "key", "cell", "side", "node", "n", "v", "codes")
    order = ["place", "part", "length", "key", "cell", "side", "node"]
    ordered = placed.repartition("place").sortWithinPartitions(*order)
    # places are told apart by all their columns, not by the hash alone
    numbered = ordered.select(F.xxhash64("place", "part", "length", "key", "cell", F.lit("place")).alias("place"), "part", "side", "node", "n", "v", "codes")

    def run(batches):
        kept: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*kept, batch])
            places = table["place"].to_numpy()
            done = int(np.flatnonzero(places != places[-1])[-1]) + 1 if (places != places[-1]).any() else 0
            yield from _meet(table.slice(0, done), size, cosine, kind, of_codes)
            kept = table.slice(done).to_batches()
        if kept:
            yield from _meet(pa.Table.from_batches(kept), size, cosine, kind, of_codes)

    return numbered.mapInArrow(run, "a long, b long, n long")


def groups(df: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept): every row of ``df``, with how many other rows it links with, the smallest id that links reach, and whether that is its own.

    Two rows link if the cosine of their vectors, in double precision, is at least ``cosine`` and they are found; none below it links. Rows with equal vectors always link.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept; so do vectors of other lengths with
    each other. Repeated ids are rows of their own that may link. Null ids are never the smallest; a component of null ids alone has component_id null, and a row without
    id is kept if its component is null. Columns other than the id are dropped, so clashing names cannot occur. An empty table gives none.
    Rotations are learned on ``sample`` distinct vectors, all others are coded by them.
    """
    kind, packed = ("float", "<f4") if df.schema[vector].dataType.simpleString() == "array<float>" else ("double", "<f8")
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("v"))
    able = finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = materialize(rows.withColumn("v", F.when(able, F.col("v"))), "vectors")
    distinct = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("n"))
    vertices = materialize(distinct.select(F.monotonically_increasing_id().alias("node"), "v", "least_id", "n"), "vertices")  # written once, so numbers stay
    count, size = vertices.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = rows.where("v IS NULL").select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return alone
    chosen = [r["v"] for r in vertices.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()]
    codes = learn(normalised(matrix([np.array(v, packed).tobytes() for v in chosen], size, packed)), count, cosine)

    def pack(batches):
        for batch in batches:
            column = batch.column(2)
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(packed), np.diff(column.offsets.to_numpy())
            ends = np.cumsum(sizes)
            bytes_of = [flat[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bytes_of, pa.binary()), pa.array(sizes.astype(np.int32))], names=["node", "n", "v", "length"])

    found = materialize(links(vertices.select("node", "n", "v").mapInArrow(pack, "node long, n long, v binary, length int"), codes, size, cosine, packed, tile), "links")
    root = components(found.where("a != b").select("a", "b").distinct())
    linked = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    rooted = vertices.select("node", "v", "least_id", "n").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(linked, "node", "left")
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(rooted.join(smallest, "root").select("v", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "named")
    met = join_heavy(rows.where("v IS NOT NULL"), named, "v", "n")
    return met.select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)
