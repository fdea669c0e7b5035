"""Importance resampling, embedding near-duplicates and hard negatives against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import embedding_dedup, hard_negatives, resampling
from sparkloom.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_buckets(text, buckets=10_000):
    words = brute_words(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(docs, items):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for texts, to in ((docs, s), (items, t)):
        for _, text in texts:
            np.add.at(to, brute_buckets(text), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (int(s.sum()) + 10_000) / ((s[b] + 1) * (int(t.sum()) + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        found = brute_buckets(text)
        weight = sum(gain[b] for b in found)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(out, docs) if len(brute_words(text)) >= 20]
    for place, r in enumerate(sorted((r for r in able if r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))[: 5 * len(able) // 100]):
        r[4] = place + 1
    return [tuple(r) for r in out]


TEXTS = [None, "", "  \n", "One", "a-b_c 9Z", "é ü ñandú 漢字 word", "x" * 5000 + " tail", "Ünï CODE" * 300, "w " * 3000, "ends here", "begins\tthere", "\x7f\x80 İstanbul ſ"]


def test_grams_are_crcs_of_runs(monkeypatch):
    """Buckets of all rows, however the words are cut into blocks and slices of an array start elsewhere."""
    want = [sorted(brute_buckets(t, 997)) for t in TEXTS]
    for together in (2, 5, 1 << 17):
        monkeypatch.setattr(resampling, "TOGETHER", together)
        for column, off in ((pa.array(TEXTS), 0), (pa.array(["skipped", *TEXTS]).slice(1), 0), (pa.array(TEXTS).cast(pa.large_string()), 0)):
            got = [[] for _ in TEXTS]
            for row, bucket in resampling.grams(column, 3, 997):
                assert (np.diff(row) >= 0).all()
                for r, b in zip(row.tolist(), bucket.tolist()):
                    got[r].append(b)
            assert [sorted(g) for g in got] == want
    assert resampling.word_counts(pa.array(TEXTS)).tolist() == [len(brute_words(t)) for t in TEXTS]
    assert not list(resampling.grams(pa.array([], pa.string()))) and resampling.word_counts(pa.array([None, ""])).tolist() == [0, 0]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("resampling")), random.Random(31)
    words = ["".join(rng.choices("abcdéfgh", k=rng.randrange(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(k, text(rng.randrange(0, 60))) for k in range(300)] + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    docs += [(7, docs[7][1]), (8, text(30)), (None, text(40)), (None, None), (-3, text(25))]
    items = [(k, text(15)) for k in range(12)] + [(None, None), (99, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_op11(spark, corpus):
    got = QUERIES["op11_importance_resampling"](spark, corpus[0]).collect()
    assert got[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got), key=str) == sorted(brute_resample(corpus[1], corpus[2]), key=str)


def test_resampling_of_any_rows(spark):
    docs = spark.createDataFrame([(k, "a b c " * k, k, "x") for k in range(30)], "doc_id long, text string, rank int, `a.b` string").withColumn("score", F.lit("mine")).withColumn("c0", F.lit(5))
    gains = resampling.learn(docs, docs.limit(0), buckets=50)
    assert len(gains) == 50 and resampling.learn(docs.limit(0), docs.limit(0), buckets=3) == [0, 0, 0]
    weighed = resampling.weigh(docs, gains)
    drawn = resampling.draw(weighed, percent=50)
    assert drawn.columns == [*(c for c in weighed.columns if c not in ("score", "rank")), "score", "rank"]
    rows = drawn.collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 12)) and all(r["a.b"] == "x" and r["c0"] == 5 for r in rows)
    ties = resampling.draw(docs.select(F.lit(1).alias("doc_id"), F.lit(0).cast("long").alias("weight"), F.lit(20).cast("long").alias("n_words")), percent=100)
    assert sorted(r["rank"] for r in ties.collect()) == list(range(1, 31))
    assert resampling.draw(weighed.limit(0)).count() == 0


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_dups(rows, cosine=0.95):
    """(id, n_links, component_id, kept) of (id, vector) rows by all pairs."""
    able = [k for k, (_, v) in enumerate(rows) if usable(v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in able}
    near = {k: [j for j in able if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in able}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = [j for j in near.get(todo.pop(), ()) if j not in seen]
            seen.update(new), todo.extend(new)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(near.get(k, ())), least, i == least))
    return out


def vectors(seed, clusters, noise, dims=32, alone=300):
    """Rows around centres, and rows alone."""
    rng, rows = np.random.default_rng(seed), []
    for size in clusters:
        centre = rng.standard_normal(dims)
        rows += [centre + noise * rng.standard_normal(dims) for _ in range(size)]
    rows += list(rng.standard_normal((alone, dims)))
    order = rng.permutation(len(rows))
    return [(int(k), np.float32(rows[j]).astype(float).tolist()) for k, j in enumerate(order)]


def dups(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return embedding_dedup.groups(df.withColumn("n_links", F.lit("clash")).withColumn("a.b", F.lit(1)), **how).collect()


def test_embedding_groups(spark):
    rows = vectors(1, (2, 2, 3, 5, 40), 0.12)
    rows += [(500 + k, rows[3][1]) for k in range(60)] + [(600, [2 * x for x in rows[5][1]]), (None, rows[6][1]), (601, None), (602, []), (603, [0.0] * 32), (604, [None] * 32), (605, [float("nan")] * 32), (606, [float("inf")] + [1.0] * 31), (607, rows[3][1][:16]), (608, rows[3][1][:16]), (3, rows[9][1]), (None, None)]
    assert sorted(map(tuple, dups(spark, rows)), key=str) == sorted(brute_dups(rows), key=str)
    assert sorted(map(tuple, dups(spark, rows, tile=8)), key=str) == sorted(brute_dups(rows), key=str)  # crowded places in many tiles
    assert dups(spark, []) == [] and [tuple(r) for r in dups(spark, [(4, None)])] == [(4, 0, 4, True)] and [tuple(r) for r in dups(spark, [(4, [1.0, 2.0])])] == [(4, 0, 4, True)]


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300]), (4, [5e-324, 0.0])]
    assert sorted((r["vec_id"], r["component_id"]) for r in dups(spark, rows, "double")) == [(1, 1), (2, 1), (3, 3), (4, 4)]


@pytest.mark.parametrize("noise", [0.10, 0.15, 0.2])
def test_recall_of_links(spark, noise):
    """Links found among all there are, with many pairs near the threshold; none is found that is not there."""
    rows = vectors(2, (6,) * 150, noise, 64, 1000)
    got, want = {r["vec_id"]: r["n_links"] for r in dups(spark, rows)}, {i: n for i, n, _, _ in brute_dups(rows)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.97 * sum(want.values()) > 0


def test_rotations_balance_and_tables_reach():
    rng = np.random.default_rng(4)
    x = embedding_dedup.normalised(rng.standard_normal((3000, 40)) * np.linspace(3, 0.3, 40) + 0.3)
    codes = embedding_dedup.learn(x, 3000, 0.95)
    signs = (x - codes.mean) @ codes.rotations[0] > 0
    assert codes.bits == 12 and abs(signs.mean(axis=0) - 0.5).max() < 0.1
    assert np.allclose(codes.rotations[0] @ codes.rotations[0].T, np.eye(40))
    turned = embedding_dedup.rotation((x - codes.mean) @ codes.rotations[0], rng)
    lost = lambda r: np.abs(np.abs(y := (x - codes.mean) @ r) - 1.0 * np.abs(y).mean()).mean()
    assert lost(codes.rotations[0] @ turned) < lost(np.eye(40))
    assert codes.of(x).shape == (3000, codes.tables) and codes.of(x).max() < 1 << 12


def brute_hard(rows):
    """The contract of op13 on (id, vector, label) rows."""
    able = [(i, np.floor(256 * np.array(v, np.float64)).astype(int), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and y is not None and usable(v)]
    out = []
    for i, v, y in able:
        if i % 100:
            continue
        scored = [(-int(v @ w), j, z) for j, w, z in able if j != i and len(w) == len(v)]
        for p, j, z in sorted(s for s in scored if s[2] == y)[:5]:
            fit = sorted(s for s in scored if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return out


@pytest.mark.parametrize("scale", [1.0, 0.02])
def test_op13(spark, tmp_path, scale, monkeypatch):
    """Also with many ties, in blocks of few anchors and rows."""
    monkeypatch.setattr(hard_negatives, "ROWS", 37), monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(6)
    rows = [(k, (scale * np.abs(v)).astype(np.float32).astype(float).tolist(), int(rng.integers(0, 10))) for k, v in enumerate(rng.standard_normal((900, 8)))]
    rows += [(1000 + k, rows[5][1], 3) for k in range(200)]  # one very common vector
    rows += [(2000, None, 1), (2100, [None] * 8, 1), (2200, rows[1][1], None), (2300, [float("nan")] * 8, 2), (None, rows[1][1], 1), (2400, [0.0] * 8, 4), (2500, [], 1), (2501, [], 1), (2502, [], 2), (2600, [1.0] * 4, 1), (-100, rows[3][1], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    assert got[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(brute_hard(rows))
    assert sorted(map(tuple, got)) == want and len(want) > 50


def test_blocks_of_anchors_merge(spark):
    """The same rows whether the anchors go out one at a time or together; repeated anchors count once."""
    rng = np.random.default_rng(7)
    rows = [(k, rng.random(6).tolist(), k % 3) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("a.b", F.lit(1)).withColumn("id", F.lit(2))
    asked = df.where("vec_id % 20 = 0")
    mined = lambda a, **how: sorted(map(tuple, hard_negatives.mine(df, a, **how).collect()))
    assert mined(asked) == mined(asked, block_bytes=1) == mined(asked.unionByName(asked)) and mined(asked)
    assert mined(asked.limit(0)) == [] and hard_negatives.mine(df.limit(0), asked).count() == 0


def test_best_merges_in_any_order():
    rng = np.random.default_rng(8)
    scores, ids = rng.integers(0, 9, (4, 60)).astype(float), rng.permutation(60)
    want = [sorted(zip(-scores[r], ids))[:5] for r in range(4)]
    for cut in (1, 7, 60):
        best = hard_negatives.Best(4, 5)
        for a in range(0, 60, cut):
            best.add(np.arange(4), scores[:, a : a + cut], ids[a : a + cut], np.ones((4, min(cut, 60 - a)), bool))
        assert [list(zip(-best.scores[r], best.ids[r])) for r in range(4)] == want


def test_time_of_long_words():
    began = time.time()
    assert len(list(resampling.grams(pa.array(["x" * 3_000_000 + " y", "é" * 500_000])))) == 3
    assert time.time() - began < 5
