"""Texts and places from one walk back over all texts at once, packed by chunks of positions."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import invert
from sparkloom.operators.index import Index

RNG = random.Random(17)
TEXTS = ["".join(RNG.choices("12345", k=RNG.choice([0, 1, 7, 22, 23, 24]))) for _ in range(60)] + ["5" * 26, "5" * 25, "", "1" * 24]


@pytest.fixture(scope="module")
def ix(spark):
    return Index.of_texts(spark.createDataFrame(list(enumerate(TEXTS)), "seq_id long, s string"), block_size=16)


@pytest.mark.parametrize("chunk", [16, 1 << 18])
def test_texts_and_places(spark, ix, monkeypatch, chunk):
    monkeypatch.setattr(invert, "CHUNK", chunk)
    assert [r["s"] for r in invert.texts_of_index(ix).orderBy("seq_id").collect()] == TEXTS
    asked = {0: "5", 1: "55", 2: "1234", 3: "55", 4: "21", 5: "5" * 26, 6: "1" * 30}
    p = spark.createDataFrame([(k, x.translate(str.maketrans("12345", "ACGTN"))) for k, x in asked.items()], "pattern_id long, pattern string")
    want = sorted((k, i, o) for k, x in asked.items() for i, t in enumerate(TEXTS) for o in range(len(t)) if t.startswith(x, o))
    assert sorted(map(tuple, invert.located_in_index(ix.find(p), ix).collect())) == want


def test_only_a_few_bytes_move(spark):
    """All rounds together: each position is met once, and packed."""
    rows = [(i, "".join(RNG.choices("1234", k=30))) for i in range(3000)]
    made = Index.of_texts(spark.createDataFrame(rows, "seq_id long, s string"))
    walked = invert.walk(made)
    open_ = walked.where("chunk >= 0")
    assert open_.agg(F.sum("n")).first()[0] == 31 * 3000
    assert open_.agg(F.sum(F.octet_length("at") + F.octet_length("seqs") + F.octet_length("words"))).first()[0] < 14 * 31 * 3000


def test_longer_texts_by_list_ranking(spark, ix, monkeypatch):
    assert invert.walk(ix, 25) is None and invert.walk(ix, 26) is not None
    monkeypatch.setattr(invert, "walk", lambda index: None)
    assert [r["s"] for r in invert.texts_of_index(ix).orderBy("seq_id").collect()] == TEXTS


def test_no_texts(spark, ix):
    none = Index.of_texts(spark.createDataFrame([], "seq_id long, s string"))
    assert invert.texts_of_index(none).count() == 0
    assert invert.located_in_index(spark.createDataFrame([(1, 0, 0)], "pattern_id long, lo long, hi long"), none).count() == 0


@pytest.mark.parametrize(("chunk", "step"), [(16, 8), (1 << 18, 5), (64, 1)])
def test_many_places_from_sampled_ones(spark, ix, monkeypatch, chunk, step):
    """Where most positions are asked for, each is met once from the sampled place behind it, packed; no position is walked back from."""
    monkeypatch.setattr(invert, "CHUNK", chunk)
    monkeypatch.setattr(invert, "TOLD", 7)
    monkeypatch.setattr(invert.lookups, "SENT", 10)
    monkeypatch.setattr(invert, "walked", None)
    made = Index.of_texts(spark.createDataFrame([(5 * i, t) for i, t in enumerate(TEXTS)], "seq_id long, s string"), block_size=16, places=step)
    begin, size = made.starts(step)
    spread = invert.spread_places(made, begin, step, size)
    assert spread.agg(F.sum("n")).first()[0] == made.bases
    asked = {0: "5", 1: "1", 2: "2", 3: "3", 4: "4", 5: "55", 6: "1234", 7: "21", 8: "1", 9: "5" * 30}
    want = sorted((k, 5 * i, o) for k, x in asked.items() for i, t in enumerate(TEXTS) for o in range(len(t)) if t.startswith(x, o))
    p = spark.createDataFrame([(k, x.translate(str.maketrans("12345", "ACGTN"))) for k, x in asked.items()], "pattern_id long, pattern string")
    if step > 2:
        assert sorted(map(tuple, made.locate(p, step).collect())) == want
        assert sorted((k, 5 * i, o) for k, i, o in ix.locate(p, step).collect()) == want  # an index without places
    else:
        assert sorted(map(tuple, invert._met(made.find(p).where("lo < hi").select("pattern_id", "lo", "hi"), spread, size).collect())) == want
