"""The transform spelled in blocks, against the sort of spelled suffixes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import merge, runs, spelled, transform
from sparkloom.operators.index import Index

RNG = random.Random(3)


def reads():
    """Texts with long shared stretches, equal texts, empty ones and ones of a single symbol."""
    base = ["".join(RNG.choices("12345", k=RNG.randrange(0, 101))) for _ in range(60)]
    rows = [*base, *(t[RNG.randrange(0, 9) :] for t in base), *("5" * 101 for _ in range(9)), *("1" * RNG.randrange(0, 101) for _ in range(9)), *("" for _ in range(9))]
    rows += [RNG.choice("12345") + t[:60] + RNG.choice("12345") * 3 for t in base[:20]]
    RNG.shuffle(rows)
    return [(RNG.choice([0, 1, 2]), i * 7, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def held(spark):
    return spark.createDataFrame(reads(), "coll int, seq_id long, s string").repartition(3)


@pytest.mark.parametrize("ranges", [True, False])
def test_spelled_as_sorted(spark, held, monkeypatch, ranges):
    """In one range and in many, of which bounds lie inside equal suffixes; heads with several symbols before them are told apart by all that follows."""
    if ranges:
        monkeypatch.setattr(spelled, "BATCH", 600)
        monkeypatch.setattr(spelled, "STEP", 20)
    for texts, bwt in ((held.drop("coll"), transform.build(held.drop("coll"))), (held, merge.build(held))):
        made = spelled.spelled(texts, 64)
        want = [r["c"] for r in bwt.orderBy("pos").select("c").collect()]
        assert [int(c) for r in made.orderBy("blk").collect() for c in r["s"]] == want
        assert {len(r["s"]) for r in made.where(F.col("blk") < len(want) // 64).collect()} == {64}
        rows = lambda df: sorted(map(str, df.collect()))
        whole = runs.runs_of(bwt)
        assert rows(runs.runs_of_spelled(made, 64)) == rows(whole) and rows(runs.histogram_of_spelled(made, 64)) == rows(runs.histogram(whole))
        assert rows(runs.blocks_of_spelled(made, 64)) == rows(runs.blocks_of(runs.pieces_of(bwt), 64))


def test_runs_over_many_blocks(spark):
    """Runs that fill blocks, begin and end inside them or with them."""
    blocks = ["11", "11", "12", "21", "11", "12", "33", "31", "2"]
    made = spark.createDataFrame(list(enumerate(blocks)), "blk long, s string")
    assert [tuple(r) for r in runs.runs_of_spelled(made, 2).orderBy("run_id").collect()] == [(0, 0, 1, 5), (1, 5, 2, 2), (2, 7, 1, 4), (3, 11, 2, 1), (4, 12, 3, 3), (5, 15, 1, 1), (6, 16, 2, 1)]
    assert sorted(map(tuple, runs.histogram_of_spelled(made, 2).collect())) == [(1, 1, 1), (1, 4, 1), (1, 5, 1), (2, 1, 2), (2, 2, 1), (3, 3, 1)]


def test_no_texts(spark, held):
    none = spelled.spelled(held.where("false"), 64)
    assert not none.count() and not runs.histogram_of_spelled(none, 64).count() and not runs.runs_of_spelled(none, 64).count()


def test_suffixes_move_packed(spark):
    """A suffix that ends beyond its head moves with few bytes, and equal ones once."""
    rows = [(0, i, "".join(RNG.choices("12345", k=101))) for i in range(2000)]
    batch = spark.createDataFrame(rows, "coll long, seq_id long, s string").toArrow().combine_chunks().to_batches()[0]
    none = [batch.column(0).to_numpy()[:0]] * 3
    dealt = sum(b.nbytes for b in spelled._deal([batch], none))
    assert dealt < 7 * 102 * 2000
    equal = spark.createDataFrame([(0, i, "12345" * 20) for i in range(2000)], "coll long, seq_id long, s string").toArrow().combine_chunks().to_batches()[0]
    assert sum(b.nbytes for b in spelled._deal([equal], none)) < dealt / 4


def test_index_holds_its_runs(spark, held):
    texts = held.drop("coll")
    ix, bwt = Index.of_texts(texts, block_size=64), transform.build(texts)
    assert sorted(map(tuple, ix.runs().collect())) == sorted(map(tuple, runs.runs_of(bwt).collect()))
    assert sorted(map(tuple, ix.bwt.collect())) == sorted(map(tuple, bwt.select("pos", "c").collect()))


def test_heads_of_some_places(spark, held):
    """Bounds are found from the heads of the places looked at, and no others are made."""
    for _, _, digits, left, _ in spelled._layouts(held.select(F.lit(0).cast("long").alias("coll"), "seq_id", "s").toArrow().to_batches()):
        for at in (np.arange(len(digits)), np.arange(3, len(digits), 7), np.array([], int)):
            assert spelled._heads_at(digits, left, at).tolist() == spelled._heads(digits, left)[at].tolist()


def test_suffixes_looked_up_again(spark, held, monkeypatch):
    """Suffixes with an ambiguous head are sorted by all their symbols and their texts, and leave as a string for each head and range, not a row each."""
    made = {}
    real = spelled.materialize
    monkeypatch.setattr(spelled, "materialize", lambda df, name, *more: made.setdefault(name, real(df, name, *more)) if name == "late" else real(df, name, *more))
    spelled.spelled(held.drop("coll"), 64)
    late = made["late"].agg(F.count("*"), F.sum(F.length("s"))).first()
    assert 2 * late[0] < late[1]
    rests = ["".join(RNG.choices("12", k=RNG.randrange(0, 99))) for _ in range(200)] + ["1" * n for n in (0, 22, 23, 24, 45, 46, 47, 46, 46)]
    rows = [(RNG.randrange(3), r, RNG.randrange(2), RNG.randrange(50)) for r in rests * 2]
    group, coll, seq = (np.array([r[k] for r in rows]) for k in (0, 2, 3))
    symbols = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8) - 48
    order = spelled._late_order(group, symbols, np.array([len(r[1]) for r in rows]), coll, seq)
    assert [rows[k] for k in order] == sorted(rows)
    assert spelled._unpack_symbols(spelled._pack_symbols(symbols))[: len(symbols)].tolist() == symbols.tolist()
