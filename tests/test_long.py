"""The transform of texts of any length, by doubling over those suffixes that are still tied."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import transform

RNG = random.Random(11)


def texts():
    """Long texts, copies that differ at their ends or begin later, equal ones, runs of one symbol and empty ones."""
    base = ["".join(RNG.choices("12345", k=RNG.randrange(0, 400))) for _ in range(12)]
    rows = [*base, *(t[RNG.randrange(0, 40) :] + RNG.choice("12345") for t in base), *base[:4], *("5" * 300 for _ in range(3)), "5" * 277, "1" * 23, "1" * 46, "1" * 47, "", ""]
    RNG.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_build_long(spark, parts):
    held = texts()
    want = sorted((t[k:], i, k, int(t[k - 1]) if k else 0) for i, t in held for k in range(len(t) + 1))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that groups begin in ranges before
    try:
        got = transform.build_long(spark.createDataFrame(held, "seq_id long, s string").repartition(3)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["pos"] for r in got] == list(range(len(want)))
    assert [(r["seq_id"], r["off"], r["c"]) for r in got] == [w[1:] for w in want]


def test_only_tied_suffixes_go_on(spark, monkeypatch):
    """Suffixes that no other agrees with are sorted and written once; a round writes those that are tied."""
    written, real = [], transform.materialize

    def counted(df, name, *more):
        out = real(df, name, *more)
        written.append(out.where("off IS NOT NULL").count() if "off" in out.columns else 0)
        return out

    monkeypatch.setattr(transform, "materialize", counted)
    rows = [(i, "".join(RNG.choices("1234", k=150))) for i in range(40)] + [(100 + i, "1234" * 60) for i in range(2)]
    n = sum(len(t) + 1 for _, t in rows)
    assert transform.build_long(spark.createDataFrame(rows, "seq_id long, s string")).count() == n
    assert sum(written) < 2.5 * n


def test_ranks_over_ranges(spark):
    """Groups that fill ranges, and begin or end inside them."""
    rows = [(g, a, 0, k, 0, 0, 1) for k, (g, a) in enumerate([(0, 1)] * 3 + [(0, 2)] + [(10, x) for x in range(40)] + [(60, 5), (60, 5), (60, 6)])]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, a long, b long, seq_id long, off long, left long, c int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["seq_id"]: (r["r"], r["tied"]) for r in transform.ranked(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g, a, _, k, *_ in rows:
        before = sum(x[0] == g and x[1] < a for x in rows)
        want[k] = (g + before, sum(x[:2] == (g, a) for x in rows) > 1)
    assert got == want
    assert transform.ranked(df.where("false")).count() == 0
