"""Where the index's tables stay, what its blocks hold, splits of files, the sink, the stream's levels and SQL over an index."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import invert, lookups, merge, runs, search, transform
from sparkloom.operators.index import Index
from sparkloom.plans.shared import laid_out, materialize_counted
from sparkloom.sources import codecs, files, splits
from sparkloom.streaming import incremental
from tests.test_index import digits, spelled, texts

RNG = random.Random(41)
ROWS = ["".join(RNG.choices("ACGTN", weights=(6, 3, 2, 2, 1), k=RNG.randrange(0, 40))) for _ in range(50)] + ["A" * 60, "AC" * 25]


@pytest.fixture(scope="module")
def whole(spark):
    return Index.of_texts(texts(spark, ROWS), block_size=64, places=8)


def moved_tables(df, name):
    """Tables whose names hold ``name`` and that lie under an exchange in the plan of ``df``."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node, under):
        under = under or "Exchange" in node.nodeName()
        if name in node.simpleString(1000) and "Scan" in node.nodeName():
            found.append(under)
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.inputPlan(), under)
        kids = node.children()
        for k in range(kids.size()):
            walk(kids.apply(k), under)

    walk(plan, False)
    assert found, plan.toString()
    return [x for x in found if x]


@pytest.mark.parametrize("few", [True, False])
def test_no_lookup_moves_the_index(spark, whole, few):
    at = spark.range(100).select(F.col("id").alias("i"), F.lit(2).alias("c"), F.col("id").alias("lo"), (F.col("id") + 5).alias("hi"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            lookups.rank(at, whole.blocks, whole.counts, size=64, few=few), lookups.ranks(at, whole.blocks, whole.counts, size=64, few=few),
            lookups.range_ranks(at.drop("c"), whole.blocks, whole.counts, size=64, few=few), lookups.inverse_select(at.select("i"), whole.blocks, whole.counts, size=64, few=few),
            search.mapped_ends(at.select(F.col("i").alias("key"), F.lit("1").alias("p"), F.lit(1).alias("n"), "lo", "hi", "c"), whole.blocks, whole.counts, 64, few),
            lookups.step_back(at.select(F.col("i").alias("pos")), whole.blocks, whole.counts, size=64, few=few),
        ):
            whole_plan = df.select(*df.columns)
            assert not [x for x in moved_tables(whole_plan, "sparkloom_blocks") if x] or "groupBy" in str(df), df
        for name in ("sparkloom_blocks", "sparkloom_directory"):
            assert not moved_tables(whole.select(at.select("i", "c")), name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blocks_hold_runs(spark, whole):
    symbols = [r["c"] for r in whole.bwt.orderBy("pos").collect()]
    for r in whole.blocks.orderBy("blk").collect():
        own = symbols[r["start_pos"] : r["end_pos"]]
        assert [r[f"n{k}"] for k in range(6)] == [symbols[: r["start_pos"]].count(k) for k in range(6)]
        starts, before = [e >> 16 for e in r["at"]], [e & 0xFFFF for e in r["at"]]
        assert starts[-1] == len(own) and [int(c) for c, a, b in zip(r["sym"], starts, starts[1:]) for _ in range(b - a)] == own
        assert all(own[:a].count(int(c)) == n for c, a, n in zip(r["sym"], starts, before)) and all(x != y for x, y in zip(r["sym"], r["sym"][1:]))
    row = runs.storage(whole.blocks).first()
    assert row["positions"] == len(symbols) and row["bytes"] == 5 * row["runs"] + 4 * row["blocks"]


def test_lookups_in_small_blocks(spark, whole):
    symbols = [r["c"] for r in whole.bwt.orderBy("pos").collect()]
    n = len(symbols)
    at = spark.range(-2, n + 3).select(F.col("id").alias("i"), F.pmod("id", F.lit(7)).cast("int").alias("c"), F.lit("kept").alias("sym"), F.lit(1).alias("blk"))
    for r in whole.rank(at).collect():
        assert r["rank"] == symbols[: max(0, r["i"])].count(r["c"]) and r["sym"] == "kept"
    places = {c: [i for i, x in enumerate(symbols) if x == c] for c in range(6)}
    asked = spark.createDataFrame([(i, c, "x") for c in range(7) for i in range(-1, len(places.get(c, [])) + 2)], "i long, c int, held string")
    for r in whole.select(asked).collect():
        own = places.get(r["c"], [])
        assert r["pos"] == (0 if r["i"] <= 0 else own[r["i"] - 1] if r["i"] <= len(own) else n)


def test_questions_from_outside_do_not_crowd(spark, whole):
    """Positions past the end, or before the start, are not all put to one block."""
    far = spark.range(4000).select((F.col("id") + whole.bases).alias("i"), F.lit(1).alias("c"))
    for at in (far, far.withColumn("i", -F.col("i")), far.withColumn("i", F.when(F.col("c") > 1, F.col("i")))):
        at = at.withColumn("held", F.monotonically_increasing_id())
        met = lookups.meet(at, whole.blocks, whole.counts, "i", 64).groupBy("blk").count().collect()
        assert sum(r["count"] for r in met) == 4000 and max(r["count"] for r in met) < 2000
    assert {r["rank"] for r in whole.rank(far).collect()} == {whole.counts[1]} and {r["c"] for r in whole.access(far.select("i")).collect()} == {0}


def test_short_patterns_are_counted_where_the_texts_lie(spark):
    """Stretches of up to eight symbols leave the tasks as counts, not as rows of their own; windows cut none."""
    rows = [*ROWS, None, "", "ACGT" * 300]
    asked = ["A", "AC", "GTAC", "ACGTACGT", "NNN", "ACGTACGTA", "ACGT" * 4, "ACGT" * 5, "TA" * 9, "ACGTACGT"]
    p, held = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string"), texts(spark, [t or "" for t in rows])
    want = {k: sum((t or "").startswith(a, i) for t in rows for i in range(len(t or ""))) for k, a in enumerate(asked)}
    assert {r["pattern_id"]: r["matches"] for r in search.in_texts(p, held).collect()} == want
    plan = search.in_texts(p.where("length(pattern) <= 8"), held)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_windows_cut_no_stretch(monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 7)
    rows = [digits(t) for t in ROWS] + [""]
    for n in (1, 3, 8):
        found = [np.base_repr(c, 6).zfill(n) for _, symbols, own in search._windows(pa.array(rows), 8) for c in search._codes(symbols, n, own, 6).tolist()]
        assert sorted(x for x in found if "0" not in x) == sorted(t[i : i + n] for t in rows for i in range(len(t) - n + 1))


def test_reverse_tree(spark, whole):
    asked = ["", *(t[i:j] for t in ROWS[:12] for i in (0, 3) for j in (5, 9, 40)), "ACAC", "CACAC", "AAAAAA", "ACGTACGT", "TTTTTTTTTT", "A", "$A", "A$"]
    p = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    tree = {r["p"]: r for r in search.reverse_tree(p.select(F.translate("pattern", "ACGTN$", "123450").alias("p")).distinct()).collect()}
    by_key = {r["key"]: p for p, r in tree.items()}
    for s, r in tree.items():
        assert r["n"] == len(s) and (r["parts"] == 0 or s.endswith(by_key[r["origin"]][len(by_key[r["origin"]]) - r["parts"] :]) and r["parts"] < r["n"])
    nodes = sum(r["n"] - r["parts"] for r in tree.values())
    assert nodes < sum(map(len, tree)) and nodes >= len({s[k:] for s in tree for k in range(len(s))})
    strings = [f"${t}$" for t in ROWS]
    got = {r["pattern_id"]: r["matches"] for r in whole.count(p).collect()}
    for k, a in enumerate(asked):
        if a:
            assert got[k] == sum(t.startswith(a, i) for t in strings for i in range(len(t))), a
    assert got[0] == whole.bases


def test_sampled_places(spark, whole):
    asked = ["AC", "A", "GT", "NA", "TTTTTTTT", ROWS[3]]
    p = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    want = sorted((k, i, o) for k, a in enumerate(asked) for i, t in enumerate(ROWS) for o in range(len(t)) if a and t.startswith(a, o))
    assert sorted(map(tuple, whole.locate(p, 8).select("pattern_id", "seq_id", "off").collect())) == want
    bare = Index.of_bwt(whole.bwt, block_size=64)
    assert sorted(map(tuple, bare.locate(p, 5).select("pattern_id", "seq_id", "off").collect())) == want
    assert bare.places(5).where("off % 5 <> 0").isEmpty()
    ends = spark.range(len(ROWS)).select(F.col("id").alias("pos"), F.col("id").alias("text"))
    got = {r["text"]: r["before"] for r in invert.extracted(ends, whole, 6).collect()}
    assert got == {i: digits(t)[-6:] for i, t in enumerate(ROWS)}


def test_positions_are_walked_once(spark, whole, monkeypatch):
    """However many patterns have a position in their range, it is walked back from once."""
    walks, walked = [], invert.walked
    monkeypatch.setattr(invert, "walked", lambda at, *more: walks.append(at.count()) or walked(at, *more))
    p = spark.createDataFrame([(k, "AC"[: 1 + k % 2]) for k in range(8)], "pattern_id long, pattern string")
    want = sorted((k, i, o) for k in range(8) for i, t in enumerate(ROWS) for o in range(len(t)) if t.startswith("AC"[: 1 + k % 2], o))
    assert sorted(map(tuple, whole.locate(p, 8).collect())) == want and walks == [sum(t.count("A") for t in ROWS)]


def test_many_indexes_merge_at_once(spark):
    parts = [ROWS[:9], [], ROWS[9:30], ROWS[30:31], ROWS[:9]]
    made = merge.merge_indexes([Index.of_texts(texts(spark, p), block_size=16) for p in parts])
    assert spelled(made.bwt) == spelled(transform.build(texts(spark, sum(parts, []))))
    with pytest.raises(ValueError):
        merge.merge_indexes([Index.of_texts(texts(spark, ROWS[:1]), block_size=n) for n in (16, 32)])


def test_saved_indexes_keep_their_buckets(spark, whole, tmp_path):
    whole.save(str(tmp_path / "x"))
    back = Index.load(spark, str(tmp_path / "x"))
    assert back.counts == whole.counts and back.block_size == 64 and spelled(back.bwt) == spelled(whole.bwt)
    assert not moved_tables(back.rank(spark.range(9).select(F.col("id").alias("i"), F.lit(1).alias("c"))), "sparkloom_blocks")


@pytest.mark.parametrize("tag", ["native", "sga", "ropebwt", "rfm", "plain_default"])
def test_splits_do_not_change_runs(spark, tmp_path, tag, monkeypatch):
    """A file read as one split and as many, in chunks of 128 bytes."""
    pairs, last = [], None
    for _ in range(900):
        last = RNG.choice([c for c in range(6) if c != last])
        pairs.append((last, RNG.choice((1, 2, 3, 40, 700))))
    data = codecs.encode(tag, *map(__import__("numpy").array, zip(*pairs)))
    bases = sum(n for _, n in pairs)
    head = b"!BWT" + bytes(4) + (1).to_bytes(8, "little") + bases.to_bytes(8, "little") + len(data).to_bytes(8, "little") if tag == "native" else codecs.header(tag, 1, bases, len(data))
    (tmp_path / "f").write_bytes(head + data + codecs.padding(tag, bases) + (bytes(99) if tag == "native" else b""))
    want, at = [], 0
    for c, n in pairs:
        want.append((at, c, n))
        at += n
    monkeypatch.setattr(splits, "CHUNK", 128)
    for split in (1 << 30, 128, 4096):
        read = files.read_pieces(spark, str(tmp_path / "f"), tag, split)
        got = [tuple(r) for r in runs.coalesce_runs(read).orderBy("start").select("start", "c", "len").collect()]
        assert got == want
    assert splits._Reader("", tag, 40, 40 + 128 * 50, 128).partitions()[-1] == splits.Split(49, 40 + 128 * 49, 40 + 128 * 50)


def test_sink_writes_in_places(spark, tmp_path):
    rows = spark.createDataFrame([(k * 3, bytes([65 + k]) * 3) for k in range(20)], "at long, data binary").repartition(7)
    splits.write_bytes(rows, str(tmp_path / "new" / "f"), b"<<", b">", 60)
    assert (tmp_path / "new" / "f").read_bytes() == b"<<" + b"".join(bytes([65 + k]) * 3 for k in range(20)) + b">"
    with pytest.raises(Exception):  # noqa: B017
        splits.write_bytes(rows.limit(3), str(tmp_path / "g"), b"", b"", 60)
    assert os.listdir(tmp_path) == ["new"] and os.listdir(tmp_path / "new") == ["f"]
    splits.write_bytes(rows.limit(0), str(tmp_path / "h"), b"head", b"", 0)
    assert (tmp_path / "h").read_bytes() == b"head"


def test_levels_of_a_stream(spark, tmp_path):
    path, seen = str(tmp_path / "stream"), []
    p = spark.createDataFrame([(0, "AC"), (1, "A")], "pattern_id long, pattern string")
    assert {r["matches"] for r in incremental.count(spark, path, p).collect()} == {0}
    for k in range(5):
        batch = spark.createDataFrame([(10 * k + i, digits(t)) for i, t in enumerate(ROWS[3 * k : 3 * k + 3])], "seq_id long, s string")
        incremental.add(spark, path, batch, k, fan=2)
        incremental.add(spark, path, batch, k, fan=2)  # run again: nothing happens
        seen.append([x["level"] for x in incremental.manifest(spark, path)["parts"]])
    assert seen == [[0], [1], [1, 0], [2], [2, 0]]
    held = {x["name"] for x in incremental.manifest(spark, path)["parts"]}
    assert held <= {n for n in os.listdir(path) if n.startswith("part-")} and len([n for n in os.listdir(path) if n.startswith("part-")]) <= 3
    want = {k: sum(t.startswith(a, i) for t in ROWS[:15] for i in range(len(t))) for k, a in ((0, "AC"), (1, "A"))}
    assert {r["pattern_id"]: r["matches"] for r in incremental.count(spark, path, p).collect()} == want
    assert spelled(incremental.compact(spark, path).bwt) == spelled(transform.build(texts(spark, ROWS[:15])))
    assert [x["level"] for x in incremental.manifest(spark, path)["parts"]] == [3]


def test_layout_and_counts(spark):
    df, n = materialize_counted(spark.range(1000).withColumn("k", F.col("id") % 50), "x")
    assert n == 1000 == df.count()
    assert "Exchange" not in laid_out(df, "k", "x").groupBy("k").count()._jdf.queryExecution().toString().split("Initial Plan")[-1]


def test_sql_over_an_index(spark, whole):
    whole.views("reads")
    symbols = [r["c"] for r in spark.sql("SELECT c FROM reads_bwt ORDER BY pos").collect()]
    n = len(symbols)
    got = spark.sql(f"SELECT id, reads_rank(int(id % 7), id) AS r, reads_symbol(id) AS s FROM range(-2, {n + 3})").collect()
    assert all(r["r"] == symbols[: max(0, r["id"])].count(r["id"] % 7) for r in got if r["id"] >= 0)
    assert all(r["s"] == (symbols[r["id"]] if 0 <= r["id"] < n else 0) for r in got)
    assert spark.sql("SELECT sum(len) FROM reads_runs").first()[0] == n == spark.sql("SELECT sum(cnt) FROM reads_alphabet").first()[0]


def test_a_block_passes_once_for_all_its_questions(spark, whole):
    """Many questions, also of one place and with names of any kind, meet a block that one of them carries."""
    symbols = [r["c"] for r in whole.bwt.orderBy("pos").collect()]
    at = spark.range(-3, len(symbols) + 3).select(F.when(F.col("id") % 7 == 0, F.lit(70)).otherwise(F.col("id")).alias("i"), F.col("id").alias("a name"))
    for df in (whole.ranks(at), whole.inverse_select(at), whole.rank(at.withColumn("c", F.lit(1))), whole.select(at.withColumn("c", F.lit(1)))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "aggregate(array" not in plan.split("MapInArrow")[0]
    inside = lambda i: 0 <= i < len(symbols)
    for r in whole.ranks(at).collect():
        assert [r[f"r{k}"] for k in range(1, 6)] == [symbols[: max(0, r["i"])].count(k) for k in range(1, 6)]
    for r in whole.inverse_select(at).collect():
        assert (r["c"], r["r"]) == ((symbols[r["i"]], symbols[: r["i"]].count(symbols[r["i"]])) if inside(r["i"]) else (0, 0))


@pytest.mark.parametrize("tag", ["ropebwt", "plain_default"])
def test_runs_of_a_file_do_not_move(spark, tmp_path, tag, monkeypatch):
    """Runs that go on over many chunks are put together from a row a chunk; runs pass packed when they are written."""
    pairs = [(k % 5 + k // 5 % 2, RNG.choice((1, 2, 40, 9000))) for k in range(300)]
    pairs = [p for k, p in enumerate(pairs) if not k or p[0] != pairs[k - 1][0]]
    pairs = [p for k, p in enumerate(pairs) if not k or p[0] != pairs[k - 1][0]]
    want, at = [], 0
    for k, (c, n) in enumerate(pairs):
        want.append((k, at, c, n))
        at += n
    rows = spark.createDataFrame(want, "run_id long, start long, c int, len long").repartition(5)
    done = files.write_runs(rows, str(tmp_path / "f"), tag)
    assert (done["runs"], done["bases"], done["bytes"]) == (len(want), at, os.path.getsize(tmp_path / "f"))
    monkeypatch.setattr(splits, "CHUNK", 128)
    for split in (1 << 30, 128):
        read = files.read_runs(spark, str(tmp_path / "f"), tag, split)
        assert [tuple(r) for r in read.orderBy("run_id").collect()] == want
        assert "Exchange hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()
    held = files.packed(rows)
    assert held.agg(F.sum("runs")).first()[0] == len(want) and held.count() <= at // files.CELL + 1 + 5


def test_blocks_are_spelled_at_once(spark, whole):
    """Positions are spelled a batch of blocks at a time, not exploded run by run; a range is cut out of a block that is spelled once."""
    for df in (whole.bwt, whole.edges, whole.extract(spark.createDataFrame([(0, 5)], "lo long, hi long"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "explode(transform" not in plan
    symbols = "".join(str(r["c"]) for r in whole.bwt.orderBy("pos").collect())
    n = len(symbols)
    asked = [(0, n), (0, 1), (63, 64), (63, 65), (10, 300), (10, 300), (n - 1, n), (n, n), (5, 5), (7, 3), (-1, 4), (n - 1, n + 1), (None, 4), *((a, a + 7) for a in range(0, n - 7, 5))]
    got = whole.extract(spark.createDataFrame(asked, "lo long, hi long")).collect()
    want = [(a, b, symbols[a:b] if a is not None and 0 <= a < b <= n else None) for a, b in asked]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("tag", ["ropebwt", "sdsl"])
def test_runs_of_a_file_meet_no_table(spark, tmp_path, tag):
    """Spark cannot take the runs of a file for small and send them to all workers through the driver: they stand in no join."""
    rows = spark.createDataFrame([(k, 3 * k, k % 2, 3) for k in range(500)], "run_id long, start long, c int, len long")
    files.write_runs(rows, str(tmp_path / "f"), tag, codecs.FORMATS[tag].order)
    read = files.read_runs(spark, str(tmp_path / "f"), tag)
    assert "Join" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))


def test_questions_are_dealt_out(spark, whole):
    """Questions that Spark takes for few, made by few rows, are not sent to all workers; every occurrence of every symbol is numbered in all tasks."""
    made = spark.createDataFrame([(c, n) for c, n in enumerate(whole.counts) if n], "c int, n long").select("c", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    every = lookups.occurrences(spark, whole.counts)
    assert sorted(map(tuple, every.select("c", "i").collect())) == sorted(map(tuple, made.collect()))
    assert every.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    for asked in (made, every):
        plan = whole.select(asked)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
    none = lookups.occurrences(spark, [0, 3, 0, 0, 2, 0])
    assert sorted(map(tuple, none.collect())) == [(1, 1), (1, 4), (2, 1), (2, 4), (3, 1)]


def test_an_index_is_made_where_its_symbols_lie(spark):
    """Spelled symbols lie in the buckets of the index's blocks, which are made of them there: neither moves, and a bucket is one file."""
    held = transform_spelled(spark)
    made = runs.blocks_of_spelled(held, 64)
    assert not moved_tables(made, "sparkloom_spelled")
    files_of = Index.of_texts(texts(spark, ROWS), block_size=64).blocks.inputFiles()
    buckets = [f.rpartition("_")[2][:5] for f in files_of]
    assert len(buckets) == len(set(buckets))


def transform_spelled(spark):
    from sparkloom.operators import spelled as symbols

    return symbols.spelled(texts(spark, ROWS), 64)
