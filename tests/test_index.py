"""The worked example of two texts, random collections against brute force, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import alphabet
from sparkloom.operators import invert, lookups, merge, runs, search, transform
from sparkloom.operators.index import Index
from sparkloom.plans.order import positions, running

R, S = "CTAGCATCGAC", "CTAGCATAGAC"


def digits(text):
    return text.translate(str.maketrans("ACGTN", "12345"))


def texts(spark, rows):
    return spark.createDataFrame([(i, digits(t)) for i, t in enumerate(rows)], "seq_id long, s string")


def brute(rows):
    """(symbol, text, offset) of all suffixes in order."""
    return [(int(t[o - 1]) if o else 0, i, o) for _, i, o, t in sorted((t[o:], i, o, t) for i, t in enumerate(map(digits, rows)) for o in range(len(t) + 1))]


def spelled(bwt):
    return "".join("$ACGTN"[r["c"]] for r in bwt.orderBy("pos").collect())


@pytest.fixture(scope="module")
def example(spark):
    return {name: Index.of_texts(texts(spark, rows)) for name, rows in (("R", [R]), ("S", [S]), ("RS", [R, S]))}


def test_golden_transforms(example):
    assert {k: spelled(x.bwt) for k, x in example.items()} == {"R": "CGTCAGT$CACA", "S": "CGTTCAG$AAAC", "RS": "CCGGTTTCCAAGGT$$CAAAACCA"}
    assert [example[k].counts for k in ("R", "S", "RS")] == [[1, 3, 4, 2, 2, 0], [1, 4, 3, 2, 2, 0], [2, 7, 7, 4, 4, 0]]
    assert [r["c_before"] for r in example["RS"].alphabet.orderBy("comp").collect()] == [0, 2, 9, 16, 20, 24]


def test_golden_runs_and_samples(example):
    found = [("$ACGTN"[r["c"]], r["len"]) for r in example["RS"].runs().orderBy("start").collect()]
    assert found == [("C", 2), ("G", 2), ("T", 3), ("C", 2), ("A", 2), ("G", 2), ("T", 1), ("$", 2), ("C", 1), ("A", 4), ("C", 2), ("A", 1)]
    samples = runs.samples_of(runs.blocks_of(example["RS"].runs(), 8)).orderBy("block").collect()
    assert [[r[f"n{k}"] for k in range(6)] for r in samples] == [[0, 0, 0, 0, 0, 0], [0, 0, 3, 2, 3, 0], [2, 2, 4, 4, 4, 0]]
    assert runs.content_hash(example["RS"].blocks) == 0x79184F66DA5567A2


def test_golden_lf(example):
    got = [(r["c"], r["lf"]) for r in example["RS"].edges.orderBy("pos").collect()]
    want = "9 10 16 17 20 21 22 11 12 2 3 18 19 23 - - 13 4 5 6 7 14 15 8".split()
    assert [str(lf) if c else "-" for c, lf in got] == want


def test_golden_counts(spark, example):
    p = spark.createDataFrame(list(enumerate(["AG", "CTA", "TCG", "GAC", "CAT", "N", "C$", "$CTAG", f"${R}$", "", "ACGTACGTACGTACGTACGT", "x"])), "pattern_id long, pattern string")
    want = {"R": [1, 1, 1, 1, 1, 0, 1, 1, 1, 12, 0, 0], "S": [2, 1, 0, 1, 1, 0, 1, 1, 0, 12, 0, 0], "RS": [3, 2, 1, 2, 2, 0, 2, 2, 1, 24, 0, 0]}
    for k, x in example.items():
        assert [r["matches"] for r in x.count(p).orderBy("pattern_id").collect()] == want[k]
    assert all(r["same"] for r in merge.verify(p.where("pattern_id < 9"), [example["R"], example["S"]], example["RS"]).collect())
    totals = search.totals(example["RS"].find(p)).first()
    assert (totals["patterns"], totals["found"], totals["matches"]) == (12, 9, sum(want["RS"]))


def test_golden_rank_array(spark, example):
    both = merge.merge(texts(spark, [R]), texts(spark, [S]))
    want = [1, 2, 2, 2, 3, 5, 5, 7, 9, 9, 10, 10]
    ra = merge.rank_array(both)
    assert [r["a_rank"] for r in ra.orderBy("b_pos").collect()] == want
    assert [tuple(r) for r in merge.rank_runs(ra).orderBy("a_rank").collect()] == [(1, 1), (2, 3), (3, 1), (5, 2), (7, 1), (9, 2), (10, 2)]
    searched = merge.rank_array_of_indexes(example["R"], example["S"])
    assert [r["a_rank"] for r in searched.orderBy("b_pos").collect()] == want
    assert spelled(merge.interleave(example["R"].bwt, example["S"].bwt, ra)) == spelled(both)
    assert "".join("RS"[r["from_coll"]] for r in merge.sources(both).orderBy("pos").collect()) == "RSRSSSRSRRSSRRSRRSSRSSRR"


ROWS = ["", "A", "AAAAAAAAAA", "ACGT", "ACGT", "CGT", "NTNT", "TTNN", "GATTACA", "GATTA"]


def test_random_collections(spark):
    rng = random.Random(5)
    for rows in (ROWS, ["".join(rng.choices("ACGTN", weights=(5, 2, 1, 2, 1), k=rng.randrange(0, 12))) for _ in range(30)]):
        want = brute(rows)
        for bwt in (transform.build(texts(spark, rows)), transform.build_long(texts(spark, rows))):
            assert [(r["c"], r["seq_id"], r["off"]) for r in bwt.orderBy("pos").collect()] == want
        ix = Index.of_texts(texts(spark, rows), block_size=7)
        symbols = [c for c, _, _ in want]
        n = len(symbols)
        asked = spark.createDataFrame([(i, c) for i in range(n + 2) for c in range(7)], "i long, c int")
        assert all(r["rank"] == symbols[: r["i"]].count(r["c"]) for r in ix.rank(asked).collect())
        assert all([r[f"r{k}"] for k in range(1, 6)] == [symbols[: r["i"]].count(k) for k in range(1, 6)] for r in ix.ranks(asked.select("i").distinct()).collect())
        places = {c: [i for i, x in enumerate(symbols) if x == c] for c in range(6)}
        picked = ix.select(spark.createDataFrame([(i, c) for c in range(6) for i in range(len(places[c]) + 2)], "i long, c int")).collect()
        assert all(r["pos"] == (0 if r["i"] == 0 else places[r["c"]][r["i"] - 1] if r["i"] <= len(places[r["c"]]) else n) for r in picked)
        assert all(r["c"] == (symbols[r["i"]] if r["i"] < n else 0) for r in ix.access(asked.select("i").distinct()).collect())
        ranges = spark.createDataFrame([(a, b) for a in range(n) for b in (a, a + 1, a + 9, n, n + 1)], "lo long, hi long")
        assert all(r["digits"] == ("".join(map(str, symbols[r["lo"] : r["hi"]])) if r["lo"] < r["hi"] <= n else None) for r in ix.extract(ranges).collect())
        lf = {r["pos"]: r["lf"] for r in ix.edges.where("c > 0").collect()}
        assert {r["psi"]: r["pos"] for r in ix.psi().collect()} == lf
        assert [r["s"] for r in invert.texts_of(ix.edges, ix.counts).orderBy("seq_id").collect()] == [digits(t) for t in rows]
        assert [(r["c"], r["len"]) for r in ix.runs().orderBy("start").collect()] == runs_of(symbols)
        assert sorted((r["start"], r["c"], r["len"]) for r in runs.coalesce_runs(ix.bwt.select(F.col("pos").alias("start"), "c", F.lit(1).cast("long").alias("len"))).collect()) == sorted((r["start"], r["c"], r["len"]) for r in ix.runs().collect())


def runs_of(symbols):
    out = []
    for c in symbols:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def test_merges_agree(spark):
    rng = random.Random(8)
    parts = [["".join(rng.choices("ACGT", k=rng.randrange(0, 9))) for _ in range(6)] for _ in range(3)]
    whole = spelled(transform.build(texts(spark, sum(parts, []))))
    assert spelled(merge.merge(*(texts(spark, p) for p in parts))) == whole
    ixs = [Index.of_texts(texts(spark, p)) for p in parts]
    assert spelled(merge.merge_indexes(ixs).bwt) == whole
    first = Index.of_bwt(merge.merge(*(texts(spark, p) for p in parts[:2])).select("pos", "c"))
    ra = merge.rank_array_of_indexes(first, ixs[2])
    assert spelled(merge.interleave(first.bwt, ixs[2].bwt, ra)) == whole


def test_long_patterns_and_texts(spark):
    """Whole texts and patterns far longer than a seed or a read, against plain search."""
    rng = random.Random(10)
    rows = ["".join(rng.choices("AC", k=700)), "ACGT" * 200, "A" * 500, "", "".join(rng.choices("ACGT", k=29_000))]
    asked = [rows[0][40:240], rows[0], rows[1][:101], "A" * 300, "ACGT" * 3, "C", "A" * 501, "GTAC" * 20 + "G", "GT", rows[4][9590:9630], rows[4][9580:19_300], rows[4][95:112]]
    p = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    got = {r["pattern_id"]: r["matches"] for r in search.in_texts(p, texts(spark, rows)).collect()}
    assert got == {k: sum(t.startswith(a, i) for t in rows for i in range(len(t))) for k, a in enumerate(asked)}


def test_content_hash_of_many_blocks(spark):
    rng = random.Random(14)
    symbols = [rng.randrange(6) for _ in range(5000)]
    bwt = spark.createDataFrame(list(enumerate(symbols)), "pos long, c int")
    h = 0xCBF29CE484222325
    for c in symbols:
        h = (h ^ c) * 0x100000001B3 % (1 << 64)
    blocks = runs.blocks_of(runs.pieces_of(bwt), 64)
    assert runs.content_hash(blocks) == h and runs.content_hash(blocks.limit(0)) == 0xCBF29CE484222325
    assert runs.hash_of(runs.content_map(blocks, 3)).first()[0] == f"{h:016x}"  # joined in many rounds


def test_locate(spark):
    rows = ["ACACA", "", "CACAC", "GGA"]
    ix = Index.of_texts(texts(spark, rows))
    p = spark.createDataFrame(list(enumerate(["ACA", "A", "T", "GGA"])), "pattern_id long, pattern string")
    places = invert.places_of(ix.edges, ix.counts)
    lengths = places.groupBy("seq_id").agg(F.max("back").alias("n"))
    got = sorted(map(tuple, invert.locate(ix.find(p), places, lengths).collect()))
    assert got == sorted((k, i, o) for k, a in enumerate(["ACA", "A", "T", "GGA"]) for i, t in enumerate(rows) for o in range(len(t)) if t.startswith(a, o))


def test_counts_from_texts(spark):
    rows = ["AAAA", "ACACA", "CACAC", ""]
    p = spark.createDataFrame(list(enumerate(["AA", "ACA", "G", "AAAAA", "C", "ACACA", ""])), "pattern_id long, pattern string")
    got = {r["pattern_id"]: r["matches"] for r in search.in_texts(p, texts(spark, rows)).collect()}
    assert got == {0: 3, 1: 3, 2: 0, 3: 0, 4: 5, 5: 1}
    ends = {r["pattern_id"]: (r["ends"], r["starts"], r["equals"]) for r in search.anchored(p, texts(spark, rows)).collect()}
    assert ends[0] == (1, 1, 0) and ends[5] == (1, 1, 1) and ends[4] == (1, 1, 0) and ends[6] == (4, 4, 1)


def test_alphabets(spark):
    row = spark.createDataFrame([("acgtnACGTN$\0xé",)], "t string")
    assert row.select(alphabet.encode(F.col("t"))).first()[0] == "12345123455555"
    assert row.select(alphabet.encode(F.col("t"), "sorted")).first()[0] == "12354123544444"
    assert row.select(alphabet.encode_pattern(F.col("t"))).first()[0] == "12345123450055"
    a = alphabet.of_counts(spark.createDataFrame([(1, 3), (4, 2)], "comp int, cnt long"))
    b = alphabet.of_counts(spark.createDataFrame([(1, 1)], "comp int, cnt long"), "sorted")
    assert (alphabet.identify(a), alphabet.identify(b), alphabet.is_sorted(a), alphabet.is_sorted(b)) == ("default", "sorted", False, True)
    assert not alphabet.compatible(a.withColumn("ch", F.lit("x")), "unknown")
    assert alphabet.compatible(a, "any") and alphabet.compatible(a, "default") and not alphabet.compatible(a, "sorted")
    rows = texts(spark, [R, S, "", "NNA"])
    assert sorted(map(tuple, alphabet.of_texts(rows).collect())) == sorted(map(tuple, alphabet.of_bwt(transform.build(rows)).collect()))
    with pytest.raises(ValueError):
        alphabet.merged(a, b)
    assert [r["cnt"] for r in alphabet.merged(a, a).orderBy("comp").collect()] == [0, 6, 0, 0, 4, 0]
    assert [(r["lo"], r["hi"]) for r in alphabet.char_ranges(a).orderBy("comp").collect()] == [(0, 0), (0, 3), (3, 3), (3, 3), (3, 5), (5, 5)]
    assert [r["present"] for r in alphabet.has_char(a).orderBy("comp").collect()] == [False, True, False, False, True, False]
    assert [r["comp"] for r in alphabet.find_char(spark.range(7).withColumnRenamed("id", "pos"), a).orderBy("pos").collect()] == [1, 1, 1, 4, 4]


def test_reads_hold_all_of_a_text(spark):
    t = spark.createDataFrame([(3, "1" * 250), (4, ""), (5, "2" * 101)], "seq_id long, s string")
    got = [(r["seq_id"], len(r["s"])) for r in transform.reads_of(t).orderBy("seq_id").collect()]
    assert got == [(3 << 20, 101), ((3 << 20) + 1, 101), ((3 << 20) + 2, 48), (4 << 20, 0), (5 << 20, 101)]


def test_order_helpers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r["k"] == r["pos"] for r in positions(df, ["k"], ["k"]).collect())
    sums = running(df, "k", {"s": F.col("k")}, 64).collect()
    assert all(r["s"] == r["k"] * (r["k"] - 1) // 2 for r in sums)


def test_empty_collection(spark):
    ix = Index.of_texts(texts(spark, []))
    assert ix.counts == [0] * 6 and ix.runs().count() == 0
    p = spark.createDataFrame([(0, "A"), (1, "")], "pattern_id long, pattern string")
    assert [r["matches"] for r in ix.count(p).orderBy("pattern_id").collect()] == [0, 0]
    assert spelled(merge.merge(texts(spark, []), texts(spark, [R]))) == "CGTCAGT$CACA"


def test_cumulative(spark):
    a = lookups.cumulative(spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "i long, v long"))
    assert [r["sum"] for r in a.orderBy("i").collect()] == [0, 2, 2]
    got = lookups.cumulative_inverse(spark.range(6).withColumnRenamed("id", "k"), a).orderBy("k").collect()
    assert [(r["i"], r["is_last"]) for r in got] == [(0, False), (0, True), (2, False), (2, False), (2, True)]
