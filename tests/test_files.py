"""Byte layouts, round trips through the formats, and the tools."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import transform
from sparkloom.operators.index import Index
from sparkloom.plans import report, tools
from sparkloom.sources import codecs, files
from sparkloom.streaming import incremental
from tests.test_index import R, S, spelled, texts

GOLDEN = {
    "sga": "caca020000000000000018000000000000000c0000000000000000000000426283422262810241244221",
    "ropebwt": "524c450612131c1211130c100a211209",
    "rfm": "c000000000000000020203030505050202010103030500000201010101020201",
}


@pytest.fixture(scope="module")
def example(spark):
    return Index.of_texts(texts(spark, [R, S]))


@pytest.mark.parametrize("tag", ["sga", "ropebwt", "rfm", "sdsl", "plain_default", "plain_sorted"])
def test_round_trip(spark, example, tag, tmp_path):
    path, runs = str(tmp_path / "x"), files.recode(example.runs(), "default", codecs.FORMATS[tag].order)
    files.write_runs(runs, path, tag, codecs.FORMATS[tag].order)
    data = (tmp_path / "x").read_bytes()
    if tag in GOLDEN:
        assert data.hex() == GOLDEN[tag]
    else:
        assert data == (bytes.fromhex("c000000000000000") if tag == "sdsl" else b"") + b"CCGGTTTCCAAGGT$$CAAAACCA"
    assert files.sizes(runs).where(F.col("tag") == tag).first()["bytes"] == len(data)
    back = files.read_runs(spark, path, tag)
    assert sorted(map(tuple, back.select("start", "c", "len").collect())) == sorted(map(tuple, runs.select("start", "c", "len").collect()))


def test_native_code():
    for length, want in ((1, "01"), (41, "f1"), (42, "f700"), (43, "f701"), (169, "f77f"), (170, "f78001"), (16553, "f7ff8001"), (16554, "f7808101")):
        assert codecs.encode_native([(1, length)]).hex() == want
    assert codecs.encode_native([(1, 500)], 62).hex() == "f77ff7a102" and codecs.encode_native([(1, 500)], 63).hex() == "f1f7a103"
    assert [x.tolist() for x in codecs.decode_native(bytes.fromhex("f78101"))] == [[1], [42 + 129]] and not len(codecs.decode_native(b"")[0])
    runs = [(k % 6, 1 + k * k % 70_000) for k in range(500)]
    symbols, lengths = codecs.decode_native(codecs.encode_native(runs))
    total = [0] * 6
    for c, n in zip(symbols, lengths):
        total[c] += n
    assert total == [sum(n for c, n in runs if c == k) for k in range(6)]


def test_native_file(spark, example, tmp_path):
    runs = [(r["c"], r["len"]) for r in example.runs().orderBy("start").collect()]
    data = codecs.encode_native(runs)
    assert data.hex() == "080910080709040602130801"
    head = b"!BWT" + (0).to_bytes(4, "little") + (2).to_bytes(8, "little") + (24).to_bytes(8, "little")
    (tmp_path / "n").write_bytes(head + len(data).to_bytes(8, "little") + data + bytes(1000))
    back = files.read_runs(spark, str(tmp_path / "n"), "native").orderBy("start").collect()
    assert [(r["c"], r["len"]) for r in back] == runs
    row = files.inspect(spark, str(tmp_path / "n")).first()
    assert (row["format"], row["sequences"], row["bases"], row["alphabet"]) == ("native", 2, 24, "default")


def test_long_runs_are_split():
    for n, want in ((31, [31]), (32, [31, 1]), (62, [31, 31]), (63, [31, 31, 1])):
        data = codecs.encode("sga", np.array([1]), np.array([n]))
        assert [b & 31 for b in data] == want and {b >> 5 for b in data} == {1}


def test_inspect_unknown(spark, tmp_path):
    for name, data in (("empty", b""), ("short", b"!BWT"), ("foreign", b"hello, this is a longer text file of no format"), ("rope", b"RLE\x06\x12")):
        (tmp_path / name).write_bytes(data)
    more = files.inspect(spark, str(tmp_path / "gone"), str(tmp_path / "rope"))
    assert {r["format"] for r in more.collect()} == {"unreadable", "ropebwt"} and files.inspect(spark, str(tmp_path / "gone")).first()["format"] == "unreadable"
    assert tuple(tools.totals(more).first()) == (2, 1, 0, 0)
    got = {r["path"].rpartition("/")[2]: r["format"] for r in files.inspect(spark, *(str(tmp_path / n) for n in ("empty", "short", "foreign", "rope"))).collect()}
    assert got == {"empty": "unknown", "short": "unknown", "foreign": "unknown", "rope": "ropebwt"}


def test_bad_files(spark, example, tmp_path):
    with pytest.raises(ValueError):
        files.read_runs(spark, "x", "nope")
    with pytest.raises(ValueError):
        files.write_runs(example.runs(), str(tmp_path / "y"), "rfm", "default")
    with pytest.raises(ValueError):
        codecs.decode("ropebwt", bytes([0x0F]))


def test_tools(spark, tmp_path):
    paths = []
    for name, rows in (("a", [R]), ("b", [S])):
        ix = Index.of_texts(texts(spark, rows))
        tools.save(ix, str(tmp_path / name), "sga")
        paths.append(str(tmp_path / name))
    (tmp_path / "p").write_text("AG\n\nCTA\r\nTCG\n")
    checked = tools.merge(spark, paths, str(tmp_path / "m"), ["sga"], "parquet", str(tmp_path / "p"))
    assert sorted((r["in_whole"], r["same"]) for r in checked.collect()) == [(1, True), (2, True), (3, True)]
    tools.main(["merge", "-t", "2", "-s", "4", "-d", "/tmp", "-r", "64", "-b", "64", "-m", "5", *paths, str(tmp_path / "m2")])
    assert spelled(Index.load(spark, str(tmp_path / "m2")).bwt) == "CCGGTTTCCAAGGT$$CAAAACCA"
    tools.main(["inspect", *paths, str(tmp_path / "none")])
    assert [r[0] for r in files.inspect(spark, paths[0]).select(tools.described()).collect()] == ["sga: 1 sequences, 12 bases, default alphabet"]
    merged = Index.load(spark, str(tmp_path / "m"))
    assert spelled(merged.bwt) == "CCGGTTTCCAAGGT$$CAAAACCA"
    done = {r["stage"]: r for r in tools.convert(spark, paths[0], str(tmp_path / "c"), "sga", "plain_default").collect()}
    assert done["write"]["bytes"] == 12 and done["write"]["bpc"] == 8 and done["read"]["bytes"] == 30 + done["read"]["runs"] and (tmp_path / "c").read_bytes() == b"CGTCAGT$CACA"
    tools.convert(spark, paths[0], str(tmp_path / "s"), "sga", "plain_sorted", recode=True)
    assert (tmp_path / "s").read_bytes() == b"CGTCAGT$CACA"
    assert tools.bounds(0, 10, 3) == [(0, 3), (3, 6), (6, 10)] and tools.bounds(0, 2, 5) == [(0, 1), (1, 2)] and tools.bounds(3, 3, 2) == []


def test_reports(spark, tmp_path):
    runs, paths = Index.of_texts(texts(spark, ["AC", "A"])).runs(), [str(tmp_path / n) for n in ("a", "b")]
    for path in paths:
        files.write_runs(runs, path, "ropebwt")
    meter = report.Meter(spark)
    tools.merge(spark, paths, str(tmp_path / "m"), ["ropebwt"], "parquet", meter=meter)
    got = {r["stage"]: r for r in meter.report().collect()}
    assert list(got) == ["read 0", "read 1", "merge", "write"]
    whole = Index.load(spark, str(tmp_path / "m"))
    assert [(got[s]["sequences"], got[s]["bases"]) for s in got] == [(2, 5), (2, 5), (4, 10), (4, 10)]
    assert got["read 0"]["bytes"] == (tmp_path / "a").stat().st_size == 4 + got["read 0"]["runs"] and got["merge"]["bytes"] is None
    assert got["write"]["bytes"] == sum(f.stat().st_size for f in (tmp_path / "m").rglob("*") if f.is_file() and f.suffix != ".crc" and not f.name.startswith(".")) > 0
    assert got["write"]["runs"] == whole.runs().count()  # all in one block
    assert all(r["seconds"] > 0 and r["rate"] == r["bases"] / r["seconds"] for r in got.values())
    assert all(r["bpc"] == 8 * r["bytes"] / r["bases"] for r in got.values() if r["bytes"] is not None)
    again = report.Meter(spark)
    tools.load(spark, str(tmp_path / "m"), "parquet", again)
    assert again.report().first()["bytes"] == got["write"]["bytes"]


def test_meter_of_any_runs(spark):
    meter = report.Meter(spark)
    rows = [(k, k % 6, 1 + k % 50) for k in range(5_000)]
    meter.written(spark.createDataFrame(rows, "start long, c int, len long").repartition(7).sort("start"), "many")
    empty = meter.written(spark.createDataFrame([], "start long, c int, len long"), "none")
    assert not empty.count()
    many, none = meter.report().collect()
    assert (many["sequences"], many["bases"], many["runs"]) == (sum(n for _, c, n in rows if c == 0), sum(n for _, _, n in rows), 5_000)
    assert (none["sequences"], none["bases"], none["runs"], none["bpc"]) == (0, 0, 0, None)
    peaks = report.memory(spark).collect()
    assert "driver" in {r["executor"] for r in peaks} and all(r["heap"] is None or r["heap"] >= 0 for r in peaks)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    for k, row in enumerate((R, S)):
        texts(spark, [row]).withColumn("seq_id", F.lit(k).cast("long")).coalesce(1).write.mode("append").parquet(str(source))
        query = incremental.index_stream(spark.readStream.schema("seq_id long, s string").parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()
    p = spark.createDataFrame([(0, "AG"), (1, "CTA")], "pattern_id long, pattern string")
    assert {r["pattern_id"]: r["matches"] for r in incremental.count(spark, str(tmp_path / "out"), p).collect()} == {0: 3, 1: 2}
    assert spelled(incremental.compact(spark, str(tmp_path / "out")).bwt) == spelled(transform.build(texts(spark, [R, S])))
