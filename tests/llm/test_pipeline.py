"""The pipeline against a plain version of its stages on a small corpus."""

import hashlib
import random
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe
from sparkloom.llm.common import materialize
from tests.llm.test_text_operators import brute_components, brute_fingerprint, brute_overlap, brute_spans


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(20)) for k in range(3)]
    rows = [(i, text(80)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200 + k, text(30) + " " + t + " " + text(30)) for k, t in items]
    rows += [(300, "the password=abcdef123456 " + text(50)), (301, None), (302, "")]
    toxic = [(400 + k, "you idiot scum moron " + text(76)) for k in range(60)]
    labels = [(i, 0) for i, _ in rows[:40]] + [(i, 1) for i, _ in toxic]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = rows  # toxic documents go
    roots = brute_components([brute_fingerprint(t) for _, t in kept], 3)
    first = {}
    for (i, _), r in zip(kept, roots):
        first[r] = min(first.get(r, i), i)
    kept = [(i, t) for (i, t), r in zip(kept, roots) if first[r] == i]
    kept = [(i, t) for i, t in kept if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute_overlap(t, items, 13))]
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in kept:
        t = t or ""
        for span in reversed([s for s in brute_spans(t).split(",") if s]):
            _, a, b = re.split(":", span)
            t = t[: int(a)] + corpus_pipeline.BLOT + t[int(b) :]
        want[i] = (len(oracle.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
    assert {i: (r["n_tokens"], r["decoded_sha256"]) for i, r in got.items()} == want
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_survivor_is_defined(spark):
    """Of a group the smallest id stays, nulls last; of one id with several texts each group's own; of equal rows one."""
    a, b = "alpha beta gamma delta epsilon", "one two three four five six"
    rows = [(7, a), (3, a), (None, a), (3, a), (3, b), (None, b), (None, "only null id here"), (None, "only null id here"), (9, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, a), (3, b), (None, "only null id here"), (8, "")], key=str)
    assert corpus_pipeline.keep_one_of_each(spark, docs, "").columns == docs.columns


def test_columns_of_the_user_come_back(spark, tmp_path):
    """Columns with names that stages use themselves, and with dots, hold after every stage what they held before."""
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some words of a test that nobody else has ever written down before now ok")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["_hash", "hash", "spans", "score", "predicted", "n_hit", "n_words", "item_ids", "row", "name", "fingerprint", "none", "c0", "held", "a.b", "doc_id.x"]
    docs = spark.createDataFrame([(k, f"text number {k} token=abcdefgh{k}", "en", "s", 7) for k in range(6)], COLUMNS)
    docs = docs.select("*", *((F.col("doc_id") * 100 + i).alias(n) for i, n in enumerate(names)))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns, name
        rows = now.collect()
        assert rows and all([r[n] for n in names] == [r["doc_id"] * 100 + i for i, n in enumerate(names)] for r in rows), name
    assert all(r["text"].endswith("[secret]") and r["n_chars"] == len(r["text"]) for r in rows)
    assert "n_chars" not in corpus_pipeline.blot_secrets(spark, docs.drop("n_chars"), "").columns


def test_stages_take_any_rows(spark, tmp_path):
    """Null ids, repeated rows, very long texts, empty tables and more columns pass through every stage."""
    spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some words of a test that nobody else has ever written down before now ok"), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, None), (None, "a"), (1, "token=abcdefgh " * 4000 + "é"), (1, "token=abcdefgh " * 4000 + "é"), (2, ""), (3, "w " * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    for table in (docs, docs.limit(0), docs.withColumns({c: F.lit(1) for c in ("score", "spans", "row", "fingerprint", "n_hit")})):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, str(tmp_path)), name)
            assert now.columns == table.columns and now.count() <= table.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()
