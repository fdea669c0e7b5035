"""Incremental indexing of a stream of texts, in levels.

Every micro-batch becomes an index of its own, later than all before it. Whenever FAN neighbours have the same level they
are merged, without sorting again, into one of the next level, so there are few parts and a text is merged as often as the
logarithm of the stream's length. Which parts count is said by a manifest, written whole under a new name: a batch is in it or is not.
Counts over the whole stream are sums over the parts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as merging
from ..operators import search
from ..operators.index import Index
from ..plans.shared import forget, materialize

#: Parts of one level that become one of the next.
FAN = 4


def _fs(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict:
    """{"version", "batch", "parts": [{"name", "level"}]}: the newest manifest; the empty one before there is any."""
    root, fs = _fs(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("manifest-")) if fs.exists(root) else []
    if not names:
        return {"version": 0, "batch": -1, "parts": []}
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/{names[-1]}").collect()))


def _publish(spark: SparkSession, path: str, state: dict) -> None:
    """Write a manifest under a name that is not there yet: first elsewhere, then renamed, so it is whole or not there."""
    target, fs = _fs(spark, f"{path}/manifest-{state['version']:012d}")
    draft, _ = _fs(spark, f"{path}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not fs.rename(draft, target):
        raise RuntimeError(f"{target.toString()} is there already: two writers share the folder")


def add(spark: SparkSession, path: str, texts: DataFrame, batch: int, order: str = "default", fan: int = FAN) -> None:
    """Index texts(seq_id, s) as batch number ``batch`` under ``path``; a batch that the manifest has is left alone, so each text is indexed once."""
    state = manifest(spark, path)
    if batch <= state["batch"]:
        return
    kept = materialize(texts.select("seq_id", "s"), "batch")
    parts = [*state["parts"], _save(path, Index.of_texts(kept, order), 0)]
    forget(kept)
    while len(parts) >= fan and len({p["level"] for p in parts[-fan:]}) == 1:
        held = [Index.load(spark, f"{path}/{p['name']}") for p in parts[-fan:]]
        parts[-fan:] = [_save(path, merging.merge_indexes(held), parts[-1]["level"] + 1)]
    _publish(spark, path, {"version": state["version"] + 1, "batch": batch, "parts": parts})
    _sweep(spark, path, {p["name"] for p in [*parts, *state["parts"]]})


def _save(path: str, index: Index, level: int) -> dict:
    name = f"part-{uuid.uuid4().hex}"
    index.save(f"{path}/{name}")
    return {"name": name, "level": level}


def _sweep(spark: SparkSession, path: str, named: set[str]) -> None:
    """Delete parts that neither the newest manifest nor the one before it names, so readers of either find theirs."""
    root, fs = _fs(spark, path)
    for s in fs.listStatus(root):
        if s.getPath().getName().startswith("part-") and s.getPath().getName() not in named:
            fs.delete(s.getPath(), True)


def index_stream(texts: DataFrame, path: str, checkpoint: str, order: str = "default", fan: int = FAN):
    """Start a query that adds each micro-batch of a streaming texts(seq_id, s) to the parts under ``path``."""
    return texts.writeStream.foreachBatch(lambda batch, number: add(batch.sparkSession, path, batch, number, order, fan)).option("checkpointLocation", checkpoint).start()


def parts(spark: SparkSession, path: str) -> list[Index]:
    """The indexes of the parts, in the order of the stream."""
    return [Index.load(spark, f"{path}/{p['name']}") for p in manifest(spark, path)["parts"]]


def count(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """(pattern_id, matches) over all parts."""
    none = patterns.select("pattern_id", F.lit(0).cast("long").alias("matches"))
    each = [search.counts(p.find(patterns)).select("pattern_id", "matches") for p in parts(spark, path)]
    return reduce(DataFrame.unionByName, each, none).groupBy("pattern_id").agg(F.sum("matches").alias("matches"))


def compact(spark: SparkSession, path: str) -> Index:
    """Merge all parts into one, which the manifest then names alone, and return it. Nothing is sorted again."""
    state = manifest(spark, path)
    held = parts(spark, path)
    if len(held) < 2:
        return held[0]
    level = 1 + max(p["level"] for p in state["parts"])
    made = [_save(path, merging.merge_indexes(held), level)]
    _publish(spark, path, {"version": state["version"] + 1, "batch": state["batch"], "parts": made})
    return parts(spark, path)[0]
