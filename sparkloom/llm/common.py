"""What the training-data operators share: tables of a scale folder, and new columns computed in Arrow."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import forget, materialize, shared_dir

__all__ = ["append_columns", "forget", "join_heavy", "materialize", "packed", "shared_dir", "slices", "table", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a scale folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(key, make: Callable):
    """What ``make`` returned for ``key`` in this Python worker before, else what it returns now.

    Spark reuses workers, so what is costly to build need not be built for each task.
    """
    kept = sys.modules.setdefault("sparkloom_worker_cache", types.ModuleType("sparkloom_worker_cache")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def join_heavy(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key and says in ``weight`` how many rows of ``left`` have it.

    Keys with at least one in ``share`` of all rows are at most ``share``; they are broadcast, so
    their rows stay where they are. The rest meet in a shuffle, in which no key is heavy; rows that are done are spread by the
    partition they come from, which a task that is run again repeats.
    ``right`` is read three times, so it should be a written table. Keys without a row in ``right`` drop out, null keys too.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * share >= total
    one = right.where(heavy).select(key, F.struct(*values).alias("_one"))
    two = right.where(~heavy).select(key, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_two"))
    met = left.join(F.broadcast(one), key, "left").withColumn("_salt", F.when(F.col("_one").isNotNull(), 1 + F.spark_partition_id()).otherwise(0).cast("long"))
    found = F.coalesce("_one", "_two")
    return met.join(two, [key, "_salt"], "left").where(found.isNotNull()).select(*left.columns, *(found[v].alias(v) for v in values))


def packed(df: DataFrame, text: str) -> tuple[DataFrame, list]:
    """(row, text) of ``df``, all other columns in ``row``, so that no name of theirs can clash; and the columns that give ``df`` back."""
    others = [c for c in df.columns if c != text]
    rows = df.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("row"), F.col(text).alias("text"))
    return rows, [F.col("text").alias(c) if c == text else F.col("row")[f"c{others.index(c)}"].alias(c) for c in df.columns]


def append_columns(df: DataFrame, fields: T.StructType, make: Callable, size_of: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """``df`` with the columns ``fields``, which ``make`` computes in Arrow; columns of ``df`` with these names are replaced.

    ``make()`` is called once a task and returns a function from a record batch
    to one Arrow array per field. Batches are cut so that the column
    ``size_of`` holds about ``slice_bytes`` in each (one row at least), which
    bounds the memory of a worker however long single texts are.
    """
    base = df.drop(*fields.names)
    names = base.columns
    if any("." in c for c in names):  # Arrow functions cannot name these
        plain = [f"_{k}_{c.replace('.', '_')}" if "." in c else c for k, c in enumerate(names)]
        return append_columns(base.toDF(*plain), fields, make, size_of, slice_bytes).toDF(*names, *fields.names)
    out = T.StructType([*base.schema.fields, *fields.fields])

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, size_of, slice_bytes):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(part.num_columns)), *work(part)], names=[*part.schema.names, *fields.names])

    return base.mapInArrow(run, out)


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Row ranges of ``batch`` whose ``column`` holds about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))) if not pa.types.is_list(batch.schema.field(column).type) else pc.multiply(pc.list_value_length(batch.column(batch.schema.names.index(column))), 4), 0)
    cell = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
