"""Tables written to the folder that all executors share, which cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where the setting is unset, a temporary folder serves in local mode only;
    on a cluster that is an error, as executors could not read each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="sparkloom-")
    return _local["dir"]


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As ``materialize``, and how many rows were written, observed on the way."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return written, int(seen.get["rows"])


def laid_out(df: DataFrame, key: str | list[str], name: str, path: str | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` once in buckets of ``key``, one column or all of a list, and read it back as a table that knows them.

    A join on just these columns then moves the other side only. There are as many buckets as the session has shuffle partitions, so
    neither side of such a join is dealt out again for more parallelism. ``dealt`` says that each task has whole buckets already, so that nothing moves.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"sparkloom_{name}_{uuid.uuid4().hex}"
    where = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keys = [key] if isinstance(key, str) else key
    rows = df if dealt else df.repartition(n, *keys).sortWithinPartitions(*keys)
    rows.write.bucketBy(n, keys).sortBy(keys).format("parquet").option("path", where).option("compression", "zstd").mode("overwrite").saveAsTable(table)
    return spark.table(table)


def opened(spark: SparkSession, path: str, key: str, name: str, buckets: int, schema: str) -> DataFrame:
    """A table that ``laid_out`` wrote to ``path``, also in another session."""
    table = f"sparkloom_{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes a plan reads, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
