"""Reports of jobs: what each stage wrote, observed while it was written, how long that took, and the peak memory of executors."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

#: What is counted of runs(start, c, len).
COUNTS = {
    "sequences": "sum(if(c = 0, len, 0))",
    "bases": "sum(len)",
    "runs": "count(*)",
}
STAGES = "stage string, sequences long, bases long, runs long, bytes long, seconds double"


@dataclass
class Stage:
    """A stage of a job and what is known of it; what is not stays null."""

    name: str
    sequences: int | None = None
    bases: int | None = None
    runs: int | None = None
    bytes: int | None = None
    seconds: float | None = None


@dataclass
class Meter:
    """The stages of a job in the order in which they ran."""

    spark: SparkSession
    stages: list[Stage] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str):
        """Time what is done inside; the stage's figures may be set there."""
        made = Stage(name)
        began = time.perf_counter()
        yield made
        made.seconds = time.perf_counter() - began
        self.stages.append(made)

    def written(self, runs: DataFrame, name: str, size: int | None = None) -> DataFrame:
        """Write runs(start, c, len) once to the shared folder and count them on the way; ``size``: the bytes that the stage is about, else those written.

        The counts are taken above the last shuffle, in the tasks that write, of which Spark counts each once however often it runs.
        """
        with self.stage(name) as made:
            seen = Observation()
            table = materialize(runs.observe(seen, *(F.expr(sql).alias(n) for n, sql in COUNTS.items())), "stage")
            for n in COUNTS:
                setattr(made, n, int(seen.get[n] or 0))
            made.bytes = size if size is not None else table_bytes(table)
        return table

    def report(self) -> DataFrame:
        """(stage, sequences, bases, runs, bytes, seconds, bpc, rate), a row for each stage: bpc are bits a character, rate characters a second."""
        rows = [(s.name, s.sequences, s.bases, s.runs, s.bytes, s.seconds) for s in self.stages]
        each = self.spark.createDataFrame(rows, STAGES)
        return each.withColumn("bpc", F.try_divide(8.0 * F.col("bytes"), F.col("bases"))).withColumn("rate", F.try_divide(F.col("bases").cast("double"), F.col("seconds")))


def path_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files below a folder."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(name).getLength())


def table_bytes(table: DataFrame) -> int:
    """The bytes of the files that a written table reads."""
    return sum(path_bytes(table.sparkSession, folder) for folder in {f.rpartition("/")[0] for f in table.inputFiles()})


def memory(spark: SparkSession) -> DataFrame:
    """(executor, heap, offheap): the most memory in bytes that each executor, and the driver, has used so far, as Spark's own status store has it; null before the first heartbeat."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    rows = []
    for k in range(every.size()):
        peak = every.apply(k).peakMemoryMetrics()
        figures = [int(peak.get().getMetricValue(m)) for m in ("JVMHeapMemory", "JVMOffHeapMemory")] if peak.isDefined() else [None, None]
        rows.append((every.apply(k).id(), *figures))
    return spark.createDataFrame(rows, "executor string, heap long, offheap long")
