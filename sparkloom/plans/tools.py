"""The tools: convert, inspect and merge files of transforms.

    python -m sparkloom.plans.tools convert [-i sga] [-o ropebwt] IN OUT
    python -m sparkloom.plans.tools inspect FILE...
    python -m sparkloom.plans.tools merge [-i TAG[,TAG...]] [-o TAG] [-v PATTERNS] [-t CORES] [-s PARTITIONS] [-d FOLDER] [-r MB] [-b MB] [-m N] IN1 IN2 [...] OUT
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as merging
from ..operators import runs as run_operators
from ..operators import search
from ..operators.index import Index
from ..sources import files
from ..sources.codecs import FORMATS
from .report import Meter, memory, path_bytes, table_bytes


@dataclass
class Parameters:
    """What a merge may be told, and what it means for Spark. Buffer sizes have no meaning here, as Spark sorts and spills by itself."""

    run_buffer_mb: int = 128
    thread_buffer_mb: int = 256
    merge_buffers: int = 6
    threads: int | None = None
    sequence_blocks: int | None = None
    temp_dir: str | None = None

    def settings(self) -> dict[str, str]:
        """Spark settings: cores, shuffle partitions (4 a core unless given) and local folder."""
        out = {}
        if self.threads:
            out["spark.master"] = f"local[{max(1, self.threads)}]"
        if self.sequence_blocks or self.threads:
            out["spark.sql.shuffle.partitions"] = str(max(1, self.sequence_blocks or 4 * self.threads))
        if self.temp_dir:
            out["spark.local.dir"] = self.temp_dir
        return out


def bounds(lo: int, hi: int, blocks: int) -> list[tuple[int, int]]:
    """Half-open ranges that split [lo, hi) nearly evenly, no more than there are elements."""
    n = max(0, hi - lo)
    blocks = max(1, min(blocks, n)) if n else 0
    cuts = [lo + n * k // blocks for k in range(blocks + 1)] if blocks else []
    return list(zip(cuts, cuts[1:]))


def load(spark: SparkSession, path: str, tag: str, meter: Meter | None = None, name: str = "read") -> tuple[Index, str]:
    """An index of a file; for the engine's own format, of a saved Index. A ``meter`` is told what the file holds."""
    meter = meter or Meter(spark)
    if tag == "parquet":
        with meter.stage(name) as made:
            index = Index.load(spark, path)
            told(made, index, path_bytes(spark, path))
        return index, index.order
    order = file_order(spark, path, tag)
    return Index.of_pieces(meter.written(files.read_pieces(spark, path, tag), name, path_bytes(spark, path)), order), order


def file_order(spark: SparkSession, path: str, tag: str) -> str:
    """The alphabet order of a file: its format's, or what its header says where the format holds any."""
    order = FORMATS[tag].order if tag in FORMATS else ""
    if order == "any":
        head = files.inspect(spark, path).first()
        order = head["alphabet"] if head["alphabet"] in ("default", "sorted") else "default"
    return order


def save(index: Index, path: str, tag: str, force: bool = False, meter: Meter | None = None) -> dict:
    """Write an index as a file of a format, or in the engine's own; a ``meter`` is told what was written."""
    spark = index.blocks.sparkSession
    with (meter or Meter(spark)).stage("write") as made:
        if tag == "parquet":
            index.save(path)
            told(made, index, path_bytes(spark, path))
            return {"sequences": made.sequences, "bases": made.bases, "bytes": made.bytes}
        done = files.write_runs(index.runs(), path, tag, index.order, force)
        made.runs, made.sequences, made.bases, made.bytes = done["runs"], done["sequences"], done["bases"], done["bytes"]
    return done


def told(stage, index: Index, size: int | None = None) -> None:
    """Put into a stage what an index holds: its runs are those of its blocks."""
    stage.sequences, stage.bases, stage.bytes = index.sequences, index.bases, size
    stage.runs = int(run_operators.storage(index.blocks).first()["runs"] or 0)


def described() -> Column:
    """One line on a row of ``files.inspect``: what the file is and what it holds."""
    held = F.concat(F.lit(": "), F.coalesce(F.col("sequences").cast("string"), F.lit("?")), F.lit(" sequences, "), F.coalesce(F.col("bases").cast("string"), F.lit("?")), F.lit(" bases"))
    return F.concat("format", F.when(F.col("bases").isNull(), F.lit("")).otherwise(held), F.coalesce(F.concat(F.lit(", "), "alphabet", F.lit(" alphabet")), F.lit("")))


def totals(headers: DataFrame) -> DataFrame:
    """(files, known, sequences, bases) over inspected files; what is not known adds nothing."""
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return headers.agg(F.count("*").alias("files"), F.count_if(~F.col("format").isin("unknown", "unreadable")).alias("known"), sum_of("sequences"), sum_of("bases"))


def convert(spark: SparkSession, source: str, target: str, source_tag: str = "sga", target_tag: str = "parquet", recode: bool = False) -> DataFrame:
    """Read one format and write another; returns the report of the stages. Orders of alphabets must agree unless ``recode``, which keeps characters and changes their codes."""
    meter = Meter(spark)
    if target_tag == "parquet":
        index, _ = load(spark, source, source_tag, meter)
        save(index, target, "parquet", meter=meter)
        return meter.report()
    order = file_order(spark, source, source_tag)
    want = FORMATS[target_tag].order if target_tag in FORMATS else order
    with meter.stage("read") as made:
        found, told_of = files.read_told(spark, source, source_tag)
        made.sequences, made.bases, made.runs, made.bytes = told_of["sequences"], told_of["bases"], told_of["runs"], path_bytes(spark, source)
    was, order = order, want if recode and want != "any" else order
    with meter.stage("runs") as made:
        held = files.packed(found)
        made.sequences, made.bases, made.runs = held.agg(F.sum("sequences"), F.sum("bases"), F.sum("runs")).first()
        made.bytes = table_bytes(held)
    with meter.stage("write") as made:
        done = files.write_packed(held, target, target_tag, order, source=was)
        made.sequences, made.bases, made.bytes, made.runs = done["sequences"], done["bases"], done["bytes"], done["runs"]
    return meter.report()


def merge(spark: SparkSession, sources: list[str], target: str, tags: list[str], target_tag: str = "parquet", patterns: str | None = None, meter: Meter | None = None) -> DataFrame | None:
    """Merge files in the order given; with ``patterns``, return how their counts compare before and after. A ``meter`` is told of every stage."""
    tags = tags * len(sources) if len(tags) == 1 else tags
    if len(tags) != len(sources):
        raise ValueError("give one format, or one for each input")
    meter = meter or Meter(spark)
    parts = [load(spark, path, tag, meter, f"read {k}") for k, (path, tag) in enumerate(zip(sources, tags))]
    if len({order for _, order in parts}) != 1:
        raise ValueError("the inputs' alphabets differ")
    with meter.stage("merge") as made:
        whole = merging.merge_indexes([p for p, _ in parts])
        told(made, whole)
    save(whole, target, target_tag, meter=meter)
    return merging.verify(search.read_patterns(spark, patterns), [p for p, _ in parts], whole) if patterns else None


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    tools = parser.add_subparsers(dest="tool", required=True)
    one = tools.add_parser("convert")
    one.add_argument("-i", default="sga"), one.add_argument("-o", default="parquet"), one.add_argument("paths", nargs=2)
    two = tools.add_parser("inspect")
    two.add_argument("paths", nargs="+")
    three = tools.add_parser("merge")
    three.add_argument("-i", default="sga"), three.add_argument("-o", default="parquet"), three.add_argument("-v"), three.add_argument("paths", nargs="+")
    three.add_argument("-t", type=int), three.add_argument("-s", type=int), three.add_argument("-d")
    three.add_argument("-r", type=int, default=128), three.add_argument("-b", type=int, default=256), three.add_argument("-m", type=int, default=6)
    a = parser.parse_args(arguments)
    told = Parameters(a.r, a.b, a.m, a.t, a.s, a.d).settings() if a.tool == "merge" else {}
    spark = SparkSession.builder.config(map=told).getOrCreate()
    if a.tool == "convert":
        convert(spark, *a.paths, a.i, a.o).show(truncate=False)
        memory(spark).show(truncate=False)
    elif a.tool == "inspect":
        found = files.inspect(spark, *a.paths)
        found.select("*", described().alias("report")).show(truncate=False)
        totals(found).show()
    else:
        meter = Meter(spark)
        checked = merge(spark, a.paths[:-1], a.paths[-1], a.i.split(","), a.o, a.v, meter)
        meter.report().show(truncate=False)
        memory(spark).show(truncate=False)
        if checked is not None:
            checked.agg(F.count("*").alias("patterns"), F.count_if(~F.col("same")).alias("mismatches")).show()


if __name__ == "__main__":
    main()
