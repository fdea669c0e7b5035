"""An index of a collection: the tables that the lookups and searches read, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as alphabets
from ..plans.shared import forget, laid_out, opened
from . import invert, lookups, runs, search, spelled, transform


@dataclass(frozen=True)
class Index:
    """The blocks of runs of a transform, in buckets of their numbers, and the six symbol counts; ``order`` names the alphabet.

    Nothing else is kept but what is asked for: the select directory, the maximal runs and the sampled places are made at first use.
    """

    blocks: DataFrame
    counts: list[int]
    order: str = "default"
    block_size: int = runs.SAMPLE
    _kept: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of_pieces(cls, pieces: DataFrame, order: str = "default", block_size: int = runs.SAMPLE, path: str | None = None) -> "Index":
        """Index a transform that is given as runs, maximal or in pieces(start, c, len)."""
        blocks = laid_out(runs.blocks_of(pieces, block_size), "blk", "blocks", path)
        return cls(blocks, _counts(blocks), order, block_size)

    @classmethod
    def of_bwt(cls, bwt: DataFrame, order: str = "default", block_size: int = runs.SAMPLE) -> "Index":
        """Index a transform bwt(pos, c), which is read once."""
        return cls.of_pieces(runs.pieces_of(bwt, block_size), order, block_size)

    @classmethod
    def of_texts(cls, texts: DataFrame, order: str = "default", block_size: int = runs.SAMPLE, places: int = 0) -> "Index":
        """Index texts(seq_id, s), which may be of several collections, ``coll``; with ``places``, also keep where every so many symbols of a text stand in the index, for ``locate``."""
        if not places and block_size <= spelled.FRAGMENT:  # nothing but symbols is asked for
            held = spelled.spelled(texts, block_size)
            blocks = laid_out(runs.blocks_of_spelled(held, block_size), "blk", "blocks", dealt=True)
            forget(held)
            return cls(blocks, _counts(blocks), order, block_size)
        bwt = transform.build(texts)
        made = cls.of_bwt(bwt, order, block_size)
        if places:
            size = invert.chunk_size(block_size)
            made._kept["starts", places] = invert.starts(bwt, made.sequences, places, size), size
            made._kept["places", places] = laid_out(invert.sampled(bwt, places), "pos", "places")
        forget(bwt)
        return made

    @property
    def sequences(self) -> int:
        return self.counts[0]

    @property
    def bases(self) -> int:
        """Positions, end markers included."""
        return sum(self.counts)

    @property
    def bwt(self) -> DataFrame:
        """bwt(pos, c), spelled out of the runs."""
        return runs.expand_blocks(self.blocks)

    @property
    def alphabet(self) -> DataFrame:
        return alphabets.of_counts(self.blocks.sparkSession.createDataFrame(list(enumerate(self.counts)), "comp int, cnt long"), self.order)

    @property
    def edges(self) -> DataFrame:
        """lf(pos, c, r, lf) of every position, from the blocks as they lie."""
        return lookups.edges(self.blocks, self.counts)

    @property
    def directory(self) -> DataFrame:
        """The select directory, in buckets of its cells."""
        return self._once("directory", lambda: laid_out(lookups.directory(self.blocks, self.counts), "cell", "directory"))

    def places(self, step: int = 32) -> DataFrame:
        """(pos, seq_id, off): every ``step``-th symbol of each text; texts are those that the index was made of, or numbered in their order where it was made without them."""
        return self._once(("places", step), lambda: laid_out(invert.sampled_without_texts(self, step), "pos", "places"))

    def starts(self, step: int = 32) -> tuple[DataFrame, int] | None:
        """The sampled places and the texts' ends, packed by chunks of so many positions; None where no places were kept when the index was made of texts."""
        return self._kept.get(("starts", step))

    def _once(self, name, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def rank(self, at: DataFrame, **names) -> DataFrame:
        return lookups.rank(at, self.blocks, self.counts, size=self.block_size, **names)

    def ranks(self, at: DataFrame, **names) -> DataFrame:
        return lookups.ranks(at, self.blocks, self.counts, size=self.block_size, **names)

    def select(self, at: DataFrame, **names) -> DataFrame:
        return lookups.select(at, self.directory, self.blocks, self.counts, size=self.block_size, **names)

    def inverse_select(self, at: DataFrame, **names) -> DataFrame:
        return lookups.inverse_select(at, self.blocks, self.counts, size=self.block_size, **names)

    def access(self, at: DataFrame, **names) -> DataFrame:
        return lookups.access(at, self.blocks, self.counts, size=self.block_size, **names)

    def extract(self, ranges: DataFrame, **names) -> DataFrame:
        return lookups.extract(ranges, self.blocks, self.counts, size=self.block_size, **names)

    def lf(self, at: DataFrame, **names) -> DataFrame:
        return lookups.lf(at, self.blocks, self.counts, size=self.block_size, **names)

    def psi(self) -> DataFrame:
        return lookups.psi(self.edges)

    def runs(self) -> DataFrame:
        """Maximal runs(run_id, start, c, len)."""
        return self._once("runs", lambda: runs.runs_of_blocks(self.blocks))

    def find(self, patterns: DataFrame) -> DataFrame:
        return search.find(patterns, self.blocks, self.counts, self.order, self.block_size)

    def count(self, patterns: DataFrame) -> DataFrame:
        return search.counts(self.find(patterns))

    def locate(self, patterns: DataFrame, step: int = 32) -> DataFrame:
        """(pattern_id, seq_id, off): every place of every pattern, by at most ``step`` steps back from each occurrence."""
        return invert.located(self.find(patterns), self, step)

    def views(self, name: str) -> None:
        """Temporary views of the index for SQL: name_bwt, name_runs, name_blocks and name_alphabet, and the functions name_rank(c, i), name_symbol(i) over them."""
        from ..plans import sql

        sql.register(self, name)

    def save(self, path: str) -> None:
        """The engine's own format: blocks in buckets, and counts, as Parquet."""
        spark: SparkSession = self.blocks.sparkSession
        laid_out(self.blocks, "blk", "blocks", f"{path}/blocks")
        meta = [(self.order, self.block_size, self.counts, int(spark.conf.get("spark.sql.shuffle.partitions")))]
        spark.createDataFrame(meta, "order string, block_size int, counts array<long>, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Index":
        meta = spark.read.parquet(f"{path}/meta").first()
        blocks = opened(spark, f"{path}/blocks", "blk", "blocks", meta["buckets"], runs.BLOCKS)
        return cls(blocks, list(meta["counts"]), meta["order"], meta["block_size"])


def _counts(blocks: DataFrame) -> list[int]:
    """The six counts: those before the last block, and those in it."""
    last = blocks.agg(F.max("blk")).first()[0]  # reads that column only
    row = None if last is None else blocks.where(F.col("blk") == last).select(*(F.expr(f"n{k} + " + lookups.counted("length(sym)", repr(str(k)))) for k in range(alphabets.SIGMA))).first()
    return list(row) if row else [0] * alphabets.SIGMA
