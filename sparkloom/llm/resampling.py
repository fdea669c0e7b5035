"""Importance resampling towards a target distribution, over hashed n-grams of words.

Texts are read as the bytes of Arrow's own UTF-8 buffers. A lookup table classifies every byte,
differences of neighbours give the words' bounds, and a table-driven CRC-32 advances by
one byte for all words of a buffer at the same time. The register behind a word goes on over a
space and the next word, so the n-grams of n words cost one more pass and are never spelled out.

``learn`` counts the buckets of two collections and returns a gain for each, ``weigh`` adds the gains of
each text up, and ``draw`` takes the highest weights with Gumbel noise, which samples without replacement.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.order import positions
from .common import append_columns, materialize, slices

#: Words of the longest run, and buckets.
GRAMS, BUCKETS = 3, 10_000
#: Bytes of text that are classified at a time, words whose registers advance together, and bytes of a word that they advance; the rest of longer words goes through zlib.
SLICE, TOGETHER, STEPS = 2 << 20, 1 << 17, 256

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words: digits, letters and all bytes of characters beyond ASCII.
_IS_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b > 0x7F for b in range(256)])


def _crc_table() -> np.ndarray:
    """What a byte does to the CRC-32 register, by shifting it eight times."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC, _EMPTY = _crc_table(), np.uint32(0xFFFFFFFF)


def byte_effect(byte: int) -> int:
    """What ``byte`` in the register's lowest place adds to it; effects of bits add up by exclusive or."""
    return int(_CRC[byte])


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, A-Z lower-cased, and the bounds of its rows in them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return _LOWER[raw], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and row of every word; words end where their row does."""
    inside = _IS_WORD[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    begin = np.flatnonzero(inside & ~before)
    return begin, np.flatnonzero(inside & ~after) + 1 - begin, np.searchsorted(bounds, begin, "right") - 1


def advance(register: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each register after the bytes of its word: all take a step at a time, those of longer words first in the array, so what still runs is its head."""
    order = np.argsort(-length, kind="stable")
    now, at, size = register[order], begin[order], length[order]
    for j in range(min(int(size[0]), STEPS) if len(size) else 0):
        n = np.searchsorted(-size, -j)  # words of more than j bytes
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + j]) & 255] ^ (now[:n] >> np.uint32(8))
    for k in range(np.searchsorted(-size, -STEPS)):
        now[k] = zlib.crc32(data[at[k] + STEPS : at[k] + size[k]].tobytes(), int(now[k] ^ _EMPTY)) ^ int(_EMPTY)
    out = np.empty_like(now)
    out[order] = now
    return out


def grams(column, most: int = GRAMS, buckets: int = BUCKETS):
    """(row, bucket) arrays of all runs of 1 to ``most`` words of the rows of a string column, a block of words at a time; rows ascend in each array."""
    data, bounds = buffers(column)
    begin, length, row = words(data, bounds)
    for a in range(0, len(begin), TOGETHER):
        low = max(0, a - most + 1)  # the words before are needed for the runs that end in the block
        part = slice(low, a + TOGETHER)
        register, own = np.full(len(begin[part]), _EMPTY), row[part]
        for n in range(1, most + 1):
            register = advance(register, data, begin[part][n - 1 :], length[part][n - 1 :])
            whole = own[n - 1 :] == own[: len(own) - n + 1]
            whole[: max(0, a - low - n + 1)] = False  # these end before the block
            yield own[n - 1 :][whole], ((register ^ _EMPTY) % np.uint32(buckets))[whole]
            register = register[:-1]
            register = _CRC[(register ^ 32) & 255] ^ (register >> np.uint32(8))
            if not len(register):
                break


def tally(df: DataFrame, text: str = "text", most: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts each bucket holds. A task sends a row for each bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for _, found in grams(part.column(0), most, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def learn(raw: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", most: int = GRAMS, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: a thousand times the logarithm of how much likelier it is in ``target`` than in ``raw``, one occurrence added to each, rounded down.

    Counts are over all rows of both. The driver holds ``buckets`` numbers. Null and empty texts have no n-grams; repeated rows count each.
    """
    both = tally(raw, text, most, buckets).select(F.lit(0).alias("side"), "bucket", "n").unionByName(tally(target, target_text, most, buckets).select(F.lit(1).alias("side"), "bucket", "n"))
    counts = [[0] * buckets, [0] * buckets]
    for r in both.collect():  # two rows a bucket at most
        counts[r["side"]][r["bucket"]] = r["n"]
    s_all, t_all = map(sum, counts)
    return [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(*counts)]


def weigh(df: DataFrame, gains: list[int], text: str = "text", most: int = GRAMS) -> DataFrame:
    """``df`` with n_words, n_features and weight (long), the sum of the gains of all n-grams of each whole text, in place of columns of these names.

    Null and empty texts, and those without words, have 0 in all three. Other columns pass unchanged, repeated rows stay repeated.
    """
    fields = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "n_features", "weight")])

    def make():
        gain = np.array(gains, np.int64)

        def work(batch):
            n = batch.num_rows
            every, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            column = batch.column(batch.schema.names.index(text)).cast(pa.large_string())
            for row, bucket in grams(column, most, len(gain)):
                if len(row):
                    first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
                    weight[row[first]] += np.add.reduceat(gain[bucket], first)
                    every[row[first]] += np.diff(np.append(first, len(row)))
            return [pa.array(x) for x in (word_counts(column), every, weight)]

        return work

    return append_columns(df, fields, make, text, SLICE)


def word_counts(column) -> np.ndarray:
    """Words of each row of a string column."""
    data, bounds = buffers(column)
    return np.bincount(words(data, bounds)[2], minlength=len(column))


def noise(id_column: Column, seed: int = 42) -> Column:
    """Gumbel noise, a thousand times and rounded down, that is a function of the seed and the id alone; null for a null id."""
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), id_column.cast("string")).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(df: DataFrame, id_column: str = "doc_id", weight: str = "weight", words: str = "n_words", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``df`` with ``score``, its weight and noise, and ``rank``, from 1 on, for the rows that are drawn (else null), in place of columns of these names.

    Of the N rows with at least ``least_words`` words the ``percent`` * N / 100 (rounded down) highest scores are drawn. Ties go to smaller
    ids, then to the other columns in order, so only rows that are equal in all could trade places. A row without id counts
    among the N, has no score and is never drawn. Rows are ordered by ranges and numbered where they are: no task or driver gets all.
    """
    base = df.drop("score", "rank")
    held = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(base.columns)]
    key = lambda name: f"c{base.columns.index(name)}"
    scored = materialize(base.select(*held).withColumn("score", F.col(key(weight)) + noise(F.col(key(id_column)), seed)), "scored")
    able = F.coalesce(F.col(key(words)) >= least_words, F.lit(False))
    count = scored.where(able).count()
    order = [F.desc_nulls_last("score"), F.asc_nulls_last(key(id_column)), *(k for k, c in zip((f"c{k}" for k in range(len(held))), base.columns) if c != id_column)]
    placed = positions(scored.where(able), order, scored.columns, "place")
    drawn = (F.col("place") < percent * count // 100) & F.col("score").isNotNull()
    every = placed.withColumn("rank", F.when(drawn, F.col("place") + 1)).drop("place").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(base.columns)), "score", "rank")
