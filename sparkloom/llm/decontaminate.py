"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of 13 consecutive words of a benchmark item is a pattern (a
shorter item is one pattern). A shift table over blocks of words says how far
a search may jump; where the jump is zero, the bucket of the block's hash gives
the patterns that may end there, and comparing the words' bytes confirms an
occurrence. The search advances many lanes of a batch at once, in numpy.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, packed, slices, worker_cache

#: Words of a lane, and of a block of the shift table.
LANE, BLOCK = 256, 3
#: Bytes of item texts in one set of tables, and cells of a shift table at most; a larger benchmark is searched set by set.
SET_BYTES, SHIFT_BITS = 8 << 20, 22

#: Bytes of words as themselves in lower case, all others as zero: a word is a run of digits, letters and bytes from 0x80.
_WORD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 0 for b in range(256))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Words:
    """The words of some texts: bytes, starts, lengths, hashes, and the number of each text's first word."""

    def __init__(self, texts: list[bytes]):
        joined = b"\0".join(texts).translate(_WORD) + bytes(16)
        self.data = np.frombuffer(joined, np.uint8)
        inside = np.concatenate(([False], self.data != 0))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, ends = edges[::2], edges[1::2]
        self.lengths = ends - self.starts
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, begins)
        eights = np.ndarray((len(joined) - 8,), "<u8", joined, 0, (1,))
        head = eights[self.starts] & _MASKS[np.minimum(self.lengths, 8)]
        tail = eights[np.maximum(ends - 8, self.starts)] & _MASKS[np.minimum(self.lengths, 8)]
        h = (head * _M1) ^ ((tail ^ self.lengths.astype(np.uint64)) * _M2)
        self.hashes = (h ^ (h >> np.uint64(29))) * _M3

    def __len__(self) -> int:
        return len(self.starts)

    def same(self, mine: np.ndarray, other: "Words", theirs: np.ndarray) -> np.ndarray:
        """Whether the bytes of words of equal length are equal, pair by pair."""
        lengths = self.lengths[mine]
        equal = lengths == other.lengths[theirs]
        lengths = np.where(equal, lengths, 1)
        ends = np.cumsum(lengths)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        alike = self.data[np.repeat(self.starts[mine], lengths) + step] == other.data[np.repeat(other.starts[theirs], lengths) + step]
        return equal & (np.logical_and.reduceat(alike, ends - lengths) if len(ends) else equal)


def block_hash(words: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words that end at each of ``last``."""
    h = words[last]
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(31))) * _M1 + words[last - k]
    return (h ^ (h >> np.uint64(32))) * _M2


@dataclass
class Tables:
    """Patterns of one length: the shift table, and the patterns in order of the hash of their last block."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    suffixes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: Words, starts: np.ndarray, length: int) -> "Tables":
        block = min(BLOCK, length)
        bits = min(SHIFT_BITS, max(12, (8 * len(starts)).bit_length()))  # windows overlap, so there are about as many blocks as windows
        shift = np.full(1 << bits, min(255, length - block + 1), np.uint8)
        for end in range(block - 1, length):
            np.minimum.at(shift, (block_hash(words.hashes, starts + end, block) >> np.uint64(64 - bits)).astype(np.int64), min(255, length - 1 - end))
        suffixes = block_hash(words.hashes, starts + length - 1, block)
        order = np.argsort(suffixes)
        return cls(length, block, bits, shift, suffixes[order], starts[order])


@dataclass
class PatternSet:
    """All patterns of some items: their words, tables by length, and (pattern's first word, item)."""

    words: Words
    tables: list[Tables]
    pattern_item: np.ndarray
    item_ids: list

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], window: int) -> "PatternSet":
        kept = [(i, t) for i, t in items if t]
        words = Words([t.encode() for _, t in kept])
        first, item_of, by_length = words.first, np.zeros(len(words), np.int64), {}
        for k in range(len(kept)):
            a, b = int(first[k]), int(first[k + 1])
            item_of[a:b] = k
            if b > a:
                length = min(window, b - a)
                by_length.setdefault(length, []).append(np.arange(a, b - length + 1))
        return cls(words, [Tables.of(words, np.concatenate(s), n) for n, s in sorted(by_length.items())], item_of, [i for i, _ in kept])


def occurrences(words: Words, found: PatternSet):
    """(first word, length, item's number) of every occurrence of every pattern, for each length."""
    text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for t in found.tables:
        if len(words) < t.length:
            continue
        ends = []
        at = np.arange(t.length - 1, len(words), LANE)
        stop = np.minimum(at + LANE, len(words))
        while len(at):
            h = block_hash(words.hashes, at, t.block)
            jump = t.shift[(h >> np.uint64(64 - t.bits)).astype(np.int64)].astype(np.int64)
            zero = jump == 0
            if zero.any():
                ends.append((at[zero], h[zero]))
            at = at + np.maximum(jump, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        if not ends:
            continue
        end, h = (np.concatenate(x) for x in zip(*ends))
        low, high = np.searchsorted(t.suffixes, h, "left"), np.searchsorted(t.suffixes, h, "right")
        start = end - t.length + 1
        hit = (high > low) & (text_of[start] == text_of[end])
        start, low, count = start[hit], low[hit], (high - low)[hit]
        for a in range(0, len(start), 1 << 16):  # bounds what is held for very common suffixes
            n = count[a : a + (1 << 16)]
            place = np.repeat(start[a : a + (1 << 16)], n)
            pattern = t.starts[np.repeat(low[a : a + (1 << 16)], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            for k in range(t.length):
                near = words.hashes[place + k] == found.words.hashes[pattern + k]
                place, pattern = place[near], pattern[near]
            for k in range(t.length):
                near = words.same(place + k, found.words, pattern + k)
                place, pattern = place[near], pattern[near]
            if len(place):
                yield place, t.length, found.pattern_item[pattern]


def judge(texts: list[bytes], found: PatternSet, hit: list[bytes] | None = None, ids: list[list] | None = None) -> list[tuple[int, int, bytes, list]]:
    """For each text: its words, how many of them lie inside an occurrence and which (a bit each), and the ids of the items that occur; with what earlier sets found."""
    words = Words(texts)
    cover = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set(x or ()) for x in ids] if ids else [set() for _ in texts]
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    for place, length, item in occurrences(words, found):
        np.add.at(cover, place, 1)
        np.add.at(cover, place + length, -1)
        for text, k in np.unique(np.stack((text_of[place], item)), axis=1).T.tolist():
            if found.item_ids[k] is not None:
                items[text].add(found.item_ids[k])
    inside = np.cumsum(cover[:-1]) > 0
    out = []
    for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        own = inside[a:b]
        if hit:
            own = own | (np.unpackbits(np.frombuffer(hit[k], np.uint8), count=b - a) == 1)
        out.append((b - a, int(own.sum()), np.packbits(own).tobytes(), sorted(items[k])))
    return out


def sets_of(items: DataFrame, item_id: str, item_text: str, set_bytes: int):
    """The items in sets of at most ``set_bytes`` of text (one item at least), one set in memory at a time."""
    held, size = [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        length = len((row["t"] or "").encode())
        if held and size + length > set_bytes:
            yield held
            held, size = [], 0
        held.append((row["i"], row["t"]))
        size += length
    if held:
        yield held


def overlap(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, set_bytes: int = SET_BYTES) -> DataFrame:
    """``df`` with n_words, n_hit (long) and item_ids (array of strings, sorted): what benchmark items occur in each whole text.

    Null and empty texts have no words. Items without words are left out; those without id count
    for n_hit alone; repeated items and equal windows of several items count for each id once.
    Columns of ``df`` that have the new names are replaced. Each set of at most ``set_bytes`` of item
    texts is one round: it is sent to the workers, which build its tables once and
    hold those of one set at a time, and all documents pass by. Between rounds the documents
    lie in the shared folder with what was found so far. So what is sent at once is bounded, whatever the benchmark's size.
    """
    base = df.drop("n_words", "n_hit", "item_ids")
    now, back = packed(base, text)
    sets, first = sets_of(items, item_id, item_text, set_bytes), True
    part = next(sets, [])
    while part is not None:
        after = next(sets, None)
        now = _round(now, part, window, first, after is None)
        if after is not None:
            now = materialize(now, "searched")
        part, first = after, False
    return now.select(*back, "n_words", "n_hit", "item_ids")


def _round(rows: DataFrame, items: list, window: int, first: bool, last: bool) -> DataFrame:
    """rows(row, text) with n_words, n_hit, hit and item_ids after one set of items; ``hit``, which words are hit, only where another round needs it."""
    name, sent = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(items)
    fields = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_hit", T.LongType(), False), T.StructField("hit", T.BinaryType(), True), T.StructField("item_ids", T.ArrayType(T.StringType()), False)])

    def run(batches):
        held = worker_cache("wu-manber", dict)  # of the latest set only
        if name not in held:
            held.clear()
            held[name] = PatternSet.of(sent.value, window)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                found = judge(texts, held[name], *(() if first else (part.column("hit").to_pylist(), part.column("item_ids").to_pylist())))
                columns = [pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array([None if last else r[2] for r in found], pa.binary()), pa.array([r[3] for r in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), *columns], names=out.names)

    out = T.StructType([*rows.select("row", "text").schema.fields, *fields.fields])
    return rows.mapInArrow(run, out)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule: some words are hit, and at least one in twenty."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
