"""Language-model scores from a log-frequency Bloom filter.

Token and pair counts are sums over the training texts. Counts are quantised on a
logarithmic scale, and a pair of a key and every level up to its own goes into a
Bloom filter; probing level after level until one is missing gives a count back,
and a key whose first level is missing counts as never seen. Scores are word-pair
probabilities, interpolated with single tokens. The plain add-one-half unigram
score of each text comes from exact counts, which stand beside the filter.

Every token and every pair is in the filter, from a count of 1 up, so it grows
with the corpus and no worker can hold it whole: its keys are dealt out to parts
of about PART bytes of text, each built where its counts meet and written to the
shared folder. Texts are scored in slices of about SLICE bytes; the distinct
words and pairs of a slice travel to their parts, and what is found there travels back to the slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Bytes of text for each part of the filter, and of a slice.
PART, SLICE = 12 << 20, 4 << 20
#: Ratio of the levels of counts, bits a level, probes a level, the log of the bits of a segment, and the share of pairs in a probability.
RATIO, BITS, PROBES, SEGMENT, PAIRS = 1.5, 12, 5, 15, 0.7
#: More levels than a count of 63 bits has.
MOST = 110
#: The token that ends each text; no word is empty.
END = b""

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, and the end."""
    return [*(text or b"").lower().split(), END]


def token_keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of word pairs from the keys of their words."""
    return _mix(first * _A + _mix(second + _A))


def quantised(n: np.ndarray) -> np.ndarray:
    """The level of each count, from 1."""
    return np.floor(np.log(n) / np.log(RATIO) + 1e-9).astype(np.int64) + 1


def _probes(keys: np.ndarray, level: int) -> list[np.ndarray]:
    """Places inside a key's segment of the probes of a level."""
    h = _mix(keys + np.uint64(level * int(_A) % (1 << 64)))
    return [((h >> np.uint64(12 * i)) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64) for i in range(PROBES)]


def filled(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bits of a filter that holds each key up to its level; all probes of a key lie in one segment."""
    segments = max(1, -(-int(levels.sum()) * BITS >> SEGMENT))
    bits = np.zeros(segments << SEGMENT, bool)
    base = (keys % np.uint64(segments)).astype(np.int64) << SEGMENT
    for q in range(1, int(levels.max(initial=0)) + 1):
        some = levels >= q
        for place in _probes(keys[some], q):
            bits[base[some] + place] = True
    return np.packbits(bits, bitorder="little")


def probed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key, by probing until a level is missing."""
    level = np.zeros(len(keys), np.int64)
    segments = np.uint64(len(bits) >> (SEGMENT - 3))
    alive = np.arange(len(keys))
    base = (keys % segments).astype(np.int64) << SEGMENT
    for q in range(1, MOST):
        held = np.ones(len(alive), bool)
        for place in _probes(keys[alive], q):
            at = base[alive] + place
            held &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        alive = alive[held]
        if not len(alive):
            break
        level[alive] = q
    return level


@dataclass
class Slice:
    """The tokens of some texts, by number: each distinct word and each distinct pair once.

    Words and pairs stand in the order of (part, key), which does not depend on the order of the texts.
    """

    words: list[bytes]
    word_keys: np.ndarray
    pair_keys: np.ndarray
    word_of: np.ndarray  # of each token
    before: np.ndarray  # the word before each token; an end before the first of a text
    pair_n: np.ndarray  # how often each pair occurs
    pair_of: np.ndarray | None  # of each token, where asked for
    text_of: np.ndarray
    parts: int

    @classmethod
    def of(cls, texts, parts: int, places: bool = False) -> "Slice":
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # as ``tokens`` does, but with empty strings at the edges
        text_of, coded = pc.list_parent_indices(split).to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        words = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
        end = words.index(END)
        words = words[: max(end + 1, len(words) - 1)]
        number = coded.indices.to_numpy()
        text_of, number = text_of[number != end], number[number != end]
        sizes = np.bincount(text_of, minlength=len(texts)) + 1
        word_of = np.full(len(number) + len(texts), end, np.int64)
        word_of[np.arange(len(number)) + text_of] = number  # an end behind each text
        keys = token_keys(words)
        before = np.roll(word_of, 1)  # the last token is an end
        codes = before * len(words) + word_of
        pairs, pair_n = np.unique(codes, return_counts=True)
        both = pair_keys(keys[pairs // len(words)], keys[pairs % len(words)])
        order, word_place = _ordered(np.lexsort((keys, _part(keys, parts))))
        # pairs that share part and short key have the same answer, so their order among themselves does not matter
        pair_order, pair_place = _ordered(np.argsort(_part(both, parts).astype(np.uint64) << np.uint64(32) | short(both)))
        pair_of = pair_place[np.searchsorted(pairs, codes)] if places else None
        return cls([words[i] for i in order.tolist()], keys[order], both[pair_order], word_place[word_of], word_place[before], pair_n[pair_order], pair_of, np.repeat(np.arange(len(sizes)), sizes), parts)

    def packed(self, counts: bool) -> dict[str, list]:
        """One row for each part: its words, joined, and the keys of its pairs; with ``counts``, how often each occurs here."""
        out: dict[str, list] = {"part": [], "words": [], "n_words": [], "pairs": []} | ({"word_n": [], "pair_n": []} if counts else {})
        n = np.bincount(self.word_of, minlength=len(self.words)).astype("<u4"), self.pair_n.astype("<u4")
        of_words, of_pairs = _part(self.word_keys, self.parts), _part(self.pair_keys, self.parts)
        small = short(self.pair_keys)
        for part in np.union1d(of_words, of_pairs).tolist():
            a, b = np.searchsorted(of_words, [part, part + 1]).tolist()
            c, d = np.searchsorted(of_pairs, [part, part + 1]).tolist()
            out["part"].append(part)
            out["words"].append(b" ".join(self.words[a:b]))
            out["n_words"].append(b - a)
            out["pairs"].append(small[c:d].tobytes())
            if counts:
                out["word_n"].append(n[0][a:b].tobytes())
                out["pair_n"].append(n[1][c:d].tobytes())
        return out


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def short(keys: np.ndarray) -> np.ndarray:
    """What stands for a key inside its part: its lower half. A part has about two million keys, so one in two thousand shares it, far less than what the filter itself confuses."""
    return keys.astype("<u4")


def _ordered(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order, and the place of each key in it."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place


_KINDS = {"slice": pa.int64(), "part": pa.int64(), "words": pa.binary(), "n_words": pa.int64(), "pairs": pa.binary(), "word_n": pa.binary(), "pair_n": pa.binary()}


def _table(found: dict[str, list]) -> dict:
    return {name: pa.array(x, _KINDS[name]) for name, x in found.items()}


def _numbers(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def counted(train: DataFrame, parts: int, text: str = "text") -> DataFrame:
    """How often each word and each pair occurs in each slice of the texts, packed by part."""

    def count(batches):
        for batch in batches:
            for piece in slices(batch, text, SLICE):
                yield pa.RecordBatch.from_pydict(_table(Slice.of(piece.column(0), parts).packed(True)))

    return train.select(text).mapInArrow(count, "part long, words binary, n_words long, pairs binary, word_n binary, pair_n binary")


def build(rows: DataFrame) -> DataFrame:
    """The filter of each part: exact counts of its words, bits of words and pairs, and by level the sum and number of the counts."""

    def fill(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        for blob, n in zip(table["words"].to_pylist(), table["word_n"].to_pylist()):
            n = np.frombuffer(n, "<u4").tolist()
            for word, k in zip(blob.split(b" ") if n else (), n):
                seen[word] = seen.get(word, 0) + k
        pairs, place = np.unique(_numbers(table["pairs"], "<u4"), return_inverse=True)
        pair_n = np.bincount(place, _numbers(table["pair_n"], "<u4"), len(pairs)).astype(np.int64)
        word_n = np.array(list(seen.values()), np.int64)
        found = {"part": [table["part"][0].as_py()], "words": [b" ".join(seen)], "word_n": [word_n.tobytes()], "distinct": [len(seen)], "total": [int(word_n.sum())]}
        for kind, keys, n in (("word", token_keys(list(seen)), word_n), ("pair", pairs, pair_n)):
            levels = quantised(n)
            found |= {f"{kind}_bits": [filled(short(keys).astype(np.uint64), levels).tobytes()], f"{kind}_sums": [np.bincount(levels, n).astype(np.int64)], f"{kind}_entries": [np.bincount(levels)]}
        kinds = dict(_KINDS, distinct=pa.int64(), total=pa.int64(), word_bits=pa.binary(), pair_bits=pa.binary())
        return pa.table({name: pa.array(x, kinds.get(name, pa.list_(pa.int64()))) for name, x in found.items()})

    levels = ", ".join(f"{kind}_bits binary, {kind}_sums array<long>, {kind}_entries array<long>" for kind in ("word", "pair"))
    return rows.groupBy("part").applyInArrow(fill, f"part long, words binary, word_n binary, distinct long, total long, {levels}")


def looked_up(sliced: DataFrame, filters: DataFrame, parts: int) -> DataFrame:
    """(slice, part, exact, words, pairs): for the distinct words of each slice their exact counts and levels, and the levels of its pairs, in the order of ``Slice``."""

    def ask(table: pa.Table) -> pa.Table:
        found = Slice.of(table["text"].combine_chunks(), parts).packed(False)
        return pa.table(_table({"slice": [table["slice"][0].as_py()] * len(found["part"])} | found))

    def answer(held: pa.Table, asking: pa.Table) -> pa.Table:
        n_of: dict[bytes, int] = {}
        bits = {}
        for row in held.to_pylist():  # one row, or none where nothing was learned
            n = np.frombuffer(row["word_n"], np.int64).tolist()
            n_of = dict(zip(row["words"].split(b" ") if n else (), n))
            bits = {kind: np.frombuffer(row[f"{kind}_bits"], np.uint8) for kind in ("word", "pair")}
        level = lambda kind, keys: (probed(bits[kind], keys.astype(np.uint64)) if kind in bits else np.zeros(len(keys), np.int64)).astype(np.uint8).tobytes()
        words = [blob.split(b" ") if n else [] for blob, n in zip(asking["words"].to_pylist(), asking["n_words"].to_pylist())]
        exact = [np.array([n_of.get(w, 0) for w in ws], np.int64).tobytes() for ws in words]
        of_words = [level("word", short(token_keys(ws))) for ws in words]
        of_pairs = [level("pair", np.frombuffer(p, "<u4")) for p in asking["pairs"].to_pylist()]
        return pa.table({"slice": asking["slice"], "part": asking["part"]} | {name: pa.array(x, pa.binary()) for name, x in (("exact", exact), ("words", of_words), ("pairs", of_pairs))})

    asking = sliced.groupBy("slice").applyInArrow(ask, "slice long, part long, words binary, n_words long, pairs binary")
    held = filters.select("part", "words", "word_n", "word_bits", "pair_bits")
    return held.groupBy("part").cogroup(asking.groupBy("part")).applyInArrow(answer, "slice long, part long, exact binary, words binary, pairs binary")


def score(df: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", part: int = PART, slice_bytes: int = SLICE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``train`` says which rows are learned from; rows for which it is false are held out, those for which it is null (no id) are neither. Null texts
    count as empty and consist of the end alone. Repeated rows and rows without
    id are scored one by one; other columns are dropped. With nothing to
    learn from, all counts are zero; an empty table gives no rows. The slice of a row
    follows from its id and text, so a task that is run again deals rows out alike.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(~train, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")) + F.count("*")).first()[0] or 0
    parts, n_slices = 1 + size // part, 1 + size // slice_bytes
    filters = materialize(build(counted(rows.where("train"), parts)), "filter")
    total, distinct = (x or 0 for x in filters.agg(F.sum("total"), F.sum("distinct")).first())
    means = {kind: np.zeros(MOST) for kind in ("word", "pair")}  # the mean count of each level
    for kind, mean in means.items():
        by_level = filters.select(F.posexplode(F.arrays_zip(f"{kind}_sums", f"{kind}_entries")).alias("q", "x"))
        for r in by_level.groupBy("q").agg(F.try_divide(F.sum(f"x.{kind}_sums"), F.sum(f"x.{kind}_entries")).alias("mean")).where("mean IS NOT NULL").collect():  # at most MOST rows
            mean[r["q"]] = r["mean"]
    norm = float(total) + 0.5 * (distinct + 1)
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(n_slices)))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        s = Slice.of(texts["text"].combine_chunks(), parts, places=True)
        found = found.sort_by("part")
        exact = _numbers(found["exact"], "<i8")
        word, pair = means["word"][_numbers(found["words"], np.uint8)], means["pair"][_numbers(found["pairs"], np.uint8)]
        if len(exact) != len(s.words) or len(pair) != len(s.pair_keys):
            raise RuntimeError("the answers do not fit the slice")
        n = len(texts)
        of_text = lambda x: np.bincount(s.text_of, x, n)
        sizes = np.bincount(s.text_of, minlength=n)
        single = (word[s.word_of] + 0.5) / norm
        first = word[s.before]
        both = np.where(first > 0, np.minimum(pair[s.pair_of] / np.maximum(first, 1e-9), 1.0), 0.0)
        p = np.where(first > 0, PAIRS * both + (1 - PAIRS) * single, single)
        columns = {"n_tokens": sizes, "n_known": of_text((exact > 0)[s.word_of]).astype(np.int64), "train_tokens": np.full(n, total)}
        scores = {"base_score": of_text(np.log10(exact + 0.5)[s.word_of]) - sizes * np.log10(norm), "score": of_text(np.log10(np.minimum(p, 1.0)))}
        return pa.table({id_column: texts["id"], "held_out": texts["held_out"]} | {k: pa.array(x, pa.int64()) for k, x in columns.items()} | {k: pa.array(x, pa.float64()) for k, x in scores.items()})

    kinds = f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sliced.groupBy("slice").cogroup(looked_up(sliced, filters, parts).groupBy("slice")).applyInArrow(run, kinds)
