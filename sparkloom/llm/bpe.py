"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a BPE model of the tokenizers library:
bytes are mapped to printable characters, and every split of a token into two
tokens is a merge whose priority is the token's rank. Text is cut by the
split pattern; each piece that a task has not met yet goes through the library
in one batch, and known pieces are looked up, since natural text repeats most of
its pieces. Decoding reverses the byte table; tokens that hold parts of a
character give the character back once all its parts are joined.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, worker_cache

#: Distinct pieces that a worker keeps; beyond it, only those of the latest texts stay, which bounds memory and changes no result.
KEPT_PIECES = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def build_tokenizer(ranks: dict[bytes, int]):
    """A tokenizers BPE model that merges as the ranks say; it takes pieces, not whole texts."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = byte_alphabet()
    spell = lambda token: "".join(letters[b] for b in token)
    merges = [(spell(t[:i]), spell(t[i:])) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    made = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


# The pattern of public byte-level vocabularies, and what it means for texts of Latin-1 characters, where letters, numbers and white space can be listed.
_PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def splitter(pattern: str):
    """A function from a text to the matches of ``pattern``; Latin-1 texts take a plainer expression with the same matches where one is known."""
    every = regex.compile(pattern).findall
    if pattern != _PUBLIC:
        return every
    latin = re.compile(_LATIN).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin(text)

    return split


class PieceEncoder:
    """Encodes texts piece by piece, keeping the ids (as four bytes each) of the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_PIECES):
        self.tokenizer, self.pieces_of, self.kept, self.known = build_tokenizer(ranks), splitter(pattern), kept, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces_of(t) for t in texts]
        used = set().union(*split)
        fresh = list(used.difference(self.known))
        if len(self.known) + len(fresh) > self.kept:
            self.known = {p: self.known[p] for p in used if p in self.known}
        for piece, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self.known[piece] = array("i", found.ids).tobytes()
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32) for pieces in split]


def character_offsets(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first character and the one past the last that each token touches; lengths: bytes of each token in turn."""
    if not len(lengths):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    char_of = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return char_of[ends - lengths].astype(np.int32), (char_of[ends - 1] + 1).astype(np.int32)


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", offsets: bool = False, decoded: str | None = None, packed: int | None = None) -> DataFrame:
    """``df`` with the token ids of the column ``text``: array<int>.

    With ``offsets`` come ``token_start`` and ``token_end``: the characters (code
    points, end exclusive) that each token touches; tokens that share a
    character all name it. With ``decoded``, a binary column of that name has what the ids
    decode to, in the same pass. With ``packed`` (2 or 4), ``ids`` is binary instead: so many bytes an id, the lowest first.
    A null text counts as empty and has an empty array; so
    has an empty table no rows. Other columns pass unchanged, and columns that
    have the names of the new ones are replaced. Repeated rows stay repeated.
    The rank file is read once by the driver and sent with the tasks (under 1 MB).
    """
    ranks = read_ranks(ranks_path)
    fields = T.StructType([T.StructField(ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False), False)])
    if offsets:
        fields = fields.add("token_start", T.ArrayType(T.IntegerType(), False), False).add("token_end", T.ArrayType(T.IntegerType(), False), False)
    if decoded:
        fields = fields.add(decoded, T.BinaryType(), False)
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        encoder = worker_cache(("bpe", ranks_path, pattern), lambda: PieceEncoder(sent.value, pattern))
        of = worker_cache(("bytes", ranks_path), lambda: byte_table(sent.value))

        def work(batch):
            texts = [t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            rows = encoder(texts)
            out = [pa.array([r.astype(f"<u{packed}").tobytes() for r in rows], pa.binary()) if packed else _lists(rows, pa.int32())]
            if offsets:
                spans = [character_offsets(t.encode(), np.array([len(of[i]) for i in r.tolist()], np.int64)) for t, r in zip(texts, rows)]
                out += [_lists([s[k] for s in spans], pa.int32()) for k in (0, 1)]
            if decoded:
                out.append(pa.array([b"".join(map(of.__getitem__, r.tolist())) for r in rows], pa.binary()))
            return out

        return work

    return append_columns(df, fields, make, text, 1 << 20)


def byte_table(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """The bytes that each id stands for."""
    return {rank: token for token, rank in ranks.items()}


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", data: str = "decoded", text: str | None = None) -> DataFrame:
    """``df`` with the bytes that the ids in ``ids`` stand for, in the binary column ``data``.

    With ``text``, a string column of that name has the bytes as UTF-8; bytes
    of a character that is not whole become U+FFFD. Null arrays give no bytes; an id
    that is null or not in the vocabulary gives the three bytes of U+FFFD.
    """
    ranks = read_ranks(ranks_path)
    fields = T.StructType([T.StructField(data, T.BinaryType(), False)])
    if text:
        fields = fields.add(text, T.StringType(), False)
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        unknown = "�".encode()
        of = byte_table(sent.value)

        def work(batch):
            column = batch.column(batch.schema.names.index(ids))
            try:
                rows = [b"".join(map(of.__getitem__, r.as_py() or ())) if not r.is_valid else b"".join(map(of.__getitem__, r.values.to_pylist())) for r in column]
            except KeyError:
                rows = [b"".join(of.get(i, unknown) for i in r.as_py() or ()) for r in column]
            return [pa.array(rows, pa.binary())] + ([pa.array([r.decode("utf-8", "replace") for r in rows], pa.string())] if text else [])

        return work

    return append_columns(df, fields, make, ids, 1 << 20)


def digest(ids: str, data: str) -> dict:
    """Token count and the digests of ids and decoded bytes."""
    return {
        "n_tokens": F.size(ids).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col(data), 256),
    }
