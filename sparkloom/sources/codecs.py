"""Byte codecs of transforms: runs as the bytes of each file format, and back.

Every function works on a chunk of a file, so chunks are decoded in parallel.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..functions.alphabet import ORDERS, SIGMA

#: Longest run of a one-byte code, longest basic run of the native code, bytes of a native block.
LONGEST, BASIC, NATIVE_BLOCK = 31, 256 // SIGMA, 64


#: The formats whose bytes are runs; in the others every byte is a symbol.
RUN_CODES = ("ropebwt", "sga")


@dataclass(frozen=True)
class Format:
    """A file format: its tag, name, alphabet order, bytes of its header, and the file's first bytes where these tell it."""

    tag: str
    name: str
    order: str
    header: int
    magic: bytes = b""


#: The formats and their tags.
FORMATS = {
    f.tag: f
    for f in (
        Format("native", "Native format", "any", 24, b"!BWT"),
        Format("plain_default", "Plain format (default alphabet)", "default", 0),
        Format("plain_sorted", "Plain format (sorted alphabet)", "sorted", 0),
        Format("rfm", "RFM format", "sorted", 8),
        Format("sdsl", "SDSL format", "sorted", 8),
        Format("ropebwt", "RopeBWT format", "default", 4, b"RLE\x06"),
        Format("sga", "SGA format", "default", 30, b"\xca\xca"),
    )
}


def letter_codes(order: str) -> np.ndarray:
    """Comp values of all bytes: letters in either case, $ and NUL as the end marker, others as N."""
    letters = ORDERS[order]
    out = np.full(256, letters.index("N"), np.uint8)
    for k, ch in enumerate(letters):
        out[ord(ch)] = out[ord(ch.lower())] = k
    out[0] = 0
    return out


def group(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of maximal runs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
    return values[cuts[:-1]], np.diff(cuts)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7-bit groups, the lowest first, the high bit set on all but the last; and the place behind it."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out + bytes([value]))


def decode_native(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the native code; a chunk of whole 64-byte blocks stands on its own, as no run crosses them, so all blocks are decoded side by side."""
    raw = np.frombuffer(data, np.uint8)
    blocks = -(-len(raw) // NATIVE_BLOCK)
    cells = np.zeros(blocks * NATIVE_BLOCK, np.int64)
    cells[: len(raw)] = raw
    held = np.arange(len(cells)).reshape(blocks, NATIVE_BLOCK) < len(raw)
    cells = cells.reshape(blocks, NATIVE_BLOCK)
    symbols, lengths = np.zeros_like(cells), np.zeros_like(cells)
    within, shift, symbol, length = np.zeros(blocks, bool), np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    for j in range(NATIVE_BLOCK):
        b, head = cells[:, j], ~within & held[:, j]
        symbol = np.where(head, b % SIGMA, symbol)
        length = np.where(head, b // SIGMA + 1, np.where(within, length + ((b & 0x7F) << shift), length))
        more = np.where(head, length >= BASIC, within & (b >= 0x80))
        shift = np.where(within, shift + 7, 0)
        done = (head | within) & ~more
        symbols[done, j], lengths[done, j] = symbol[done], length[done]
        within = more
    kept = lengths > 0
    return symbols[kept], lengths[kept]


def encode_native(runs, at: int = 0) -> bytes:
    """The native code of (symbol, length) pairs, from offset ``at`` of the array on."""
    out = bytearray()
    for symbol, length in runs:
        while length:
            room = NATIVE_BLOCK - (at + len(out)) % NATIVE_BLOCK
            if length < BASIC or room == 1:
                part = min(length, BASIC - 1)
                out.append(symbol + SIGMA * (part - 1))
            else:
                part = min(length, BASIC + (1 << 7 * (room - 1)) - 1)
                out.append(symbol + SIGMA * (BASIC - 1))
                out += write_varint(part - BASIC)
            length -= part
    return bytes(out)


def decode(tag: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of a chunk of the bytes behind a header."""
    if tag == "native":
        return decode_native(data)
    raw = np.frombuffer(data, np.uint8)
    if tag in RUN_CODES:
        symbols, lengths = (raw & 7, raw >> 3) if tag == "ropebwt" else (raw >> 5, raw & 31)
        if (symbols >= SIGMA).any():
            raise ValueError(f"{tag}: a symbol beyond {SIGMA - 1}")
        return symbols.astype(np.int64), lengths.astype(np.int64)
    if tag == "rfm":
        return group(np.where(raw < SIGMA, raw, 0))
    return group(letter_codes(FORMATS[tag].order)[raw])


def encode(tag: str, symbols: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of runs; for one-byte codes, long runs are split."""
    if tag == "native":
        return encode_native(zip(symbols.tolist(), lengths.tolist()))
    if tag in RUN_CODES:
        pieces = -(-lengths // LONGEST)
        symbol = np.repeat(symbols, pieces)
        length = np.full(len(symbol), LONGEST)
        ends = np.cumsum(pieces) - 1
        length[ends] = lengths - (pieces - 1) * LONGEST
        return (length << 3 | symbol if tag == "ropebwt" else symbol << 5 | length).astype(np.uint8).tobytes()
    values = np.repeat(symbols, lengths)
    if tag == "rfm":
        return values.astype(np.uint8).tobytes()
    return np.frombuffer(ORDERS[FORMATS[tag].order].encode(), np.uint8)[values].tobytes()


def header(tag: str, sequences: int, bases: int, run_bytes: int) -> bytes:
    """The bytes before the data of a file."""
    if tag == "ropebwt":
        return FORMATS[tag].magic
    if tag == "sga":
        return FORMATS[tag].magic + struct.pack("<QQQI", sequences, bases, run_bytes, 0)
    if tag in ("rfm", "sdsl"):
        return struct.pack("<Q", 8 * bases)
    return b""


def padding(tag: str, bases: int) -> bytes:
    return bytes(-bases % 8) if tag in ("rfm", "sdsl") else b""


def sniff(head: bytes) -> dict:
    """What the first bytes of a file say: format, sequences, bases, bytes, alphabet; a file too short for a header is unknown."""
    out = {"format": "unknown", "sequences": None, "bases": None, "bytes": None, "alphabet": None}
    if len(head) >= 24 and head[:4] == FORMATS["native"].magic:
        flags, sequences, bases = struct.unpack("<IQQ", head[4:24])
        # fixed values: alphabet orders in the low bits of the flags
        order = {0: "default", 1: "sorted", 254: "any"}.get(flags & 0xFF, "unknown")
        return out | {"format": "native", "sequences": sequences, "bases": bases, "alphabet": order}
    if len(head) >= 30 and head[:2] == FORMATS["sga"].magic:
        sequences, bases, size, flags = struct.unpack("<QQQI", head[2:30])
        return out | ({"format": "sga", "sequences": sequences, "bases": bases, "bytes": size, "alphabet": "default"} if flags == 0 else {})
    if len(head) >= 4 and head[:4] == FORMATS["ropebwt"].magic:
        return out | {"format": "ropebwt", "alphabet": "default"}
    return out


def data_span(tag: str, head: bytes, length: int) -> tuple[int, int]:
    """Where the data begin and end in a file of ``length`` bytes that starts with ``head``."""
    begin = FORMATS[tag].header
    if tag == "native":
        return begin + 8, begin + 8 + struct.unpack("<Q", head[24:32])[0]
    if tag in ("rfm", "sdsl"):
        return begin, begin + struct.unpack("<Q", head[:8])[0] // 8
    return begin, length
