"""Texts of Arrow batches as flat byte arrays, worked on with numpy for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

BLANK, WORD, OTHER, CONT = 0, 1, 2, 3
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*b"\t\n\v\f\r ", 0x1C, 0x1D, 0x1E, 0x1F]] = BLANK
_CLASS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = WORD
_CLASS[0x80:0xC0] = CONT
_WIDE_BLANKS = [c for c in range(0x80, 0x3001) if chr(c).isspace()]

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64 and of its inverse."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        back = pow(_MULT, -1, 1 << 64)
        _pow, _inv = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, m, U64)])) for m in (_MULT, back))
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


@dataclass
class Block:
    """Consecutive texts of a batch: rows ``first`` .. of it, their bytes, and where each begins."""

    first: int
    data: np.ndarray
    starts: np.ndarray  # one more than texts

    @property
    def n(self) -> int:
        return len(self.starts) - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string array into blocks of about ``limit`` bytes. A null counts as an empty text; one long text is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    if not (wide or pa.types.is_string(texts.type)):
        texts, wide = texts.cast(pa.string()), False
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Block(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def classes(b: Block) -> np.ndarray:
    """Of each byte: blank, word byte, first byte of another character, or a later byte of it."""
    c = _CLASS[b.data]
    at = np.flatnonzero((b.data == 0xC2) | ((b.data >= 0xE1) & (b.data <= 0xE3)))
    if len(at):
        d = np.concatenate([b.data, np.zeros(2, np.uint8)]).astype(np.int32)
        two = d[at] == 0xC2
        cp = np.where(two, d[at + 1], ((d[at] & 15) << 12) | ((d[at + 1] & 63) << 6) | (d[at + 2] & 63))
        hit = np.isin(cp, _WIDE_BLANKS)
        for k in range(3):
            p = at[hit] + k
            p = p[(k < 2) | ~two[hit]]
            c[p] = BLANK
    return c


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text of the block
    hash: np.ndarray
    first: np.ndarray  # index of each text's first token, one more than texts


def hash_ranges(b: Block, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes in any text and block."""
    n = len(b.data)
    pw, inv = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[b.data] * pw[:n], out=total[1:])
    return mix((total[end] - total[start]) * inv[start])


def tokens(b: Block, words_only: bool = False, lower: bool = False) -> Tokens:
    """Maximal runs of ASCII letters, digits and underscores and, unless ``words_only``, every other non-blank character alone."""
    n = len(b.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Tokens(z, z, z, z.astype(U64), np.zeros(b.n + 1, np.int64))
    c = classes(b)
    new = np.ones(n, bool)
    new[1:] = ~((c[1:] == CONT) | ((c[1:] == c[:-1]) & (c[1:] <= WORD)))
    begins = b.starts[:-1]
    new[begins[begins < n]] = True
    at = np.flatnonzero(new)
    stop = np.append(at[1:], n)
    kind = c[at]
    keep = kind == WORD if words_only else (kind == WORD) | (kind == OTHER)
    s, e = at[keep], stop[keep]
    first = np.searchsorted(s, b.starts)
    return Tokens(s, e, np.repeat(np.arange(b.n), np.diff(first)), hash_ranges(b, s, e, lower), first)
