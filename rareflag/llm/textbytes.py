"""Vectorised word kernels over the UTF-8 bytes of an Arrow string column.

All tokenising rules of the operators are classes of ASCII bytes (every byte
of a multi-byte character belongs to the word), so words are runs of bytes and
a whole batch is cut, lower-cased and hashed with a few numpy passes, without a
Python object per word. Batches are walked in chunks of about ``CHUNK`` bytes
(at least one text), which bounds the temporary arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U64 = np.uint64

_ASCII = np.arange(256)
LOWER = np.where((_ASCII >= 0x41) & (_ASCII <= 0x5A), _ASCII + 32, _ASCII).astype(np.uint8)
SAME = _ASCII.astype(np.uint8)
#: words of ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~((_ASCII == 0x20) | ((_ASCII >= 0x09) & (_ASCII <= 0x0D)))
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM = (_ASCII >= 0x80) | ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), element-wise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


class Texts(NamedTuple):
    """Bytes of consecutive texts; text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of consecutive texts; text i has words bounds[i]:bounds[i+1]."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def text(self, i: int, j: int) -> str:
        """Words i..j-1 (after mapping) joined by a space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True)).decode(
            "utf-8", "replace")


def texts(column: pa.Array) -> Texts:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buf = column.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return Texts(data[off[0]:off[-1]] if len(off) else data[:0], off - off[0])


def chunks(t: Texts, size: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """(first, last + 1, texts) of runs of whole texts of about ``size`` bytes."""
    n, i = len(t.offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(t.offsets, t.offsets[i] + size, "right")) - 1)
        yield i, j, Texts(t.data[t.offsets[i]:t.offsets[j]], t.offsets[i:j + 1] - t.offsets[i])
        i = j


def no_clash(carry: list[str], made: tuple[str, ...]) -> None:
    """Carried columns may not have the names of columns that are made."""
    both = sorted({c.lower() for c in carry} & set(made))
    if both:
        raise ValueError(f"carried columns have the names of results: {both}")


def word_spans(t: Texts, is_word: np.ndarray, mapping: np.ndarray = SAME) -> tuple[np.ndarray, ...]:
    """(start, end, bounds, mapped data, mask) of the words of the texts."""
    data = mapping[t.data] if mapping is not SAME else t.data
    mask = is_word[data]
    n = len(data)
    first, last = mask.copy(), mask.copy()
    if n:
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        inner = t.offsets[(t.offsets > 0) & (t.offsets < n)]
        first[inner] = mask[inner]
        last[inner - 1] = mask[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, t.offsets), data, mask


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of data[start:end] for disjoint, ordered, non-empty spans.

    ``mask`` marks exactly the bytes inside the spans (made here when absent)."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    if mask is None:
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start] += 1
        np.subtract.at(edge, end, 1)
        mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    inside = data[mask]
    pos = np.arange(len(inside)) - np.repeat(at, size)
    h = _BYTE[inside]
    h *= _powers(int(size.max()))[pos]
    return mix(np.add.reduceat(h, at) + size.astype(U64))


def words(t: Texts, is_word: np.ndarray, mapping: np.ndarray = SAME) -> Words:
    start, end, bounds, data, mask = word_spans(t, is_word, mapping)
    return Words(start, end, span_hashes(data, start, end, mask), bounds, data)


_GRAM = mix(np.arange(1, 129, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes (across texts too: mask by bounds)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _GRAM[0]
    for j in range(1, k):
        out += h[j:n + j] * _GRAM[j]
    return mix(out)


def per_text(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over the n = words - k + 1 gram positions: gram lies in one text."""
    ok = np.zeros(max(n, 0), bool)
    if n > 0:
        edge = np.zeros(n + 1, np.int64)
        lo, hi = bounds[:-1], bounds[1:] - k + 1
        keep = hi > lo
        np.add.at(edge, lo[keep], 1)
        np.add.at(edge, hi[keep], -1)
        ok = np.cumsum(edge[:-1]) > 0
    return ok
