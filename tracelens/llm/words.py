"""Words of texts and their 64-bit hashes, vectorised over the bytes of Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer text is worked on whole).
CHUNK = 1 << 21
#: Bytes of a text hashed at once.
SEGMENT = 1 << 20

U = np.uint64
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = mix((_LOWER.astype(U) + U(1)) * U(0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}


def forget() -> None:
    """Powers for short texts only."""
    _powers.update(p=powers(_BASE, 1 << 16), inverse=powers(U(pow(int(_BASE), -1, 1 << 64)), 1 << 16))


forget()


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        m = 1 << (n - 1).bit_length()
        _powers["p"], _powers["inverse"] = powers(_BASE, m), powers(U(pow(int(_BASE), -1, 1 << 64)), m)
    return _powers["p"][:n], _powers["inverse"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = pa.array(column.fill_null("") if column.null_count else column, pa.large_string()) if not pa.types.is_large_string(column.type) else column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of some consecutive texts: bounds in bytes, hashes, and the first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        space = _SPACE[raw]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[offsets] = True
        word = ~space
        prior = np.zeros(n, bool)
        prior[1:] = word[:-1]
        begins = word & (~prior | edge[:n])
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        ends = word & (~after | edge[1:])
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hash = self._hashes(raw, space)
        self.first = np.searchsorted(self.start, offsets)  # word index of each text, and the end
        self.offsets = offsets


    def _hashes(self, raw: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Hash of each word, from about SEGMENT bytes at once, so a long text needs little beside itself."""
        start, end = self.start, self.end
        out, size = np.zeros(len(start), U), end - start
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SEGMENT, "right")))
            a, b = start[lo], end[hi - 1]
            code = _CODE[raw[a:b]]
            code[space[a:b]] = 0
            spans = np.diff(np.append(start[lo:hi], b))  # a word and the white space behind it
            most = int(size[lo:hi].max())
            place = np.minimum(np.arange(b - a) - np.repeat(start[lo:hi] - a, spans), most - 1)
            code *= _upto(most)[0][place]
            out[lo:hi] = np.add.reduceat(code, start[lo:hi] - a)
            lo = hi
        return mix(out + size.astype(U))


def chunks(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first row, words) of runs of rows of about CHUNK bytes."""
    raw, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    q, out = 1, np.zeros(n, U)
    for i in range(k):
        out += hashes[i : i + n] * U(q)
        q = q * int(_WORD_BASE) % (1 << 64)
    return mix(out + U(k))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; a shorter text's only one is its whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    return np.unique(runs(hashes, min(k, n)))
