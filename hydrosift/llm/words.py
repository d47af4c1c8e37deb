"""Words of many texts at once, as 64-bit hashes, in numpy.

A batch of texts is one byte array; words are runs of bytes outside a set of
ASCII delimiters (so multi-byte characters stay whole).  A word's hash is a
polynomial in its bytes modulo 2**64, taken from running sums, then mixed.
Work memory is bounded per chunk of bytes, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WHITESPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, dtype=U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer spreading every input bit over the word (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each (s, e), independent of where it lies."""
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_BASE_INV, len(values) + 1)[starts]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of the texts of one Arrow array.

    hashes[i] is word i's hash, start[i] / end[i] its byte range in ``data``;
    text t is the bytes offsets[t] to offsets[t + 1] and holds the words
    first[t] to first[t + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False, delimiters: bytes = WHITESPACE_BYTES):
        data, offsets = text_buffers(texts)
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
        inside = np.ones(256, dtype=bool)
        inside[list(delimiters)] = False
        self.data, self.offsets = data, offsets
        word = inside[data]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | begins[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | begins[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = np.empty(len(self.start), dtype=U)
        at = 0
        while at < len(self.start):
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + _CHUNK, side="right")))
            part = fold[data[lo:self.end[to - 1]]].astype(U)
            self.hashes[at:to] = mix(_runs(part, self.start[at:to] - lo, self.end[at:to] - lo))
            at = to

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each position; the last k - 1 positions of
        a text reach past its end and must be left out by the caller."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, dtype=U)
        out = np.empty(n - k + 1, dtype=U)
        for lo in range(0, len(out), _CHUNK):
            hi = min(lo + _CHUNK, len(out))
            s = np.arange(hi - lo)
            out[lo:hi] = mix(_runs(self.hashes[lo:hi + k - 1], s, s + k))
        return out

    def text_hash(self, t: int) -> int:
        """Hash of all words of one text."""
        part = self.hashes[self.first[t]:self.first[t + 1]]
        return int(mix(_runs(part, np.array([0]), np.array([len(part)])) + U(len(part)))[0])


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about ``max_bytes`` of text each."""
    if batch.num_rows == 0:
        return
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset + 1:]
    base, at = int(ends[0]) if len(ends) else 0, 0
    base = int(np.frombuffer(texts.buffers()[1], dtype=np.int64, count=1 + texts.offset)[texts.offset])
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        base, at = int(ends[to - 1]), to
