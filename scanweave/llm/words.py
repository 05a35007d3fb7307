"""Vectorised words, word hashes and rolling window hashes over Arrow batches of text.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All functions work on
whole texts: a batch is cut between rows, never inside one.  A null text has no words.

Hashes are Rabin-Karp polynomials modulo 2**64, read off one running sum per batch, so a
window hash costs the same for any window length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BYTE_BASE, WORD_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: malloc_trim of the C library, where it has it.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept per worker and grown by doubling."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, U)
            done = 1
            while done < size:
                step = U(pow(b, done, 1 << 64))
                p[done : 2 * done] = p[:done] * step
                done *= 2
            out.append(p)
        got = _powers[base] = (out[0], out[1])
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base**i, with a leading zero."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[lo:hi], the same wherever these values stand."""
    return (sums[hi] - sums[lo]) * powers(base, len(sums))[1][lo]


class Words:
    """Words of consecutive documents: start and end byte of each, and each document's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if pa.types.is_null(texts.type):
            texts = texts.cast(pa.string())
        arr = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
        offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
        data = arr.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.doc_bytes = offsets - offsets[0]
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~SPACE[buf]
        fresh = inside[:n].copy()
        fresh[1:] &= ~inside[: n - 1]
        cuts = self.doc_bytes[:-1]
        cuts = cuts[cuts < n]
        fresh[cuts] = inside[cuts]
        self.start = np.flatnonzero(fresh)
        # a word ends at the next white space or at its document's end
        last = inside[:n] & ~inside[1:]
        ends = self.doc_bytes[1:]
        ends = ends[ends > 0] - 1
        last[ends] = inside[ends]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.doc_bytes)
        self.counts = np.diff(self.first)

    def only(self, keep: np.ndarray) -> Words:
        """The words of the documents marked in `keep`; their bytes are moved together, nothing is read again."""
        out, sizes = object.__new__(Words), np.diff(self.doc_bytes)
        out.buf = self.buf[np.repeat(keep, sizes)]
        out.doc_bytes = np.concatenate([[0], np.cumsum(sizes[keep])])
        out.counts = self.counts[keep]
        out.first = np.concatenate([[0], np.cumsum(out.counts)])
        moved = np.repeat(self.doc_bytes[:-1][keep] - out.doc_bytes[:-1], out.counts)
        own = np.repeat(keep, self.counts)
        out.start, out.end = self.start[own] - moved, self.end[own] - moved
        return out

    def __len__(self) -> int:
        return len(self.start)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A well-mixed 64-bit hash of each word; the length enters it."""
        sums = running(self.buf.astype(U) + U(1), BYTE_BASE)
        return mix(spans(sums, self.start, self.end, BYTE_BASE) + (self.end - self.start).astype(U) * U(WORD_BASE))

    def window_starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words that lie in one document; windows per document."""
        per = np.maximum(self.counts - k + 1, 0)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.first[:-1], per)
        return at, per


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of x[i:i+k] for each i that has k values, by doubling."""
    if len(x) < k:
        return x[:0]
    width, cur = 1, x
    while width * 2 <= k:
        cur = np.minimum(cur[: len(cur) - width], cur[width:])
        width *= 2
    n = len(x) - k + 1
    return np.minimum(cur[:n], cur[k - width : k - width + n])


def release() -> None:
    """Gives freed memory back to the machine: a worker lives on, and its next task may be another query's."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that a piece has about most_bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        release()


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed values that Spark's long type holds."""
    return x.view(np.int64)
