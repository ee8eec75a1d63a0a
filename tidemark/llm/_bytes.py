"""Vectorised text kernels over UTF-8 buffers: splitting into words and hashing them without Python loops.

A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix sums, then mixed.  Texts are
handled in blocks of about ``BLOCK`` bytes cut at separators, so the working memory does not follow the
length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def letters_table() -> np.ndarray:
    """Separators for letter words: every ASCII byte but A-Z and a-z; bytes of other characters join words."""
    table = np.zeros(256, bool)
    table[:128] = True
    table[65:91] = table[97:123] = False
    return table


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse, modulo 2**64."""
    key = "inverse" if inverse else "power"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 65536)
        steps = np.full(size, _P_INV if inverse else _P, np.uint64)
        steps[0] = 1
        have = _powers[key] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n+1 offsets of its texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(buf: np.ndarray, at: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (first text, end text, from, to) of at most about BLOCK bytes; a text that is longer is cut at separators."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        if at[j] - at[i] <= BLOCK:
            yield i, j, int(at[i]), int(at[j])
        else:
            lo, end = int(at[i]), int(at[i + 1])
            while lo < end:
                hi = min(end, lo + BLOCK)
                step = BLOCK
                while hi < end:
                    tail = np.flatnonzero(separators[buf[hi - min(step, hi - lo) : hi]])
                    if len(tail):
                        hi = hi - min(step, hi - lo) + int(tail[-1]) + 1
                        break
                    hi = min(end, hi + BLOCK)
                yield i, i + 1, lo, hi
                lo = hi
        i = j


def words(buf: np.ndarray, at: np.ndarray, separators: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (block bytes, word starts, word ends, text index of each word) block by block, in text order."""
    for i, j, lo, hi in blocks(buf, at, separators):
        b = buf[lo:hi]
        inside = np.empty(len(b) + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.logical_not(separators[b], out=inside[1:-1].view(bool))
        change = np.diff(inside)
        edges = np.clip(at[i + 1 : j] - lo, 0, len(b))
        if len(edges):  # two texts that touch without a separator are still two words
            cut = edges[(edges > 0) & (edges < len(b))]
            cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])
        else:
            cut = edges
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        which = i + np.searchsorted(at[i + 1 : j], starts + lo, "right") if j > i + 1 else np.full(len(starts), i)
        yield b, starts, ends, which


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) times the multiplier's power, before each place."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans of a block; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts])


def word_hashes(buf: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the n+1 offsets of the texts in them."""
    found, which = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b, s, e, w in words(buf, at, separators):
        found.append(spans_hash(prefix_sums(b), s, e))
        which.append(w)
    hashes, which = np.concatenate(found), np.concatenate(which)
    return hashes, np.searchsorted(which, np.arange(len(at)))


def portions(batches: Iterator[pa.RecordBatch], column: int, rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, by rows and by bytes of one string column, so that memory stays low."""
    for batch in batches:
        at = 0
        lengths = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)]))
        while at < len(batch):
            end = min(at + rows, max(at + 1, int(np.searchsorted(lengths, lengths[at] + size, "right")) - 1), len(batch))
            yield batch.slice(at, end - at)
            at = end


def hash_of(word: str | bytes) -> int:
    """The same hash for one word."""
    b = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(spans_hash(prefix_sums(b), np.array([0]), np.array([len(b)]))[0])
