"""Arrow text columns as numpy bytes: documents, words, word hashes.

A word's hash mixes its bytes eight at a time, each block into the hash of
those before it, so a chunk of documents costs a few numpy passes. Sums of
powers modulo 2**64 serve only short runs: they collide on complementary
Thue-Morse strings, which needs 1,024 symbols or more.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: anything but the white space of ASCII.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words: digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _P), ("i", _P_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[key] = np.cumprod(steps)
    return _tables["p"], _tables["i"]


Batches = Iterator[pa.RecordBatch]


def task(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving back what a Python worker would else hold until its next task."""

    @wraps(run)
    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        _tables.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, so that what is made of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each row (and the end); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(offsets) else buf, offsets - offsets[0]


def chunks(buf: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about `limit` bytes; one longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of the first word of each row (and the number of words)."""
    mask = table[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(buf)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: The first n bytes of a block of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes beyond which a span is hashed on its own.
_LONG = 64


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 for the bytes of each span; spans of one length up to eight never share one."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    blocks = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place
    out = mix((mix(sizes.astype(np.uint64) + _U(_P))) ^ (blocks[starts] & _KEEP[np.minimum(sizes, 8)]))
    live, done = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
    while len(live):
        block = blocks[starts[live] + done] & _KEEP[np.minimum(sizes[live] - done, 8)]
        out[live] = mix(out[live] ^ block)
        done += 8
        live = live[sizes[live] > done]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 for each word, A-Z lower-cased."""
    return span_hashes(LOWER[buf], starts, ends)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, by the index of its first word; word hashes in, in text order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = words[:n] * _U(_P), _P
    for j in range(1, k):
        factor = factor * _P % (1 << 64)
        out = out + words[j : j + n] * _U(factor)
    return mix(out + _U(k))
