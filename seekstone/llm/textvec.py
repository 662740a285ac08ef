"""Words and hashes of many texts at once, on the bytes of Arrow string arrays.

Nothing here loops over words in Python: word bounds, hashes and shingles of a whole chunk of texts
come from array operations on its bytes. Texts are cut into chunks by size, never within a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that are handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Rows that go to a Python worker at once: whole texts, of which a worker holds several copies.
ROWS_AT_ONCE = 1000
SHINGLE_WORDS = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_SHINGLE_FACTORS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def bound_batches(spark: SparkSession) -> None:
    """Let Python workers get few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least n of them."""
    known = _powers[base]
    if len(known) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and the offset of each text, and the end."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, idle ones too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of stretches of about ``most`` bytes."""
    raw, at = texts(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end
    give_back()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk of texts, A-Z in lower case."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[raw]
        inside = ~SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]  # texts also end words where no space stands
        first[filled] = inside[filled]
        last[filled[1:] - 1] = inside[filled[1:] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Of each text, its first word; one more for the end.
        self.bounds = np.searchsorted(self.start, offsets)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's lower-cased bytes."""
        n = len(self.low)
        summed = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.low] * _power(_BASE, n + 1)[:n], out=summed[1:])
        h = (summed[self.end] - summed[self.start]) * _power(_BASE_INVERSE, n + 1)[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(48)))

    def strings(self) -> list[bytes]:
        raw = self.low.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def shingle_sets(words: Words, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles of ``size`` words.

    With fewer words, the whole sequence is one shingle; without words there is none.
    """
    h = words.hashes()
    n = max(0, len(h) - size + 1)
    at = np.zeros(n, np.uint64)
    for k in range(size):
        at += h[k : k + n] * _SHINGLE_FACTORS[k]
    at = mix(at)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= size:
            found = np.sort(at[a : b - size + 1])
            keep = np.ones(len(found), bool)
            keep[1:] = found[1:] != found[:-1]
            yield found[keep]
        elif b > a:
            short = (h[a:b] * _SHINGLE_FACTORS[size : size + b - a]).sum(dtype=np.uint64)
            yield mix(np.asarray([short ^ np.uint64(b - a)]))
        else:
            yield np.zeros(0, np.uint64)
