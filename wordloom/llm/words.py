"""Vectorised word splitting and hashing over Arrow string columns.

Executors call these helpers inside ``mapInArrow``.  A batch is cut into slices
of about 1 MB of text, every slice is processed with whole-array numpy calls, and
no Python loop runs over words.  Words never cross a document's end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text that is processed at once.
SLICE_BYTES = 1 << 20


def _return_memory() -> None:
    """Lets the C library give large arrays back when they are freed, so that idle workers stay small."""
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        library.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        return


_return_memory()
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the SplitMix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


def _lower(codes: np.ndarray) -> np.ndarray:
    out = codes.copy()
    out[65:91] = codes[97:123]
    return out


def _spaced() -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def _alphanumeric() -> np.ndarray:
    inside = np.zeros(256, dtype=bool)
    inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


@dataclass(frozen=True)
class Splitter:
    """Which bytes belong to words, and whether A-Z count as a-z.

    All splitters work on UTF-8 bytes: their separators are ASCII, so a
    multi-byte character never splits.
    """

    inside: np.ndarray
    codes: np.ndarray


SPACED = Splitter(_spaced(), _CODES)
SPACED_LOWER = Splitter(_spaced(), _lower(_CODES))
ALNUM_LOWER = Splitter(_alphanumeric(), _lower(_CODES))

_POWERS = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, _SEGMENT + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """The words of some consecutive documents.

    ``starts`` and ``ends`` are byte positions in ``data``; document i has the
    words ``offsets[i]:offsets[i + 1]``; ``hashes`` holds one value per word.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = np.cumsum(lengths, dtype=np.int64), 0
    while begin < batch.num_rows:
        done = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, done + limit, side="right")), begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets in them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, how: Splitter = SPACED) -> Words:
    """Splits every text of an Arrow string column into hashed words."""
    data, bounds = buffer_of(column)
    inside = how.inside[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds), hash_spans(data, starts, ends, how.codes))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """A 64-bit hash of each byte span, spans being in order and disjoint."""
    out, i = np.empty(len(starts), dtype=U64), 0
    while i < len(starts):
        base = starts[i]
        j = max(int(np.searchsorted(ends, base + _SEGMENT, side="right")), i + 1)
        values = codes[data[base : ends[j - 1]]]
        up, down = powers(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * up[:-1], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums for ``span_hash``; values are per-word hashes."""
    up, _ = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total


def span_hash(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences ``begin:end``, from ``prefix_sums``."""
    _, down = powers(len(total))
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and each document's offsets in them.

    A document of fewer than k words, but not none, has its whole sequence as
    one shingle.
    """
    counts = words.counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], n)
    end = np.minimum(begin + k, np.repeat(words.offsets[1:], n))
    out = np.zeros(len(begin), dtype=U64)
    for j in range(k):
        at = begin + j
        live = at < end
        out[live] = (out[live] ^ words.hashes[at[live]]) * U64(_BASE) + U64(j + 1)
    return mix(out), offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values, sorted, and their offsets."""
    v = values.copy()
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        v[begin:end].sort()
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = v[1:] != v[:-1]
    keep[offsets[:-1][offsets[:-1] < len(v)]] = True
    return v[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(U64)


def grouped(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
