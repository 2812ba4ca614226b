"""Vectorised helpers on the UTF-8 bytes of whole texts, for use inside Arrow tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z is lower-cased in hashes. NULL texts are empty.
A task never holds more than one slice of ``SLICE_BYTES`` (or one single longer text) in expanded form.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15 | 1
_UNSTEP = pow(_STEP, -1, 1 << 64)

IN_WORD = np.ones(256, bool)
IN_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[LOWER]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_STEP, _UNSTEP):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > SLICE_BYTES + 1:  # a single very long text: not kept
            return tables
        _powers[:] = tables
    return _powers


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; by sorting, which is faster on long integer arrays than a hash table."""
    ranked = np.sort(values)
    return ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])] if len(ranked) else ranked


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with at most ``size`` bytes of text: (rows, bytes, offsets of each row's text)."""
    for batch in batches:
        texts = batch.column(column)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
            j = min(j, len(texts))
            yield batch.slice(i, j - i), data[ends[i]:ends[j]], ends[i:j + 1] - ends[i]
            i = j
        release()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word offsets of the rows (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-cased word, and the word offsets of the rows."""
    starts, ends, rows = word_bounds(data, offsets)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), rows


def fold_latin(data: np.ndarray) -> np.ndarray:
    """The bytes with accented Latin-1 capitals in lower case; lengths stay."""
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else data
    if not len(lead):
        return data
    data = data.copy()
    after = data[lead + 1]
    data[lead + 1] = np.where((after >= 0x80) & (after <= 0x9E) & (after != 0x97), after + 0x20, after)
    return data


def release() -> None:
    """Give freed memory back to the system: workers live on from stage to stage, and an executor's are counted together."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def pack_rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; a shorter sequence is one run, nothing if it is empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(_STEP) + words[k:len(words) - n + 1 + k])
    return out


def shingle_sets(words: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each row, ascending; a row of fewer words is one shingle, a blank row has none."""
    every = ngrams(words, n) if len(words) >= n else np.zeros(0, np.uint64)
    return [distinct(every[a:b - n + 1]) if b - a >= n else ngrams(words[a:b], n) for a, b in zip(rows.tolist(), rows[1:].tolist())]
