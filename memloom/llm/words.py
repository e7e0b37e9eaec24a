"""Word-level building blocks shared by the text operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything here
works on Arrow arrays, so the text never becomes one Python object per word:
Arrow splits and dictionary-encodes it, and Python only sees distinct words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text handled at once inside one Python worker; bounds its memory whatever the batch size.
CHUNK_BYTES = 8 << 20



def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_U64 = np.uint64
_MIX_1, _MIX_2 = _U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


@dataclass
class Words:
    """Words of several texts: ``codes[offsets[i]:offsets[i + 1]]`` index ``distinct``."""

    codes: np.ndarray
    offsets: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The text that each word is from."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash for each distinct word."""
        f = xxhash.xxh3_64_intdigest
        return np.fromiter((f(w, seed) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A-Z folded in a large_string array without nulls.  Works on the buffers: Arrow's own kernel misreads slices."""
    if not len(texts):
        return texts
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at - at[0]), pa.py_buffer(data)])


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none.  ``lower`` folds A-Z alone."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = ascii_lower(texts)
    # A leading or trailing blank, or an empty text, gives an empty string that is no word.
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().cast(pa.large_binary())
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    blank = np.asarray(pc.equal(pc.binary_length(flat), 0))
    if blank.any():
        kept = np.concatenate(([0], np.cumsum(~blank)))
        offsets, flat = kept[offsets], flat.filter(pa.array(~blank))
    encoded = flat.dictionary_encode()
    return Words(np.asarray(encoded.indices, dtype=np.int64), offsets, encoded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = (x ^ (x >> _U64(30))) * _MIX_1
    x = (x ^ (x >> _U64(27))) * _MIX_2
    return x ^ (x >> _U64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that depend on ``seed`` alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15) + _U64(seed)) | _U64(1)


def windows(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Order-sensitive hash of every ``width`` consecutive values (texts are not separated here)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, m in enumerate(multipliers(width, seed)):
        total += values[k : k + n] * m
    return mix(total)


def starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat starts of the ``width``-word windows that stay inside one text, and each start's text."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return offsets[:-1][row] + within, row
