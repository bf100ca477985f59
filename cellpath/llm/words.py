"""Words, segments and shingles of whole Arrow text columns as numpy arrays.

Texts stay UTF-8 bytes. A word is a run of bytes of a class; since every class used here treats all
bytes of non-ASCII characters alike, byte runs are character runs. Words are known by a 64-bit hash:
a polynomial over random byte values, finished by a mixer, so two different words of a corpus of
10**8 distinct words share one with a probability of about 3 in 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _classes(member) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[[b for b in range(256) if member(b)]] = True
    return table


#: Bytes of words between ASCII white space.
NOT_SPACE = _classes(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of digits, letters and everything beyond ASCII.
ALNUM = _classes(lambda b: b >= 0x80 or chr(b).isalnum())


@cache
def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z as a-z if ``lower``."""
    values = np.random.default_rng(20240607).integers(1, _MASK, 256, np.uint64, endpoint=True)
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, int(n).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits; one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch[column])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the byte runs ``[starts, ends)``, which are sorted and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    values, i = byte_values(lower), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CHUNK)))
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.multiply(values[data[low:high]], power[: high - low], out=sums[1:])
        np.cumsum(sums, out=sums)
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Words:
    """Words of the rows of a text column: byte runs, hashes, and where each row's begin."""

    def __init__(self, column: pa.Array, member: np.ndarray, lower: bool):
        self.data, self.at = text_bytes(column)
        inside = member[self.data]
        if len(inside):
            before = np.concatenate([[False], inside[:-1]])
            after = np.concatenate([inside[1:], [False]])
            edges = self.at[(self.at > 0) & (self.at < len(inside))]
            before[edges] = False
            after[edges - 1] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.rows = np.searchsorted(self.starts, self.at)
        self.hashes = hash_runs(self.data, self.starts, self.ends, lower)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


@cache
def _places(n: int) -> np.ndarray:
    return np.random.default_rng(77 + n).integers(1, _MASK, n, np.uint64, endpoint=True) | np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` words from each position on; the last ``n - 1`` positions have none."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k, place in enumerate(_places(n)):
        total += hashes[k : k + size] * place
    return mix(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out
