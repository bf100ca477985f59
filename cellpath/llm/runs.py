"""Periodic runs: stretches of words that repeat with a period, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least ``max(LEAST, TIMES * q)``
that no word beside it extends. Texts of a batch are one array of symbols, a word of one text never equal to one of another, so all steps
are over whole arrays and no match leaves its text:

* Prefix doubling sorts the suffixes. After the round for length b the suffixes that begin alike form ranges of the suffix
  array, which for blocks of b words at multiples of b (dyadic blocks) are noted if a block comes twice.
* A wavelet matrix over the suffix array answers range successor queries: the next occurrences of a block within b words, and those
  in the b words after that. A run of period q holds a block of more than 3/4 q words that comes again q words later.
* Occurrences in a window of b words are one arithmetic progression. In the first window its difference is the candidate
  period. In the second, one or two occurrences are candidates by their distance; of more, with difference e, the
  distance at which the stretches of period e around both occurrences begin alike or end alike.
* Candidates are extended to both sides by hashes of stretches and binary search. Of equal stretches the smallest period
  counts. Each run is compared word by word at last; should a hash have erred, it is extended word by word.

A run keeps its first q words when a text is collapsed; a word that lies behind the first q words of any run goes, and the
words that stay are joined by one space. Null and empty texts have no words, no runs and an empty collapsed text. A text is the unit of work: its
memory grows with its length (about 100 bytes a word and 4 bytes for each bit of the number of words). Repeated rows each give a row, null ids too.
An empty table gives an empty result; other columns are ignored, whatever their names. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.llm.words import NOT_SPACE, Words, mix, ragged, slices

LEAST = 6
TIMES = 4

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_DOC = np.uint64(0xD1B54A32D192ED03)


def _symbols(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number per distinct word of a text."""
    return np.unique(mix(hashes + mix((row + 1).astype(np.uint64) * _DOC)), return_inverse=True)[1]


class Blocks:
    """Suffix array of ``symbols`` as far as pairs repeat, and the ranges of repeated dyadic blocks in it.

    ``suffixes`` holds the places whose two first symbols come more than once, in order of their suffixes; block i has ``size[i]`` symbols
    from ``at[i]`` on, and ``suffixes[low[i]:high[i]]`` begin like it.
    """

    def __init__(self, symbols: np.ndarray, place: np.ndarray):
        """``place`` is the number of a symbol in its text."""
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, np.int64)
        slots = np.arange(n)
        first = np.concatenate([[True], symbols[order[1:]] != symbols[order[:-1]]]) if n else np.zeros(0, np.bool_)
        rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
        active, slots = self._repeated(order, slots, first)
        suffix_at = None
        found = []
        half = 1
        while len(active):
            after = np.where(active + half < n, rank[np.minimum(active + half, n - 1)] + 1, 0)
            sort = np.lexsort((after, rank[active]))
            active, after = active[sort], after[sort]
            old = rank[active]
            first = np.concatenate([[True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])])
            rank[active] = np.maximum.accumulate(np.where(first, slots, 0))
            half *= 2
            again, again_slots = self._repeated(active, slots, first)
            if half == 2:
                suffix_at, suffixes = again_slots, again.copy()
            else:
                suffixes[np.searchsorted(suffix_at, slots)] = active
            active, slots = again, again_slots
            if len(active):
                start = np.searchsorted(suffix_at, rank[active])
                edges = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1], [True]]))
                count = np.repeat(np.diff(edges), np.diff(edges))
                whole = place[active] % half == 0
                found.append((active[whole], np.full(int(whole.sum()), half), start[whole], (start + count)[whole]))
        self.suffixes = np.zeros(0, np.int64) if suffix_at is None else suffixes
        self.at, self.size, self.low, self.high = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4

    @staticmethod
    def _repeated(order: np.ndarray, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of groups of more than one; ``first`` marks where each group begins."""
        alone = first & np.concatenate([first[1:], [True]])
        return order[~alone], slots[~alone]


class WaveletMatrix:
    """Numbers below ``top`` in a fixed order; counts and ranks within any range of places in one step a bit, for many ranges at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.top = top
        self.levels = []
        for bit in range(int(top).bit_length() - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]), int(zero.sum())))
            values = np.concatenate([values[zero], values[~zero]])

    def less(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers at places ``low`` to ``high`` are below ``x``."""
        x = np.minimum(x, self.top)
        total = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in self.levels:
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = (x >> bit) & 1 == 1
            total += np.where(one, b - a, 0)
            low, high = np.where(one, n_zeros + low - a, a), np.where(one, n_zeros + high - b, b)
        return total

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number of rank ``k`` (from 0) at places ``low`` to ``high``; there must be one."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in self.levels:
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = k >= b - a
            value |= np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, n_zeros + low - a, a), np.where(one, n_zeros + high - b, b)
        return value


class _Stretches:
    """Equality of stretches of symbols by polynomial hashes; may err only by taking unequal ones for equal."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        steps = np.full(n + 1, _BASE)
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64) + _DOC) * self.power[:n], out=self.sums[1:])
        self.n = n

    def _equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[i + n] - self.sums[i]) * self.power[j - i] == self.sums[j + n] - self.sums[j]

    def _reach(self, most: np.ndarray, equal) -> np.ndarray:
        """The largest length up to ``most`` that is equal, by binary search."""
        n = np.zeros(len(most), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            longer = n + (1 << bit)
            ok = longer <= most
            ok[ok] = equal(np.flatnonzero(ok), longer[ok])
            n[ok] = longer[ok]
        return n

    def around(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch of a period that holds ``at`` and ``at + period``, whose symbols are equal."""
        other = at + period
        ahead = self._reach(self.n - other, lambda k, n: self._equal(at[k], other[k], n))
        back = self._reach(at, lambda k, n: self._equal(at[k] - n, other[k] - n, n))
        return at - back, other + ahead


def _candidates(blocks: Blocks, matrix: WaveletMatrix, stretches: _Stretches) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of pairs of equal blocks among which every run has one of its period."""
    at, size, low, high = blocks.at, blocks.size, blocks.low, blocks.high
    below = matrix.less(low, high, at + 1)
    near = matrix.less(low, high, at + size + 1)
    far = matrix.less(low, high, at + 2 * size + 1)
    places, periods = [], []

    def nth(which: np.ndarray, k: np.ndarray) -> np.ndarray:
        return matrix.smallest(low[which], high[which], k)

    def add(which: np.ndarray, period: np.ndarray) -> None:
        places.append(at[which])
        periods.append(period)

    one = np.flatnonzero(near > below)
    add(one, nth(one, below[one]) - at[one])
    one = np.flatnonzero(far > near)
    add(one, nth(one, near[one]) - at[one])
    two = np.flatnonzero(far > near + 1)
    add(two, nth(two, near[two] + 1) - at[two])
    many = np.flatnonzero(far > near + 2)
    if len(many):
        there = nth(many, near[many])
        step = nth(many, near[many] + 1) - there
        start, end = stretches.around(at[many], step)
        other_start, other_end = stretches.around(there, step)
        for gap in (other_start - start, other_end - end):
            fits = (gap > size[many]) & (gap <= 2 * size[many])
            add(many[fits], gap[fits])
    return np.concatenate(places), np.concatenate(periods)


def _exact(symbols: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch around ``at`` by comparing words."""
    start, end = at, at + period
    while end < len(symbols) and symbols[end] == symbols[end - period]:
        end += 1
    while start > 0 and symbols[start - 1] == symbols[start - 1 + period]:
        start -= 1
    return start, end


def find_runs(symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of an array of symbols, by start and period; ``place`` numbers the symbols of each text."""
    none = (np.zeros(0, np.int64),) * 3
    blocks = Blocks(symbols, place)
    if not len(blocks.at):
        return none
    stretches = _Stretches(symbols)
    at, period = _candidates(blocks, WaveletMatrix(blocks.suffixes, len(symbols)), stretches)
    if not len(at):
        return none
    start, end = stretches.around(at, period)
    long = end - start >= np.maximum(LEAST, TIMES * period)
    at, period, start, end = at[long], period[long], start[long], end[long]
    for i in np.unique(np.stack([start, end, period]), axis=1, return_index=True)[1]:
        s, e, q = start[i], end[i], period[i]
        if not np.array_equal(symbols[s : e - q], symbols[s + q : e]):
            same = (start == s) & (end == e) & (period == q)
            for k in np.flatnonzero(same):
                start[k], end[k] = _exact(symbols, int(at[k]), int(q))
    long = end - start >= np.maximum(LEAST, TIMES * period)
    found = np.unique(np.stack([start[long], end[long], period[long]]), axis=1)
    first = np.ones(found.shape[1], np.bool_)
    first[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    start, end, period = found[:, first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _collapsed(words: Words, keep: np.ndarray) -> pa.Array:
    """Words that stay, joined by one space, per row."""
    row = words.row_of_word()[keep]
    start, size = words.starts[keep], (words.ends - words.starts)[keep]
    gap = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, np.bool_)
    end = np.cumsum(size + gap)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    out[ragged(end - gap - size, size)] = words.data[ragged(start, size)]
    offsets = np.concatenate([[0], end])[np.searchsorted(row, np.arange(len(words.rows)))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.rows) - 1, pa.py_buffer(offsets), pa.py_buffer(out.tobytes()))


_RUNS = "array<struct<start: long, length: long, period: long>>"


def _of_batch(part: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(part["text"], NOT_SPACE, lower=False)
    row = words.row_of_word()
    place = np.arange(len(row)) - words.rows[:-1][row]
    start, end, period = find_runs(_symbols(words.hashes, row), place)
    dropped = np.zeros(len(row) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    keep = np.cumsum(dropped)[:-1] == 0
    of = row[start]
    runs = pa.StructArray.from_arrays(
        [pa.array(place[start], pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], names=["start", "length", "period"]
    )
    offsets = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            part["doc_id"],
            pa.array(words.counts(), pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), runs),
            _collapsed(words, keep).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period; starts are word numbers) and the collapsed text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _of_batch(part)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and SHA-256 of all runs and of the collapsed text."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
