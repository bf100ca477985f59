"""Pack token sequences into as few fixed-size sequences as possible by minimum bin slack.

Pieces of equal length are interchangeable, so the plan needs only the number of pieces of each length
(at most ``capacity`` numbers). A bin starts with the longest length left; a bitset of reachable sums over
the lengths left (Python integers of ``capacity`` bits) gives the fullest feasible combination with it, which is
then taken out as often as the counts allow. Each combination uses up one of its lengths to
fewer than it needs, so there are at most ``capacity * (ln(capacity) + 1)`` combinations whatever the
input: the plan is bounded and is broadcast. Pieces are then placed by their rank among those of their length.

Null text is empty: its piece is the end id alone. Rows with equal ids are packed each. Empty tables give empty
results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpath.llm.files import partition_index
from cellpath.llm.staged import keep, stage
from cellpath.llm.tokens import encoder, with_end
from cellpath.llm.words import slices

CAPACITY = 4096

Combination = list[tuple[int, int]]


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> Combination:
    """(length, uses) of the fullest bin that holds the longest length left.

    ``lengths`` are those left, descending. Sums reachable with each further length are kept as a bitset;
    the search stops when the bin can be full, and walks back through the bitsets.
    """
    first = lengths[0]
    room = capacity - first
    within = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length] - (length == first), room // length)
        before, times = reach, 1
        while left > 0:  # powers of two, then the rest: any number of uses up to ``left``
            times = min(times, left)
            reach |= (reach << (length * times)) & within
            left -= times
            times *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    uses = {first: 1}
    for length, before in reversed(steps):
        while not before >> target & 1:
            target -= length
            uses[length] = uses.get(length, 0) + 1
    return sorted(uses.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Combination, int]]:
    """Combinations and how often each is used; together they hold every piece."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        found = fullest(lengths, counts, capacity)
        times = min(counts[k] // n for k, n in found)
        out.append((found, times))
        for k, n in found:
            counts[k] -= n * times
        if any(not counts[k] for k, _ in found):
            lengths = [k for k in lengths if counts[k]]
    return out


class Places:
    """For each length, which ranks go to which combination."""

    def __init__(self, combinations: list[tuple[Combination, int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        bins = 0
        for found, times in combinations:
            offset = 0
            for length, uses in found:
                rows.setdefault(length, []).append((seen.get(length, 0), uses, bins, offset))
                seen[length] = seen.get(length, 0) + uses * times
                offset += length * uses
            bins += times
        self.rows = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        values, begins = np.unique(length[order], return_index=True)
        for value, at in zip(values, np.split(order, begins[1:])):
            base, uses, bins, offsets = self.rows[int(value)]
            i = np.searchsorted(base, rank[at], "right") - 1
            step = rank[at] - base[i]
            sequence[at] = bins[i] + step // uses[i]
            offset[at] = offsets[i] + step % uses[i] * value
        return sequence, offset


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document: slab (task), place in it, doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slab, done = encoder(tokenizer, False).encode, partition_index(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = with_end(*encode(part["text"]), end_id)
                size = np.diff(at)
                number = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                flat = np.ascontiguousarray(ids, "<u4")
                low = at[row] + start
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(low, low + length)]
                yield pa.RecordBatch.from_pydict({
                    "slab": pa.array(np.full(len(row), slab), pa.int64()),
                    "nth": pa.array(done + np.arange(len(row)), pa.int64()),
                    "doc_id": part["doc_id"].take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })
                done += len(row)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "slab long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces (with ``slab``, ``nth`` and ``length``).

    Ranks within a length come from counts by slab and length, so a length that many pieces share
    is ranked in as many tasks as there are slabs.
    """
    spark = pieces.sparkSession
    counts = keep(pieces.groupBy("length", "slab").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "slab", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("slab", "length").orderBy("nth")
    ranked = pieces.withColumn("within", F.row_number().over(within) - 1).join(bases.hint("merge"), ["slab", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["base"].to_numpy() + batch["within"].to_numpy()
            sequence, offset = places.value.of(batch["length"].to_numpy(), rank)
            yield pa.RecordBatch.from_arrays(
                [batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenize, cut at ``capacity`` where longer, and pack."""
    return pack(stage(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)
