"""Predict the next cell for a whole table of observed sequences.

Input rows hold the sequence key, ``past array<struct<minute, cell_id>>``,
``next_minute`` and, for evaluation, ``actual_cell``. The best model of a sequence is
the one with the highest summed probability of its past points; ties, also at zero,
go to the lowest cluster id. Every input row is a sequence of its own, even where all its columns
equal another's. Slots have the length that the model was built with (``interval_minutes``); another
``interval`` is an error.

The model of a group travels as one row of flat lists. It meets a sequence once, and a batch of sequences is scored at a time: the models
of its groups are sorted by slot and cell, and by slot and cluster, and asked by binary search. A pool's row is stored and known to all tasks
while it is small; a larger one is joined cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cellpath.operators.clustering import PER_USER, POOLED
from cellpath.operators import joins
from cellpath.operators.joins import join_shared
from cellpath.schema import INTERVAL_MINUTES
from cellpath.session import checkpoint
from cellpath.ship import ship

# Sums of probabilities are compared after rounding, so that the order in which
# they were added cannot decide a tie.
SCORE_DIGITS = 12

_NO_MATCH = -1


def _model_bytes(k: int, interval: int, top_k: int) -> int:
    return k * (1440 // interval) * top_k * 64


# Tells apart sequences that are equal in all their columns.
_ROW = "_sequence_row"


# Columns of a model's entries, each a list of a group's index.
_ENTRY = ["slot", "cell_id", "cluster_id", "rank", "prob"]
_INDEX = [*(f"_{c}" for c in _ENTRY), "_lowest_id", "_minutes"]
# An entry of an index, in both its orders.
_ENTRY_BYTES = 64


def model_index(model: DataFrame, by: Sequence[str] = PER_USER, interval: int | None = None) -> DataFrame:
    """One row per group: lists of the columns of its entries (``_slot`` and so on), ``_lowest_id`` and ``_minutes`` of a slot.

    Rows of a group that differ in their interval, or in that asked for, are an error when the index is computed. Everything
    is grouped within the group's own partition: one exchange.
    """
    lists = model.repartition(*by).groupBy(*by).agg(
        F.collect_list(F.struct(*_ENTRY)).alias("entries"),
        F.min("cluster_id").alias("_lowest_id"), F.min("interval_minutes").alias("low"), F.max("interval_minutes").alias("high"),
    )
    wanted = "low" if interval is None else str(interval)
    checked = f"""CASE WHEN low <> high THEN raise_error(concat('the model mixes intervals from ', low, ' to ', high, ' minutes'))
        WHEN low <> {wanted} THEN raise_error(concat('the model has slots of ', low, ' minutes, not {wanted}')) ELSE low END"""
    return lists.selectExpr(*by, *[f"entries.{c} AS _{c}" for c in _ENTRY], "_lowest_id", f"{checked} AS _minutes")


def _numbers(column: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column, 0 for nulls, and which are there."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(kind), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class _Sorted:
    """Entries of models by group, slot and one more number, for binary search."""

    def __init__(self, group: np.ndarray, slot: np.ndarray, value: np.ndarray, rank: np.ndarray):
        self.slots, slot = np.unique(slot, return_inverse=True)
        self.values, value = np.unique(value, return_inverse=True)
        keys = (group * len(self.slots) + slot) * len(self.values) + value
        self.order = np.lexsort((rank, keys))
        self.keys = keys[self.order]

    def find(self, group: np.ndarray, slot: np.ndarray, value: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of an asking row and an entry that fits it."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, other = (np.minimum(np.searchsorted(known, asked), len(known) - 1) for known, asked in ((self.slots, slot), (self.values, value)))
        valid = valid & (group >= 0) & (self.slots[place] == slot) & (self.values[other] == value)
        keys = np.where(valid, (group * len(self.slots) + place) * len(self.values) + other, -1)
        low, high = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(keys)), n), self.order[at]


class _Models:
    """Models of some groups, a row of an index each."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        lists = [_one(rows[f"_{c}"]) for c in _ENTRY]
        self.group = np.repeat(np.arange(rows.num_rows), _numbers(pc.list_value_length(lists[0]))[0])
        slot, self.cell, self.cluster, self.rank = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists[:4])
        self.prob = lists[4].flatten().to_numpy(zero_copy_only=False)
        self.lowest, self.known = _numbers(_one(rows["_lowest_id"]))
        self.minutes = np.maximum(_numbers(_one(rows["_minutes"]))[0], 1)
        self.by_cell = _Sorted(self.group, slot, self.cell, self.rank)
        self.by_cluster = _Sorted(self.group, slot, self.cluster, self.rank)

    def slot(self, minute: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Slots of minutes, truncated towards zero."""
        if not len(self.minutes):
            return minute
        return np.sign(minute) * (np.abs(minute) // self.minutes[group])


def _rounded(scores: np.ndarray) -> np.ndarray:
    """As SQL rounds: halves of the decimal number up."""
    scaled = scores * 10.0**SCORE_DIGITS
    out = np.rint(scaled) / 10.0**SCORE_DIGITS
    near_half = np.abs(scaled - np.floor(scaled) - 0.5) < 0.01 + scaled * 1e-15
    for i in np.flatnonzero(near_half):
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal(1).scaleb(-SCORE_DIGITS), ROUND_HALF_UP))
    return out


def _scored(models: _Models, group: np.ndarray, past: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences (by place), clusters and scores, in this order, wherever a past point meets a cell of a cluster."""
    row = np.repeat(np.arange(len(past)), _numbers(pc.list_value_length(past))[0])
    points = past.flatten()
    fields = dict(zip((f.name for f in points.type), points.flatten()))
    (minute, with_minute), (cell, with_cell) = _numbers(fields["minute"]), _numbers(fields["cell_id"])
    of = group[row]
    which, entry = models.by_cell.find(of, models.slot(minute, of), cell, with_minute & with_cell)
    row, cluster, prob = row[which], models.cluster[entry], models.prob[entry]
    order = np.lexsort((prob, cluster, row))
    row, cluster, prob = row[order], cluster[order], prob[order]
    new = np.ones(len(row), np.bool_)
    new[1:] = (row[1:] != row[:-1]) | (cluster[1:] != cluster[:-1])
    return row[new], cluster[new], _rounded(np.bincount(np.cumsum(new) - 1, prob, minlength=0)) if len(row) else prob


def _best(models: _Models, group: np.ndarray, past: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Best cluster and its score of every sequence of a group with a model: the lowest id wins ties, also where no cluster scores."""
    row, cluster, score = _scored(models, group, past)
    order = np.lexsort((cluster, -score, row))
    row, cluster, score = row[order], cluster[order], score[order]
    first = np.ones(len(row), np.bool_)
    first[1:] = row[1:] != row[:-1]
    best, top = np.where(group >= 0, models.lowest[group] if len(models.lowest) else 0, 0), np.zeros(len(group))
    best[row[first]], top[row[first]] = cluster[first], np.maximum(score[first], 0)
    return best, top


# What a batch gives: places of its rows, and columns.
_Answer = Callable[[_Models, np.ndarray, pa.RecordBatch], tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray | None]]]]


def _all_scores(models: _Models, group: np.ndarray, batch: pa.RecordBatch):
    row, cluster, score = _scored(models, group, batch["past"])
    return row, [(cluster, None), (score, None)]


def _best_scores(models: _Models, group: np.ndarray, batch: pa.RecordBatch):
    best, score = _best(models, group, batch["past"])
    row = np.flatnonzero(group >= 0)
    return row, [(best[row], None), (score[row], None)]


def _ranked(keep_unpredicted: bool) -> _Answer:
    def answer(models: _Models, group: np.ndarray, batch: pa.RecordBatch):
        best, score = _best(models, group, batch["past"])
        minute, valid = _numbers(batch["next_minute"])
        row, entry = models.by_cluster.find(group, models.slot(minute, group), best, valid)
        columns = [best[row], score[row], models.rank[entry], models.cell[entry], models.prob[entry]]
        if not keep_unpredicted:
            return row, [(c, None) for c in columns]
        rest = np.setdiff1d(np.arange(len(group)), row)
        none = np.concatenate([np.zeros(len(row), np.bool_), np.ones(len(rest), np.bool_)])
        columns = [np.concatenate([c, score[rest] if i == 1 else np.zeros(len(rest), c.dtype)]) for i, c in enumerate(columns)]
        return np.concatenate([row, rest]), [(c, None if i == 1 else none) for i, c in enumerate(columns)]

    return answer


def _groups_of(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The group of every row of a batch as a number, and the first row of each."""
    codes = np.zeros(batch.num_rows, np.int64)
    for column in by:
        found = batch[column].dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return codes, np.unique(codes, return_index=True)[1]


def _asked(
    sequences: DataFrame, model: DataFrame, by: Sequence[str], interval: int | None, size: int | None, keep: bool, answer: _Answer, more: Sequence[str]
) -> DataFrame | None:
    """Keys of sequences with the columns ``more`` of the answers of their group's model; nothing where a pool's index is too large to send around.

    With ``keep`` sequences of a group without a model are asked about too.
    """
    spark, sequences, index = sequences.sparkSession, _grouped(sequences, by), model_index(model, by, interval)
    keys = [c for c in sequences.columns if c != "past"]
    types = {c: sequences.schema[c].dataType for c in keys} | {c: model.schema["prob" if c == "score" else c].dataType for c in more}
    arrow = [to_arrow_type(types[c]) for c in more]
    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in [*keys, *more])

    def answers(models: _Models, group: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        row, columns = answer(models, group, batch)
        kept = batch.select(keys).take(pa.array(row))
        return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t, mask=none) for (c, none), t in zip(columns, arrow))], names=[*keys, *more])

    if tuple(by) != POOLED:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, first = _groups_of(batch, by)
                models = _Models(batch.select(_INDEX).take(pa.array(first)))
                yield answers(models, np.where(models.known[group], group, -1), batch)

        ship(spark)
        return sequences.join(index, list(by), "left" if keep else "inner").mapInArrow(each, schema)
    if (size or 0) > joins.BROADCAST_BYTES:
        return None
    # Stored, so that a model that is still to be computed is computed once.
    index = checkpoint(index)
    entries = index.agg(F.sum(F.size("_slot"))).first()[0] or 0
    if 2 * _ENTRY_BYTES * entries > joins.BROADCAST_BYTES:
        return None
    known = index.toArrow()

    def each_of_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, pools = _Models(known), _one(known["pool"])
        for batch in batches:
            group = pc.fill_null(pc.index_in(batch["pool"], value_set=pools, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            if not keep:
                batch, group = batch.filter(pa.array(group >= 0)), group[group >= 0]
            yield answers(models, group, batch)

    ship(spark)
    return sequences.mapInArrow(each_of_pool, schema)


def model_interval(model: DataFrame, interval: int | None = None) -> int:
    """Minutes per slot of a model; an error if its rows differ or another ``interval`` is asked for."""
    low, high = model.agg(F.min("interval_minutes"), F.max("interval_minutes")).first()
    if low != high:
        raise ValueError(f"the model mixes intervals from {low} to {high} minutes")
    if low is not None and interval not in (None, low):
        raise ValueError(f"the model has slots of {low} minutes, not {interval}")
    return low or interval or INTERVAL_MINUTES


def _join_model(rows: DataFrame, lookup: DataFrame, on: Sequence[str], by: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Rows of sequences with those of a large pooled model."""
    return join_shared(rows, lookup, [*by, *on], joins.BROADCAST_BYTES + 1, spread, "left")


def _grouped(sequences: DataFrame, by: Sequence[str]) -> DataFrame:
    if tuple(by) == POOLED and "pool" not in sequences.columns:
        return sequences.withColumn("pool", F.lit(0))
    return sequences


def _scores(sequences: DataFrame, model: DataFrame, interval: int, by: Sequence[str]) -> DataFrame:
    """By joins: per sequence and matching cluster its score; one row without cluster when nothing matches."""
    # The numbers are stored: a task that runs again must not give others.
    sequences = checkpoint(_grouped(sequences, by).withColumn(_ROW, F.monotonically_increasing_id()))
    keys = [c for c in sequences.columns if c != "past"]
    past = sequences.select(*keys, F.inline_outer("past").alias("minute", "cell_id"))
    past = past.withColumn("slot", F.expr(f"cast(minute div {interval} as int)"))
    lookup = model.select(*by, "slot", "cell_id", "cluster_id", "prob")
    return (
        _join_model(past, lookup, ["slot", "cell_id"], by, keys)
        .groupBy(*keys, "cluster_id")
        .agg(F.round(F.sum("prob"), SCORE_DIGITS).alias("score"))
    )


def model_scores(
    sequences: DataFrame,
    model: DataFrame,
    interval: int | None = None,
    by: Sequence[str] = PER_USER,
    size: int | None = None,
) -> DataFrame:
    """Score of every cluster that explains at least one past point of a sequence."""
    found = _asked(sequences, model, by, interval, size, False, _all_scores, ["cluster_id", "score"])
    if found is None:
        return _scores(sequences, model, model_interval(model, interval), by).where("cluster_id IS NOT NULL").drop(_ROW)
    return found


def _best_match(sequences: DataFrame, model: DataFrame, interval: int, by: Sequence[str]) -> DataFrame:
    """By joins: best matching cluster and its score per sequence; no cluster and 0 when nothing matches."""
    scores = _scores(sequences, model, interval, by)
    keys = [c for c in scores.columns if c not in ("cluster_id", "score")]
    # A score of 12 digits and the cluster in one number: larger is better, then the lower id.
    key = f"cast(score * 1e{SCORE_DIGITS} as decimal(26,0)) * {1 << 32}L + ({(1 << 31) - 1}L - cluster_id)"
    best = scores.groupBy(*keys).agg(F.expr(f"max(cast({key} as decimal(38,0))) AS best"), F.expr("coalesce(max(score), 0D) AS score"))
    return best.selectExpr(*keys, f"cast({(1 << 31) - 1}L - cast(best % {1 << 32}L as bigint) as int) AS cluster_id", "score")


def best_model(
    sequences: DataFrame,
    model: DataFrame,
    interval: int | None = None,
    by: Sequence[str] = PER_USER,
    size: int | None = None,
) -> DataFrame:
    """Best cluster and its score per sequence, for every sequence of a group with a model."""
    found = _asked(sequences, model, by, interval, size, False, _best_scores, ["cluster_id", "score"])
    if found is not None:
        return found
    best = _best_match(sequences, model, model_interval(model, interval), by)
    keys = [c for c in best.columns if c not in ("cluster_id", "score")]
    lowest = model.groupBy(*by).agg(F.min("cluster_id").alias("lowest_id"))
    return (
        best.join(F.broadcast(lowest), list(by))
        .select(*keys, F.coalesce("cluster_id", "lowest_id").alias("cluster_id"), "score")
        .drop(_ROW)
    )


def predict(
    sequences: DataFrame,
    model: DataFrame,
    interval: int | None = None,
    by: Sequence[str] = PER_USER,
    size: int | None = None,
    keep_unpredicted: bool = False,
) -> DataFrame:
    """Ranked cells for ``next_minute`` under the best model of each sequence.

    Sequences of a group without a model give no row, or with ``keep_unpredicted``
    one row without a prediction.
    """
    found = _asked(sequences, model, by, interval, size, keep_unpredicted, _ranked(keep_unpredicted), ["cluster_id", "score", "rank", "cell_id", "prob"])
    if found is None:
        return _predict_by_joins(sequences, model, model_interval(model, interval), by, keep_unpredicted)
    return found


def _predict_by_joins(sequences: DataFrame, model: DataFrame, interval: int, by: Sequence[str], keep_unpredicted: bool) -> DataFrame:
    best = _best_match(sequences, model, interval, by)
    keys = [c for c in best.columns if c not in ("cluster_id", "score")]
    wanted = best.select(
        *keys, "score",
        F.coalesce("cluster_id", F.lit(_NO_MATCH)).alias("lookup_id"),
        F.expr(f"cast(next_minute div {interval} as int)").alias("slot"),
    )
    # One group of any size: a single row holds its lowest cluster.
    lowest = model.groupBy(*by).agg(F.min("cluster_id").alias("lowest_id"))
    lookup = (
        model.join(F.broadcast(lowest), list(by))
        .select(
            *by, "slot", "cluster_id", "rank", "cell_id", "prob",
            F.explode(F.expr(
                f"if(cluster_id = lowest_id, array(cluster_id, {_NO_MATCH}), array(cluster_id))"
            )).alias("lookup_id"),
        )
    )
    predicted = _join_model(wanted, lookup, ["slot", "lookup_id"], by, keys)
    if not keep_unpredicted:
        predicted = predicted.where("rank IS NOT NULL")
    return predicted.select(*keys, "cluster_id", "score", "rank", "cell_id", "prob").drop(_ROW)


def pooled_model_bytes(k: int, interval: int, top_k: int) -> int:
    """Upper bound for the size of a pooled model, from its parameters."""
    # A lookup may hold the lowest cluster twice.
    return 2 * _model_bytes(k, interval, top_k)
