"""Clustering of day vectors: k-means with truncated means, and k-modes.

Days are clustered per user (``PER_USER``) or all together (``POOLED``). The centres
of a group are one small row, ``centres array<struct<cluster_id, cells>>``.

Points are laid out once (:func:`lay_out`) and never shuffled again. Per user all
days of a user share a bucket, which the calendar bounds: one vector per day,
however many pings it came from. So the days of a user and the user's centres meet in one task, which runs the
rounds until nothing changes: one pass over the points instead of one a round.

Pooled points are spread by day and packed, a row for a batch of them. A round is one pass over these rows that carries each point's cluster and distance
bounds (:mod:`cellpath.operators.rounds`); sums, or counts of cells, change by the points that changed cluster; centres, ``k`` times the slots, are known
to the driver. Rounds end early when no point moves or no centre changes: all further rounds would give the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellpath.functions.distance import Distance, squared
from cellpath.functions.hashing import digest, digest_int
from cellpath.functions.ranking import cell_of_count, count_key
from cellpath.operators import rounds as R
from cellpath.schema import SEED, USER_DAY
from cellpath.session import bucketed_table, checkpoint
from cellpath.ship import ship

PER_USER = ("user_id",)
POOLED = ("pool",)

# Up to this many slots a vector is built with one aggregate column per slot.
WIDE_SLOTS = 96


def lay_out(points: DataFrame, by: Sequence[str] = PER_USER) -> DataFrame:
    """Store points the way the iterations read them: by group, or by day when pooled."""
    if tuple(by) == POOLED:
        points = points.withColumn("pool", F.lit(0))
        return bucketed_table(points, USER_DAY, "points")
    return bucketed_table(points, by, "points")


def _point_keys(by: Sequence[str]) -> list[str]:
    return [*by, *[c for c in USER_DAY if c not in by]]


def initial_centres(points: DataFrame, k: int, by: Sequence[str] = PER_USER, seed: int = SEED) -> DataFrame:
    """``k`` random days per group as centres 0..k-1; a smaller group gives all its days.

    Of a pool only days with a draw below a threshold, about twice as many as wanted, leave their tasks. Per user the rank filter
    becomes a group limit before the shuffle; past Spark's limit for that, a user's days
    are still bounded.
    """
    order = ["draw", *USER_DAY]
    drawn = points.withColumn("draw", F.expr(digest(USER_DAY, seed)))
    if tuple(by) == POOLED:
        drawn = _lowest_draws(drawn, k).orderBy(*order).limit(k)
    ranked = (
        drawn.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
        .where(F.col("rank") <= k)
        .select(*by, (F.col("rank") - 1).alias("cluster_id"), "cells")
    )
    return _collect_centres(ranked, by)


def _lowest_draws(drawn: DataFrame, k: int) -> DataFrame:
    """At least the ``k`` rows of the lowest draws, all if there are fewer, and few more: draws are evenly spread."""
    n = drawn.count()
    share = min(1.0, (2 * k + 64) / max(n, 1))
    while share < 1:
        few = drawn.where(F.expr(f"{digest_int('draw', digits=13)} < {int(share * 16**13)}L"))
        if few.count() >= k:
            return few
        share = min(1.0, 2 * share)
    return drawn


def _collect_centres(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group from ``cluster_id, cells`` rows."""
    return rows.groupBy(*by).agg(F.expr("sort_array(collect_list(struct(cluster_id, cells))) AS centres"))


def explode_centres(centres: DataFrame, by: Sequence[str] = PER_USER) -> DataFrame:
    """One row per cluster: ``cluster_id, cells``."""
    return centres.select(*by, F.inline("centres"))


def _checked_cells(slots: int) -> str:
    """The vector, or an error if it has another number of slots than the clustering."""
    message = f"'day vector without the {slots} slots of the interval: ', coalesce(cast(size(cells) as string), 'null')"
    return f"if(size(cells) = {slots}, cells, raise_error(concat({message})))"


def _checked(points: DataFrame, by: Sequence[str], slots: int) -> DataFrame:
    """Keys and cells of points, whose lengths are checked."""
    return points.select(*_point_keys(by), F.expr(_checked_cells(slots)).alias("cells"))


def _matrix(cells: pa.Array | pa.ChunkedArray, slots: int) -> np.ndarray:
    """Cells of all rows as integers, a row each."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks()
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, slots)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), pa.int32()))


def _centre_arrays(centres: list[dict], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cluster ids and centres of a group."""
    found = sorted((c["cluster_id"], c["cells"]) for c in centres)
    return np.array([i for i, _ in found], np.int64), np.array([c for _, c in found], np.int64).reshape(-1, slots)


def _given_centres(column: pa.ChunkedArray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_centre_arrays` of the first row of an Arrow column."""
    if not len(column) or not column[0].is_valid:
        return _centre_arrays([], slots)
    first = column[0].values
    ids, centres = first.field("cluster_id").to_numpy().astype(np.int64), _matrix(first.field("cells"), slots)
    if len(ids) > 1 and not (ids[1:] > ids[:-1]).all():
        return _centre_arrays(first.to_pylist(), slots)
    return ids, centres


_CENTRES = "centres array<struct<cluster_id: int, cells: array<int>>>"


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _meet(points: DataFrame, centres: DataFrame, by: Sequence[str], work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, slots: int) -> DataFrame:
    """``work`` on the points and the centres of every group that has both; groups are bounded by the calendar."""
    ship(points.sparkSession)

    def act(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, start = _given_centres(right["centres"], slots)
        return work(left if len(ids) else left.slice(0, 0), ids, start)

    return points.groupBy(*by).cogroup(centres.select(*by, "centres").groupBy(*by)).applyInArrow(act, schema)


def _nearest(keys: Sequence[str], slots: int, distance: Distance, table: pa.Table | pa.RecordBatch, ids: np.ndarray, centres: np.ndarray):
    """Columns of points with the nearest of the given centres."""
    at, best, _ = R.nearest(_matrix(table["cells"], slots), centres, distance)
    return [*(table[c] for c in keys), pa.array(ids[at] if len(ids) else at, pa.int32()), pa.array(best)]


def assign(
    points: DataFrame,
    centres: DataFrame,
    k: int,
    slots: int,
    by: Sequence[str] = PER_USER,
    distance: Distance = squared,
    rounds: int = 0,
    method: str = "kmeans",
) -> DataFrame:
    """Nearest centre of every point (``cluster_id``, ``distance``); ties go to the lowest id.

    With ``rounds`` the centres of a user move that often before; a pool's are to be moved by :func:`iterate`.
    """
    keys = [*_point_keys(by), "cells"]
    names = [*keys, "cluster_id", "distance"]
    points = _checked(points, by, slots)
    schema = f"{_schema(points, keys)}, cluster_id int, distance long"
    if tuple(by) != POOLED:

        def last(table: pa.Table, ids: np.ndarray, start: np.ndarray) -> pa.Table:
            found = R.run(_matrix(table["cells"], slots), ids, start, rounds, method, distance)
            return pa.table(_nearest(keys, slots, distance, table, found.ids, found.centres), names=names)

        return _meet(points, centres, by, last, schema, slots)
    ids, known = _pool(centres, slots)
    if not len(ids):
        return points.sparkSession.createDataFrame([], schema)
    ship(points.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_nearest(keys, slots, distance, batch, ids, known), names=names)

    return points.mapInArrow(each, schema)


def _pool(centres: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and centres of a pool, on the driver: ``k`` rows of ``slots`` integers."""
    row = centres.select("centres").first()
    return _centre_arrays([c.asDict() for c in row.centres] if row else [], slots)


def _array_of(term: Callable[[int], str], slots: int) -> str:
    return "array(" + ", ".join(term(s) for s in range(slots)) + ")"


_CELLS_BY_SLOT = "transform(sort_array(collect_list(struct(slot, cell_id))), s -> s.cell_id)"


def _vectors(rows: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """``cells`` per key from ``slot, cell_id`` rows."""
    wide = _array_of(lambda s: f"max(if(slot = {s}, cell_id, null))", slots)
    return rows.groupBy(*keys).agg(F.expr(f"{wide if slots <= WIDE_SLOTS else _CELLS_BY_SLOT} AS cells"))


def mean_centres(assigned: DataFrame, slots: int, by: Sequence[str] = PER_USER) -> DataFrame:
    """Integer mean per cluster and slot, truncated towards zero."""
    keys = [*by, "cluster_id"]
    if slots <= WIDE_SLOTS:
        means = _array_of(lambda s: f"cast(sum(cells[{s}]) div count(*) as int)", slots)
        return _collect_centres(assigned.groupBy(*keys).agg(F.expr(f"{means} AS cells")), by)
    long = assigned.selectExpr(*keys, "posexplode(cells) AS (slot, cell_id)")
    means = long.groupBy(*keys, "slot").agg(F.expr("cast(sum(cell_id) div count(*) as int) AS cell_id"))
    return _collect_centres(_vectors(means, keys, slots), by)


def slot_counts(assigned: DataFrame, by: Sequence[str] = PER_USER) -> DataFrame:
    """Number of days per cluster, slot and cell, combined map-side."""
    keys = [*by, "cluster_id"]
    long = assigned.selectExpr(*keys, "posexplode(cells) AS (slot, cell_id)")
    return long.groupBy(*keys, "slot", "cell_id").agg(F.expr("count(*) AS freq"))


def mode_centres(assigned: DataFrame, slots: int, by: Sequence[str] = PER_USER) -> DataFrame:
    """Most frequent cell per cluster and slot; ties go to the smallest cell id."""
    keys = [*by, "cluster_id"]
    most = cell_of_count(f"max({count_key('freq', 'cell_id')})")
    modes = slot_counts(assigned, by).groupBy(*keys, "slot").agg(F.expr(f"{most} AS cell_id"))
    return _collect_centres(_vectors(modes, keys, slots), by)


def _keep_empty(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """New centres, with the old one for a cluster that lost all its points."""
    both = new.withColumnRenamed("centres", "moved").join(old.hint("merge"), list(by))
    return both.selectExpr(
        *by,
        """transform(centres, c -> named_struct('cluster_id', c.cluster_id, 'cells',
             coalesce(element_at(map_from_entries(moved), c.cluster_id), c.cells))) AS centres""",
    )


def step(
    points: DataFrame,
    centres: DataFrame,
    k: int,
    slots: int,
    by: Sequence[str] = PER_USER,
    method: str = "kmeans",
    distance: Distance = squared,
) -> DataFrame:
    """One round: assign every point, then move the centres.

    An empty cluster keeps its centre in k-means and vanishes in k-modes.
    """
    assigned = assign(points, centres, k, slots, by, distance)
    if method == "kmeans":
        return _keep_empty(centres, mean_centres(assigned, slots, by), by)
    if method == "kmodes":
        return mode_centres(assigned, slots, by)
    raise ValueError(f"unknown method {method!r}")


_STATE = "cells binary, was binary, at binary, upper binary, lower binary, moved long"


def _packed(points: DataFrame, slots: int) -> DataFrame:
    """Cells of a pool's points, a row for a batch of points: rounds need nothing else of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _matrix(batch["cells"], slots)
            packed = cells.astype(np.int32)
            if not np.array_equal(packed, cells):
                raise OverflowError("day vector with cells that are no integers of 32 bits")
            if len(packed):
                yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], names=["cells"])

    return _checked(points, POOLED, slots).select("cells").mapInArrow(each, "cells binary")


def _advance(state: DataFrame, ids: np.ndarray, centres: np.ndarray, moves: np.ndarray | None, slots: int, distance: Distance) -> DataFrame:
    """A pool's packed points with their clusters (``at``) and bounds after a round's moves; ``was`` is the cluster before, none in the first round."""
    names = [c.split()[0] for c in _STATE.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                cells = np.frombuffer(block["cells"], np.int32).reshape(-1, slots).astype(np.int64)
                if moves is None:
                    was, found = None, R.assign_all(cells, centres, distance)
                else:
                    was = block["at"]
                    bounds = (np.frombuffer(block[c]).copy() for c in ("upper", "lower"))
                    found = R.assign_again(cells, centres, moves, R.State(np.searchsorted(ids, np.frombuffer(was, np.int64)), *bounds), distance)
                at = ids[found.at].astype(np.int64)
                moved = len(at) if was is None else int(np.count_nonzero(at != np.frombuffer(was, np.int64)))
                row = [block["cells"], was, at.tobytes(), found.upper.astype(np.float64).tobytes(), found.lower.astype(np.float64).tobytes()]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), pa.array([moved], pa.int64())], names=names)

    return state.mapInArrow(each, _STATE)


def _changes(state: DataFrame, slots: int) -> DataFrame:
    """By how much the number of points with a cell changes in the slots of clusters that points joined or left: sums of a block of points."""
    names = ["cluster_id", "slot", "cell_id", "change"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                cells, at = np.frombuffer(block["cells"], np.int32).reshape(-1, slots), np.frombuffer(block["at"], np.int64)
                if block["was"] is None:
                    cluster, sign = at, np.ones(len(at))
                else:
                    was = np.frombuffer(block["was"], np.int64)
                    gone = np.flatnonzero(was != at)
                    cluster, sign = np.concatenate([at[gone], was[gone]]), np.repeat([1.0, -1.0], len(gone))
                    cells = np.concatenate([cells[gone], cells[gone]])
                known, place = np.unique(cells, return_inverse=True)
                if not len(known):
                    continue
                keys = (cluster[:, None] * slots + np.arange(slots)) * len(known) + place.reshape(cells.shape)
                keys, which = np.unique(keys, return_inverse=True)
                change = np.bincount(which.ravel(), np.repeat(sign, slots)).astype(np.int64)
                keys, change = keys[change != 0], change[change != 0]
                columns = [keys // len(known) // slots, keys // len(known) % slots, known[keys % len(known)]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(change)], names=names)

    return state.mapInArrow(each, "cluster_id int, slot int, cell_id int, change long")


class _MeanKeeper:
    """Sums and sizes of a pool's clusters, changed by the points that changed cluster."""

    def __init__(self, slots: int):
        self.slots, self.sums, self.sizes = slots, {}, {}

    def centres(self, state: DataFrame, ids: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        changes = _changes(state, self.slots).groupBy("cluster_id", "slot")
        for r in changes.agg(F.expr("sum(change * cell_id) AS total"), F.expr("sum(change) AS n")).collect():
            self.sums.setdefault(r.cluster_id, [0] * self.slots)[r.slot] += r.total
            if r.slot == 0:
                self.sizes[r.cluster_id] = self.sizes.get(r.cluster_id, 0) + r.n
        new = old.copy()
        for place, i in enumerate(ids.tolist()):
            if self.sizes.get(i):
                new[place] = R.truncated_mean(np.array([self.sums[i]], np.int64), np.array([self.sizes[i]]))[0]
        return ids, new


class _ModeKeeper:
    """How often each cell comes in a slot of a pool's clusters: a table, changed by the points that changed cluster."""

    _KEYS = ["cluster_id", "slot", "cell_id"]

    def __init__(self, slots: int):
        self.slots, self.counts = slots, None

    def centres(self, state: DataFrame, ids: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        changes = _changes(state, self.slots).groupBy(*self._KEYS).agg(F.sum("change").alias("change"))
        if self.counts is None:
            counts = changes.withColumnRenamed("change", "freq")
        else:
            both = self.counts.join(changes.hint("merge"), self._KEYS, "full_outer")
            counts = both.selectExpr(*self._KEYS, "coalesce(freq, 0L) + coalesce(change, 0L) AS freq").where("freq <> 0")
        self.counts = checkpoint(counts)
        most = cell_of_count(f"max({count_key('freq', 'cell_id')})")
        found = self.counts.groupBy("cluster_id", "slot").agg(F.expr(f"{most} AS cell_id")).collect()
        cells: dict[int, list[int]] = {}
        for r in found:
            cells.setdefault(r.cluster_id, [0] * self.slots)[r.slot] = r.cell_id
        held = sorted(cells)
        return np.array(held, np.int64), np.array([cells[i] for i in held], np.int64).reshape(-1, self.slots)


def _pooled_rounds(points: DataFrame, centres: DataFrame, slots: int, iterations: int, method: str, distance: Distance) -> R.Outcome:
    ship(points.sparkSession)
    ids, known = _pool(centres, slots)
    state, moves = _packed(points, slots), None
    keeper = _ModeKeeper(slots) if method == "kmodes" else _MeanKeeper(slots)
    for done in range(1, iterations + 1):
        if not len(ids):
            return R.Outcome(ids, known, done - 1)
        count = Observation()
        state = checkpoint(_advance(state, ids, known, moves, slots, distance).observe(count, F.sum("moved").alias("moved")))
        if not count.get["moved"]:
            return R.Outcome(ids, known, done)
        new_ids, new = keeper.centres(state, ids, known)
        stay = np.searchsorted(ids, new_ids)
        same = len(new_ids) == len(ids) and np.array_equal(new, known)
        ids, moves, known = new_ids, R.moves_of(known[stay], new, distance), new
        if same:
            return R.Outcome(ids, known, done)
    return R.Outcome(ids, known, iterations)


def iterate(
    points: DataFrame,
    centres: DataFrame,
    k: int,
    slots: int,
    iterations: int,
    by: Sequence[str] = PER_USER,
    method: str = "kmeans",
    distance: Distance = squared,
) -> DataFrame:
    """Centres after so many rounds, and ``rounds``: those that were run before nothing changed any more."""
    if method not in ("kmeans", "kmodes"):
        raise ValueError(f"unknown method {method!r}")
    schema = f"{_schema(centres, by)}, {_CENTRES}, rounds int"
    if tuple(by) == POOLED:
        found = _pooled_rounds(points, centres, slots, iterations, method, distance)
        rows = [(0, list(zip(found.ids.tolist(), found.centres.tolist())), found.rounds)] if len(found.ids) else []
        return points.sparkSession.createDataFrame(rows, schema)

    def run(table: pa.Table, ids: np.ndarray, start: np.ndarray) -> pa.Table:
        found = R.run(_matrix(table["cells"], slots), ids, start, iterations, method, distance)
        one = slice(0, 1) if table.num_rows else slice(0, 0)
        pairs = pa.StructArray.from_arrays([pa.array(found.ids, pa.int32()), _lists(found.centres)], names=["cluster_id", "cells"])
        rows = pa.ListArray.from_arrays(pa.array([0, len(found.ids)], pa.int32()), pairs)
        return pa.table([*(table[c].slice(0, one.stop) for c in by), rows.slice(0, one.stop), pa.array([found.rounds][one], pa.int32())], names=[*by, "centres", "rounds"])

    return _meet(_checked(points, by, slots), centres, by, run, schema, slots)
