"""Clustering rounds against hand-computed and brute-force results, in every layout."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpath.functions.distance import Distance, hamming, squared
from cellpath.operators import clustering as C
from cellpath.operators import rounds as R
from cellpath.plans.train import cluster_days, model_of_points
from helpers import slow_rounds, vectors

FOUR = [(1, [1, 1]), (2, [2, 2]), (3, [9, 9]), (4, [10, 11])]


def _centres(df):
    """``{(group, cluster): cells}`` of a centre table."""
    return {(r[0], c.cluster_id): c.cells for r in df.collect() for c in r.centres}


def _start(spark, centres, by=C.PER_USER, group="A"):
    kind = "string" if by == C.PER_USER else "int"
    schema = f"{by[0]} {kind}, centres array<struct<cluster_id: int, cells: array<int>>>"
    return spark.createDataFrame([(group, sorted(centres.items()))], schema)


@pytest.mark.parametrize("method, want", [("kmeans", [9, 10]), ("kmodes", [9, 9])])
def test_one_step(spark, method, want):
    points = C.lay_out(vectors(spark, [("A", d, c) for d, c in FOUR]))
    start = _start(spark, {0: [1, 1], 1: [9, 9]})
    moved = _centres(C.step(points, start, 2, 2, method=method))
    assert moved == {("A", 0): [1, 1], ("A", 1): want}


def test_means_truncate_towards_zero(spark):
    points = C.lay_out(vectors(spark, [("A", 1, [-1, -1]), ("A", 2, [-1, -2]), ("A", 3, [0, -2])]))
    assert _centres(C.step(points, _start(spark, {0: [0, 0]}), 1, 2)) == {("A", 0): [0, -1]}


def test_empty_cluster_stays_or_vanishes(spark):
    points = C.lay_out(vectors(spark, [("A", d, c) for d, c in FOUR]))
    start = _start(spark, {0: [1, 1], 1: [500, 500], 2: [9, 9]})
    assert _centres(C.step(points, start, 3, 2))[("A", 1)] == [500, 500]
    assert ("A", 1) not in _centres(C.step(points, start, 3, 2, method="kmodes"))


def test_ties_and_hamming(spark):
    points = C.lay_out(vectors(spark, [("A", 1, [4, 4]), ("A", 2, [9, 1])]))
    start = _start(spark, {0: [2, 4], 1: [6, 4], 2: [9, 90]})
    assert {r.day: r.cluster_id for r in C.assign(points, start, 3, 2).collect()} == {1: 0, 2: 1}
    nearest = C.assign(points, start, 3, 2, distance=hamming).collect()
    assert {r.day: (r.cluster_id, r.distance) for r in nearest} == {1: (0, 1), 2: (2, 1)}


def test_large_cell_ids_do_not_overflow(spark):
    points = C.lay_out(vectors(spark, [("A", 1, [268435455] * 24)]))
    start = _start(spark, {i: [i] * 24 for i in range(400)})
    got = C.assign(points, start, 400, 24).first()
    assert (got.cluster_id, got.distance) == (399, 24 * (268435455 - 399) ** 2)


def test_distances_beyond_63_bits_are_an_error():
    far = np.array([[1 << 31, 0], [-(1 << 31), 0]])
    with pytest.raises(OverflowError):
        squared.check(far, far)
    hamming.check(far, far)


def test_vectors_of_another_length_are_an_error(spark):
    for by, group in ((C.PER_USER, "A"), (C.POOLED, 0)):
        points = C.lay_out(vectors(spark, [("A", 1, [4, 4, 4])]), by)
        with pytest.raises(Exception, match="day vector without the 2 slots"):
            C.assign(points, _start(spark, {0: [2, 4]}, by, group), 1, 2, by).collect()


def _random_days(seed, users, days, slots):
    rng = random.Random(seed)
    return {
        u: [[rng.choice([-1, 1, 5, 9, 40]) for _ in range(slots)] for _ in range(rng.randrange(2, days))] for u in users
    }


@pytest.mark.parametrize("method", ["kmeans", "kmodes"])
@pytest.mark.parametrize("slots", [4, 144])
def test_rounds_per_user(spark, method, slots):
    data = _random_days(slots, "ABC", 20, slots)
    points = C.lay_out(vectors(spark, [(u, d, c) for u, days in data.items() for d, c in enumerate(days)]))
    start = C.checkpoint(C.initial_centres(points, 3))
    first = _centres(start)
    got = _centres(C.iterate(points, start, 3, slots, 3, method=method))
    want = {}
    for user, days in data.items():
        centres, _ = slow_rounds(days, {i: c for (u, i), c in first.items() if u == user}, 3, method)
        want |= {(user, i): c for i, c in centres.items()}
    assert got == want


@pytest.mark.parametrize("method", ["kmeans", "kmodes"])
@pytest.mark.parametrize("rounds", [1, 2, 9])
def test_rounds_pooled(spark, method, rounds):
    data = _random_days(9, "ABC", 20, 3)
    everything = [c for days in data.values() for c in days]
    points = C.lay_out(vectors(spark, [(u, d, c) for u, days in data.items() for d, c in enumerate(days)]), C.POOLED)
    start = C.checkpoint(C.initial_centres(points, 4, C.POOLED))
    first = {i: c for (_, i), c in _centres(start).items()}
    found = C.iterate(points, start, 4, 3, rounds, C.POOLED, method)
    got = {i: c for (_, i), c in _centres(found).items()}
    want, labels = slow_rounds(everything, first, rounds, method)
    assert got == want
    assert sorted(r.cluster_id for r in C.assign(points, found, 4, 3, C.POOLED).collect()) == sorted(labels)


@pytest.mark.parametrize("by", [C.PER_USER, C.POOLED])
@pytest.mark.parametrize("method", ["kmeans", "kmodes"])
def test_rounds_end_when_nothing_changes(spark, by, method):
    """Centres that a round leaves as they are: further rounds are not run, and would give the same."""
    points = C.lay_out(vectors(spark, [("A", d, c) for d, c in FOUR]), by)
    start = _start(spark, {0: [1, 1], 1: [9, 9]}, by, "A" if by == C.PER_USER else 0)
    found = C.iterate(points, start, 2, 2, 30, by, method).collect()
    assert [r.rounds for r in found] == [2 if method == "kmeans" else 1]
    once = C.iterate(points, start, 2, 2, 1, by, method).collect()
    assert [r.centres for r in once] == [r.centres for r in found]


def test_groups_without_points_or_centres(spark):
    points = C.lay_out(vectors(spark, [("A", 1, [1, 1]), ("B", 1, [2, 2])]))
    start = _start(spark, {0: [1, 1]}).union(_start(spark, {0: [5, 5]}, group="C"))
    assert [r.user_id for r in C.assign(points, start, 1, 2).collect()] == ["A"]
    assert [r.user_id for r in C.iterate(points, start, 1, 2, 3).collect()] == ["A"]
    pool = C.lay_out(vectors(spark, [("A", 1, [1, 1])]).limit(0), C.POOLED)
    none = C.initial_centres(pool, 3, C.POOLED)
    assert C.iterate(pool, none, 3, 2, 3, C.POOLED).count() == 0
    assert C.assign(pool, none, 3, 2, C.POOLED).count() == 0


#: Twice as far downwards as upwards, so no metric.
_uneven = Distance("uneven", lambda x, y: np.where(x > y, 2 * (x - y), y - x), lambda span: 2 * span)


def _without_bounds(distance):
    return Distance(distance.name, distance.term, distance.largest)


@pytest.mark.parametrize("distance", [squared, hamming, _uneven])
@pytest.mark.parametrize("method", ["kmeans", "kmodes"])
def test_bounds_give_what_all_distances_give(method, distance):
    rng = np.random.default_rng(17)
    for _ in range(60):
        slots, k, n = rng.integers(1, 5), rng.integers(1, 12), rng.integers(1, 90)
        spread = int(rng.choice([3, 40, 10**6]))
        cells = rng.integers(-1, spread, (n, slots)) + (rng.integers(0, 4, (n, 1)) * spread)
        start = cells[rng.choice(n, min(k, n), replace=False)]
        found, wanted = (R.run(cells, np.arange(len(start)) * 3, start, 12, method, d) for d in (distance, _without_bounds(distance)))
        assert found.ids.tolist() == wanted.ids.tolist() and found.rounds == wanted.rounds
        assert found.centres.tolist() == wanted.centres.tolist()


def test_bounds_save_distances():
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 9, (3000, 6)) + rng.integers(0, 12, (3000, 1)) * 20
    start, computed = cells[:40], []
    for distance in (_without_bounds(squared), squared):
        computed.append(0)

        def counted(x, y):
            computed[-1] += np.broadcast(x, y).size
            return squared.term(x, y)

        R.run(cells, np.arange(40), start, 20, "kmeans", Distance("counted", counted, squared.largest, distance.metric))
    assert computed[1] < 0.5 * computed[0]


def test_ties_stay_with_the_lowest_id_as_centres_move():
    """A point between two centres goes to the lower id, also once its bounds are carried."""
    cells = np.array([[0], [4], [2], [2], [-6], [10]])
    found = R.run(cells, np.array([0, 1]), np.array([[0], [4]]), 5, "kmeans", squared)
    centres = {0: [0], 1: [4]}
    for _ in range(5):
        centres = slow_rounds(cells.tolist(), centres, 1, "kmeans")[0]
    assert {i: c for i, c in zip(found.ids.tolist(), found.centres.tolist())} == centres


def test_small_group_gives_all_its_days(spark):
    points = C.lay_out(vectors(spark, [("A", 1, [1]), ("A", 2, [2]), *[("B", d, [d]) for d in range(9)]]))
    got = _centres(C.initial_centres(points, 5))
    assert sorted(i for u, i in got if u == "A") == [0, 1]
    assert sorted(i for u, i in got if u == "B") == [0, 1, 2, 3, 4]


def test_model_uses_last_centres_in_kmeans_and_previous_ones_in_kmodes(spark):
    data = _random_days(3, "A", 40, 24)["A"]
    points = C.lay_out(vectors(spark, [("A", d, c) for d, c in enumerate(data)]))
    first = {i: c for (_, i), c in _centres(C.initial_centres(points, 4)).items()}
    for method, rounds in (("kmeans", 3), ("kmodes", 2)):
        labels = slow_rounds(data, first, rounds, method)[1]
        got = {r.day: r.cluster_id for r in cluster_days(points, method, 4, 3).collect()}
        assert got == dict(enumerate(labels))


def test_assignment_never_gets_worse(spark):
    data = _random_days(11, "AB", 30, 24)
    points = C.lay_out(vectors(spark, [(u, d, c) for u, days in data.items() for d, c in enumerate(days)]))
    start = C.checkpoint(C.initial_centres(points, 3))
    moved = C.checkpoint(C.step(points, start, 3, 24))
    before = {(r.user_id, r.day): r for r in C.assign(points, start, 3, 24).collect()}
    after = _centres(moved)
    stale = sum(sum((x - y) ** 2 for x, y in zip(r.cells, after[u, r.cluster_id])) for (u, _), r in before.items())
    fresh = C.assign(points, moved, 3, 24).agg(F.sum("distance")).first()[0]
    assert fresh <= stale


def test_points_are_not_shuffled_in_a_round(spark):
    data = _random_days(1, "ABCD", 9, 24)
    points = C.lay_out(vectors(spark, [(u, d, c) for u, days in data.items() for d, c in enumerate(days)]))
    start = C.checkpoint(C.initial_centres(points, 3))
    for method in ("kmeans", "kmodes"):
        df = C.step(points, start, 3, 24, method=method)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Only centres move, from their checkpoint, and partial sums.
        for line_no, line in enumerate(plan.splitlines()):
            if "Exchange" in line:
                below = plan.splitlines()[line_no + 1:line_no + 3]
                assert any("Scan ExistingRDD" in x or "partial_" in x for x in below), line
        assert "Broadcast" not in plan
        # Every distance is computed in the point's own row.
        assigned = C.assign(points, start, 3, 24)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in assigned and "Aggregate" not in assigned


def test_assigned_days_move_once_for_a_model(spark):
    """The result of a grouped function has no known order: it is dealt out by user once, and counts and ranks follow in place."""
    data = _random_days(1, "ABCD", 9, 24)
    points = C.lay_out(vectors(spark, [(u, d, c) for u, days in data.items() for d, c in enumerate(days)]))
    plan = model_of_points(points, "kmeans", 3, 2)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    above = next(i for i, line in enumerate(lines) if "FlatMapCoGroupsInArrow" in line)
    assert sum("Exchange" in line for line in lines[:above]) == 1


def test_hot_user_does_not_change_results(spark):
    """One user with a third of all days."""
    rng = random.Random(2)
    hot = [("hot", d, [rng.choice([1, 5, 9]) for _ in range(24)]) for d in range(300)]
    rest = [(f"u{u}", d, [rng.choice([1, 5, 9]) for _ in range(24)]) for u in range(60) for d in range(10)]
    points = C.lay_out(vectors(spark, hot + rest))
    model = model_of_points(points, "kmeans", 3, 2)
    assert model.where("rank = 1").groupBy("user_id").agg(F.count_distinct("slot").alias("n")).where("n <> 24").count() == 0
    start = {i: c for (u, i), c in _centres(C.initial_centres(points, 3)).items() if u == "hot"}
    labels = slow_rounds([c for _, _, c in hot], start, 2, "kmeans")[1]
    got = {r.day: r.cluster_id for r in cluster_days(points, "kmeans", 3, 2).where("user_id = 'hot'").collect()}
    assert got == dict(enumerate(labels))


@pytest.mark.parametrize("most", [9, 500, 10**6, 2**29])
def test_squared_distances_by_products(most):
    """Products where they are exact, slot by slot beyond: the same numbers, ties and rounds."""
    rng = np.random.default_rng(most)
    cells, centres = rng.integers(-most if most < 2**28 else 0, most, (300, 24)), rng.integers(0, most, (60, 24))
    centres[7] = centres[3]
    kind = squared.exact(cells, centres)
    assert kind is {9: np.float32, 500: np.float64, 10**6: np.float64, 2**29: None}[most]
    assert squared.exact(np.zeros((2, 24), np.int64), np.full((2, 24), 9)) is np.float32 and hamming.exact(cells, centres) is None
    wanted = squared.table(cells, centres)
    at, best, other = R.nearest(cells, centres, squared)
    assert (at == wanted.argmin(axis=1)).all() and (best == wanted.min(axis=1)).all() and (other == np.sort(wanted, axis=1)[:, 1]).all()
    plain = Distance("plain", squared.term, squared.largest)
    for method in ("kmeans", "kmodes"):
        found, slow = (R.run(cells, np.arange(60) * 2, centres, 9, method, d) for d in (squared, plain))
        assert found.rounds == slow.rounds and found.ids.tolist() == slow.ids.tolist() and (found.centres == slow.centres).all()


def test_pooled_state_is_packed(spark):
    """A round moves blocks of points, not a row a point, and adds up who changed cluster in the block."""
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 6, (500, 24))
    points = C.lay_out(vectors(spark, [(f"u{i % 9}", i // 9, c.tolist()) for i, c in enumerate(cells)]), C.POOLED)
    ids, centres = np.arange(8) * 2, cells[:8]
    state = C.checkpoint(C._advance(C._packed(points, 24), ids, centres, None, 24, squared))
    assert state.count() <= points.rdd.getNumPartitions() < 500 and state.agg(F.sum("moved")).first()[0] == 500
    first = {(r.cluster_id, r.slot, r.cell_id): r.change for r in C._changes(state, 24).groupBy("cluster_id", "slot", "cell_id").agg(F.sum("change").alias("change")).collect()}
    at = ids[squared.table(cells, centres).argmin(axis=1)]
    wanted = {}
    for cluster, day in zip(at.tolist(), cells.tolist()):
        for slot, cell in enumerate(day):
            wanted[cluster, slot, cell] = wanted.get((cluster, slot, cell), 0) + 1
    assert first == wanted
    moved = centres[::-1].copy()
    again = C._advance(state, ids, moved, R.moves_of(centres, moved, squared), 24, squared)
    for r in C._changes(again, 24).groupBy("cluster_id", "slot", "cell_id").agg(F.sum("change").alias("change")).collect():
        wanted[r.cluster_id, r.slot, r.cell_id] = wanted.get((r.cluster_id, r.slot, r.cell_id), 0) + r.change
    after = {}
    for cluster, day in zip(ids[squared.table(cells, moved).argmin(axis=1)].tolist(), cells.tolist()):
        for slot, cell in enumerate(day):
            after[cluster, slot, cell] = after.get((cluster, slot, cell), 0) + 1
    assert {k: n for k, n in wanted.items() if n} == after


def test_unknown_method(spark):
    points = vectors(spark, [("A", 1, [1])])
    with pytest.raises(ValueError):
        cluster_days(points, "other")
