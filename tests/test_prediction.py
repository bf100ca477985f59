"""Model tables, prediction and evaluation on hand-computed cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cellpath.operators import clustering as C
from cellpath.operators import joins
from cellpath.operators.evaluation import rank_hits, top_k_hit_rate
from cellpath.operators.model import model_count, model_from_counts, nested_model
from cellpath.operators.prediction import best_model, model_scores, pooled_model_bytes, predict
from cellpath.operators.sampling import past_and_future, sample_sequences, train_test_split
from cellpath.plans.train import build_model, model_of_points
from helpers import MODEL, SEQUENCES, by_key, vectors

COUNTS = "user_id string, cluster_id int, slot int, cell_id int, freq long"


def _model(spark, cells):
    """Rows ``(cluster, slot, [(cell, prob)])`` of user A."""
    rows = [
        ("A", cluster, slot, rank, cell, 1, prob, 60)
        for cluster, slot, ranked in cells
        for rank, (cell, prob) in enumerate(ranked, start=1)
    ]
    return spark.createDataFrame(rows, MODEL)


def _sequences(spark, rows):
    """Rows ``(user, day, [(minute, cell), ...])``."""
    return past_and_future(spark.createDataFrame([(u, 2024, 1, d, p) for u, d, p in rows], SEQUENCES))


def test_top_cells_and_probabilities(spark):
    counts = spark.createDataFrame([("A", 0, 8, c, f) for c, f in [(9, 2), (2, 1), (7, 3), (4, 2)]], COUNTS)
    model = model_from_counts(counts)
    assert {r["rank"]: (r.cell_id, r.prob) for r in model.collect()} == {1: (7, 3 / 7), 2: (4, 2 / 7), 3: (9, 2 / 7)}
    slots = nested_model(model).first().slots
    assert [(c.cell_id, c.prob) for c in slots[8]] == [(7, 3 / 7), (4, 2 / 7), (9, 2 / 7)]
    assert model_count(model).first().n_models == 1


def test_best_model(spark):
    model = _model(spark, [(0, 8, [(548, 0.6), (587, 0.4)]), (1, 8, [(587, 1.0)])])
    days = {1: 548, 2: 587, 3: 999}
    rows = [("A", d, [(513, c), (520, 1)]) for d, c in days.items()] + [("B", 1, [(513, 548), (520, 1)])]
    sequences = _sequences(spark, rows)
    best = {r.day: (r.cluster_id, r.score) for r in best_model(sequences, model).collect()}
    assert best == {1: (0, 0.6), 2: (1, 1.0), 3: (0, 0.0)}
    scores = {(r.day, r.cluster_id): r.score for r in model_scores(sequences, model).collect()}
    assert scores == {(1, 0): 0.6, (2, 0): 0.4, (2, 1): 1.0}


def test_equal_sums_in_another_order_tie(spark):
    probs = [0.1, 0.2, 0.7]
    model = _model(
        spark,
        [(1, s, [(5, p)]) for s, p in enumerate(probs)] + [(0, s, [(5, p)]) for s, p in enumerate(reversed(probs))],
    )
    sequences = _sequences(spark, [("A", 1, [(0, 5), (60, 5), (120, 5), (180, 5)])])
    assert best_model(sequences, model).first().cluster_id == 0


def test_sample_sequences(spark):
    """Three observed mornings and what the model says for later that day."""
    slots = range(24)
    home = [(0, s, [(548, 0.75), (587, 0.25)]) for s in slots]
    away = [(1, s, [(587, 0.5), (598, 0.3), (549, 0.2)]) for s in slots]
    rows = [
        ("A", 1, [(513, 548), (626, 548), (769, 587), (1104, 0)]),
        ("A", 2, [(333, 550), (588, 548), (992, 548), (1148, 0)]),
        ("A", 3, [(810, 587), (930, 598), (1095, 549), (1173, 0)]),
    ]
    got = {}
    for r in predict(_sequences(spark, rows), _model(spark, home + away)).collect():
        got.setdefault((r.day, r.next_minute), {})[r["rank"]] = (r.cell_id, r.prob)
    assert got == {
        (1, 1104): {1: (548, 0.75), 2: (587, 0.25)},
        (2, 1148): {1: (548, 0.75), 2: (587, 0.25)},
        (3, 1173): {1: (587, 0.5), 2: (598, 0.3), 3: (549, 0.2)},
    }


def test_rank_hits(spark):
    model = _model(spark, [(0, 0, [(548, 0.6), (587, 0.4)]), (0, 1, [(548, 0.6), (587, 0.4)]), (0, 2, [(587, 1.0)])])
    rows = [("A", 1, [(5, 548), (60, 587)]), ("A", 2, [(5, 548), (120, 587)])]
    hits = rank_hits(predict(_sequences(spark, rows), model, keep_unpredicted=True))
    assert {r["rank"]: (r.hits, r.n_predictions, r.hit_rate) for r in hits.collect()} == {1: (1, 2, 0.5), 2: (1, 2, 0.5)}
    assert {r["rank"]: r.hits_up_to_rank for r in top_k_hit_rate(hits).collect()} == {1: 1, 2: 2}
    with_stranger = _sequences(spark, rows + [("B", 1, [(5, 548), (60, -1)])])
    predicted = predict(with_stranger, model, keep_unpredicted=True)
    assert {r.n_predictions for r in rank_hits(predicted).collect()} == {3}
    assert {r.n_predictions for r in rank_hits(predicted, drop_unknown=True).collect()} == {2}
    assert predict(with_stranger, model).where("user_id = 'B'").count() == 0


def test_single_point_sequence_uses_lowest_cluster(spark):
    model = _model(spark, [(2, 1, [(5, 1.0)]), (3, 1, [(6, 1.0)])])
    got = predict(_sequences(spark, [("A", 1, [(60, 5)])]), model).collect()
    assert [(r.cluster_id, r.cell_id) for r in got] == [(2, 5)]


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_pooled_prediction(spark, monkeypatch, limit):
    """Shared models reach the sequences by broadcast or by copies, with equal results."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    days = vectors(spark, [(f"u{u}", d, [rng.choice([2, 3, 4]) for _ in range(24)]) for u in range(5) for d in range(6)])
    points = C.lay_out(days, C.POOLED)
    model = C.checkpoint(model_of_points(points, "kmodes", 3, 2, C.POOLED))
    size = pooled_model_bytes(3, 60, 3)
    sequences = past_and_future(sample_sequences(days))
    got = predict(sequences, model, by=C.POOLED, size=size)
    best = by_key(best_model(sequences, model, by=C.POOLED, size=size).select("user_id", "day", "cluster_id"), "user_id", "day")
    # The same through a plain per-user model that every user has a copy of.
    copies = days.select("user_id").distinct().join(model.drop("pool"), F.lit(True))
    want = predict(sequences, copies)
    assert sorted(map(tuple, got.drop("pool").collect())) == sorted(map(tuple, want.collect()))
    assert len(best) == 30
    scores = model_scores(sequences, model, by=C.POOLED, size=size).drop("pool")
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, model_scores(sequences, copies).collect()))
    # The size is counted where none is given.
    assert sorted(map(tuple, predict(sequences, model, by=["pool"]).collect())) == sorted(map(tuple, got.collect()))


def test_equal_sequences_count_each(spark):
    days = vectors(spark, [("A", d, [5] * 24) for d in range(3)])
    model = C.checkpoint(model_of_points(C.lay_out(days), "kmeans", 1, 1))
    one = past_and_future(sample_sequences(days)).limit(1)
    got = predict(one.union(one).union(one), model, keep_unpredicted=True)
    assert [r.score for r in got.collect()] == [3.0] * 3
    assert rank_hits(got).first().n_predictions == 3
    assert model_scores(one.union(one), model).count() == 2


def test_interval_comes_from_the_model(spark):
    days = vectors(spark, [("A", d, [5] * 24 + [6] * 24) for d in range(3)])
    model = C.checkpoint(model_of_points(C.lay_out(days), "kmeans", 1, 1, interval=30))
    sequences = past_and_future(sample_sequences(days, interval=30))
    assert {(r.next_minute // 720, r.cell_id) for r in predict(sequences, model).collect()} <= {(0, 5), (1, 6)}
    with pytest.raises(Exception, match="30 minutes"):
        predict(sequences, model, interval=60).collect()
    with pytest.raises(Exception, match="mixes"):
        predict(sequences, model.union(model.withColumn("interval_minutes", F.lit(60)))).collect()


def test_prediction_is_one_pass(spark):
    """Sequences stay in their buckets: only the model moves, once, and no aggregate sees a sequence."""
    rng = random.Random(3)
    days = vectors(spark, [(f"u{u}", d, [rng.choice([2, 3, 4]) for _ in range(24)]) for u in range(5) for d in range(6)])
    points = C.lay_out(days)
    model = C.checkpoint(model_of_points(points, "kmeans", 2, 2))
    sequences = past_and_future(sample_sequences(points))
    plan = predict(sequences, model, keep_unpredicted=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    assert plan.index("SortMergeJoin") < plan.index("Exchange")


def test_prediction_takes_batches(spark):
    """Scores come from batches, not from functions over lists in every sequence's row; many users, some without a model, in one batch."""
    rng = random.Random(5)
    rows = [(f"u{u % 40}", c, s, 1 + r, 3 * r + u % 2, 1, p, 60) for u in range(30) for c in (2, 4) for s in range(24) for r, p in enumerate((0.7, 0.3))]
    model = spark.createDataFrame(rows, "user_id string, cluster_id int, slot int, rank int, cell_id int, freq bigint, prob double, interval_minutes int")
    points = [[(60 * s + 5, rng.randrange(5)) for s in sorted(rng.sample(range(24), 4))] for _ in range(120)]
    sequences = _sequences(spark, [(f"u{i % 40}", i, p) for i, p in enumerate(points)])
    predicted = predict(sequences, model, keep_unpredicted=True)
    plan = predicted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    got = {}
    for r in predicted.collect():
        got.setdefault(r.day, []).append((r.cluster_id, r.score, r["rank"], r.cell_id, r.prob))
    for i, past in enumerate(points):
        u = i % 40
        score = sum({u % 2: 0.7, 3 + u % 2: 0.3}.get(c, 0.0) for _, c in past[:-1])
        if u >= 30:
            assert got[i] == [(None, 0.0, None, None, None)]
        else:
            assert sorted(got[i]) == [(2, pytest.approx(score), 1, u % 2, 0.7), (2, pytest.approx(score), 2, 3 + u % 2, 0.3)]


def test_odd_sequences(spark):
    """No past, past without a model's slot, minutes and cells that are null, a slot without cells for the best cluster."""
    model = _model(spark, [(3, 0, [(5, 0.5), (6, 0.5)]), (4, 0, [(5, 1.0)]), (3, 1, [(7, 1.0)])])
    points = "user_id string, day int, past array<struct<minute: int, cell_id: int>>, next_minute int, actual_cell int"
    rows = [("A", 1, None, 60, 7), ("A", 2, [], 0, 5), ("A", 3, [(None, 5), (3, None), (3, 6)], 70, 7), ("A", 4, [(5, 5)], 60, 7), ("A", 5, [(900, 5)], None, 1)]
    sequences = spark.createDataFrame(rows, points)
    found = {}
    for r in predict(sequences, model, keep_unpredicted=True).collect():
        found.setdefault(r.day, []).append((r.cluster_id, r.score, r["rank"], r.cell_id))
    assert found == {
        1: [(3, 0.0, 1, 7)], 2: [(3, 0.0, 1, 5), (3, 0.0, 2, 6)], 3: [(3, 0.5, 1, 7)], 4: [(None, 1.0, None, None)], 5: [(None, 0.0, None, None)],
    }
    assert {r.day: r.cluster_id for r in best_model(sequences, model).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 3}
    assert predict(sequences, model.limit(0)).count() == 0
    assert predict(sequences, model.limit(0), keep_unpredicted=True).count() == 5


def test_vector_of_another_length_is_an_error(spark):
    days = vectors(spark, [("A", d, [5] * 48) for d in range(3)])
    with pytest.raises(Exception, match="without the 24 slots"):
        model_of_points(C.lay_out(days), "kmeans", 1, 1).collect()


def test_probabilities_and_ranks(spark):
    rng = random.Random(6)
    days = vectors(spark, [(f"u{u}", d, [rng.choice(range(2, 9)) for _ in range(24)]) for u in range(4) for d in range(20)])
    model = build_model(days, method="kmeans", k=2, iterations=2)
    groups = model.groupBy("user_id", "cluster_id", "slot").agg(
        F.round(F.sum("prob"), 9).alias("p"), F.max("rank").alias("top"), F.count("*").alias("n"), F.min("prob").alias("least")
    )
    for r in groups.collect():
        assert r.p == 1.0 and r.least > 0 and r.n == r.top <= 3


def test_sampled_points(spark):
    rng = random.Random(7)
    days = vectors(spark, [(f"u{u}", d, [rng.randrange(50) for _ in range(24)]) for u in range(5) for d in range(20)])
    cells = by_key(days, "user_id", "day")
    for r in sample_sequences(days).collect():
        slots = [p.minute // 60 for p in r.points]
        assert len(slots) == 4 == len(set(slots)) and slots == sorted(slots)
        assert [cells[(r.user_id, r.day)][s] for s in slots] == [p.cell_id for p in r.points]
    short = vectors(spark, [("A", 1, [7, 8])])
    assert len(sample_sequences(short, interval=720).first().points) == 2
    assert sample_sequences(days, seed=1).subtract(sample_sequences(days, seed=2)).count() > 0


def test_split_is_stable(spark):
    days = vectors(spark, [(f"u{u}", d, [1]) for u in range(40) for d in range(25)])
    split = by_key(train_test_split(days).drop("cells"), "user_id", "day")
    half = by_key(train_test_split(days.where("day < 9")).drop("cells"), "user_id", "day")
    assert half.items() <= split.items()
    assert 0.75 < sum(split.values()) / len(split) < 0.85
