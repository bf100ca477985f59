"""Day vectors and backfill: hand-traced days, brute force, skew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cellpath.operators import daily, slots
from cellpath.operators.backfill import backfill
from cellpath.schema import slots_per_day
from cellpath.session import checkpoint
from helpers import by_key, pings, slow_backfill, slow_day_vector, vectors


def test_hand_traced_days(spark):
    rows = [
        ("A", 1, 500, 5), ("A", 1, 510, 7), ("A", 1, 545, 1), ("A", 1, 600, 5),
        ("B", 1, 10, 1), ("B", 1, 200, 4), ("B", 1, 250, 1),
        ("C", 1, 60, 3), ("C", 1, 60, 1), ("C", 1, 125, 9),
    ]
    assert by_key(slots.day_vectors(pings(spark, rows)), "user_id") == {
        "A": [-1] * 8 + [7, 7] + [5] * 14,
        "B": [-1, 1, 1, 4] + [1] * 20,
        "C": [-1, 3] + [9] * 22,
    }


def _random_pings(seed, users=40, days=3):
    rng = random.Random(seed)
    rows = []
    for user in range(users):
        for day in range(1, days + 1):
            minutes = sorted(
                rng.choice([rng.randrange(1440), rng.randrange(24) * 60, rng.randrange(480, 500)])
                for _ in range(rng.randrange(1, 15))
            )
            rows += [(f"u{user}", day, m, rng.choice([-1, 1, 1, 2, 3, 70])) for m in minutes]
    return rows


@pytest.mark.parametrize("interval", [60, 30, 480, 10])
def test_matches_brute_force(spark, interval):
    rows = _random_pings(interval)
    days = {}
    for user, day, minute, cell in rows:
        days.setdefault((user, day), []).append((minute, cell))
    want = {key: slow_day_vector(p, interval) for key, p in days.items()}
    assert by_key(slots.day_vectors(pings(spark, rows), interval), "user_id", "day") == want


def test_row_order_does_not_matter(spark):
    df = pings(spark, _random_pings(1))
    shuffled = df.orderBy(F.rand(3)).repartition(7)
    assert by_key(slots.day_vectors(df), "user_id", "day") == by_key(slots.day_vectors(shuffled), "user_id", "day")


def test_every_day_has_all_slots(spark):
    df = slots.day_slots(pings(spark, _random_pings(2)))
    per_day = df.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"))
    assert {(r.n, r.d) for r in per_day.collect()} == {(24, 24)}


def test_slot_dwell_and_dominant_cell(spark):
    rows = [("A", 1, 500, 5), ("A", 1, 510, 7), ("A", 1, 545, 1), ("A", 1, 600, 5)]
    dwell = slots.slot_dwell(pings(spark, rows))
    assert by_key(dwell.where("slot >= 8").select("slot", "cell_id", "dwell"), "slot", "cell_id") == {
        (8, -1): 20, (8, 5): 10, (8, 7): 30, (9, 7): 5, (9, 1): 55, (10, 1): 0, (10, 5): 0,
    }
    best = by_key(slots.dominant_cells(dwell).select("slot", "cell_id"), "slot")
    assert (best[8], best[9], best[10]) == (7, 7, 5)


def test_interval_must_divide_the_day():
    with pytest.raises(ValueError):
        slots_per_day(50)


def test_hot_user_day_collapses_before_it_moves(spark):
    """A day with very many pings leaves the first stage as at most 1,440 rows per task."""
    hot = checkpoint(spark.range(0, 200000, 1, 4).select(
        F.lit("hot").alias("user_id"), F.lit(2024).alias("year"), F.lit(1).alias("month"), F.lit(1).alias("day"),
        (F.col("id") * 7 % 1440).cast("int").alias("minute_of_day"),
        (F.col("id") % 5).cast("int").alias("cell_id"), F.col("id").alias("ord"),
    ))
    assert slots.minute_states(hot).count() == 1440
    plan = slots.day_vectors(hot)._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange")
    assert "partial_max_by" in plan[first_exchange:]
    assert plan.count("Exchange") == 2
    last = max(range(200000), key=lambda i: (i * 7 % 1440, i)) % 5
    assert slots.day_vectors(hot).first().cells[-1] == last


def test_backfill_hand_traced(spark):
    days = [1, 2, 3, 5, 6, 7]
    df = vectors(spark, [("A", d, [-1, -1, 10 * d, -1, 10 * d]) for d in days])
    starts = lambda df: {d: c[:4] for d, c in by_key(df, "day").items()}
    plain = {d: [-1, -1, 10 * d, -1] for d in days}
    assert starts(backfill(df)) == {**plain, 3: [20, 20, 30, -1], 7: [60, 60, 70, -1]}
    assert starts(backfill(df, strict_run=False)) == {
        d: [f, f, 10 * d, -1] for d, f in zip(days, [-1, 10, 20, -1, 50, 60])
    }


def test_backfill_stops_at_the_month(spark):
    df = vectors(spark, [("A", d, [-1, d]) for d in (29, 30, 31)])
    february = df.withColumn("month", F.lit(2)).withColumn("day", F.col("day") - 28)
    got = by_key(backfill(df.unionByName(february)).select("month", "day", "cells"), "month", "day")
    assert got[(1, 31)] == [30, 31]
    assert got[(2, 1)] == [-1, 29]


def test_backfill_brute_force(spark):
    rng = random.Random(5)
    users = {
        f"u{u}": {d: [rng.choice([-1, -1, 4, 5]) for _ in range(3)] for d in rng.sample(range(0, 20), 12)}
        for u in range(30)
    }
    df = vectors(spark, [(u, d, c) for u, days in users.items() for d, c in days.items()])
    want = {(u, d): c for u, days in users.items() for d, c in slow_backfill(days).items()}
    assert by_key(backfill(df), "user_id", "day") == want


def test_no_shuffle_between_slots_and_backfill(spark):
    plan = backfill(slots.day_vectors(pings(spark, _random_pings(1))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_daily_sequences_keep_every_ping(spark):
    rows = [("A", 1, m, m % 7) for m in (5, 5, 5, 9, 9, 30, 30, 31)] + [("B", 2, 0, 3)]
    df = pings(spark, rows)
    parts = daily.daily_sequences(df, part_size=3)
    got = {(r.user_id, r.part_no): [(p.minute, p.cell_id) for p in r.points] for r in parts.collect()}
    day = [(m, c) for u, _, m, c in rows if u == "A"]
    assert got == {("A", 0): day[:3], ("A", 1): day[3:6], ("A", 2): day[6:], ("B", 0): [(0, 3)]}


def test_numbering_across_blocks(spark):
    df = pings(spark, [("A", 1, 5, c) for c in range(20)]).withColumn("ord", F.col("ord") * (1 << 18))
    got = by_key(daily.numbered_pings(df).select("cell_id", "seq_no"), "cell_id")
    assert got == {c: c for c in range(20)}


def test_records_per_user_month(spark):
    df = pings(spark, [("A", 1, 5, 2), ("A", 1, 6, 2), ("A", 2, 5, 2), ("B", 1, 1, 1)])
    got = {r.user_id: (r.n_pings, r.n_days) for r in daily.records_per_user_month(df).collect()}
    assert got == {"A": (3, 2), "B": (1, 1)}
