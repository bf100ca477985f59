"""A third of all pings on one user, a third of those in a single minute: same results as SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cellpath.operators import clustering as C
from cellpath.operators import daily, joins
from helpers import PINGS, vectors
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory, sf_dir):
    path = tmp_path_factory.mktemp("hot")
    duckdb.connect().execute(f"""
        COPY (SELECT event_id,
                     CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '2024-01-05 10:17:00' ELSE ts END AS ts,
                     CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
                     event_type, value, props
              FROM read_parquet('{sf_dir}/events.parquet'))
        TO '{path}/events.parquet'""")
    return str(path)


@pytest.mark.parametrize("name", ["daily_sequences", "slot_dwell", "day_slots_backfilled", "kmeans_centres", "rank_hits"])
def test_hot_user(spark, hot_dir, name):
    assert compare(spark, connect(hot_dir), hot_dir, name)[0] == ""


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_hot_minute_with_any_order(spark, monkeypatch, limit):
    """Numbers of 63 bits or more, far apart: a minute is cut into blocks of about equal size by its own quantiles."""
    monkeypatch.setattr(daily, "_BLOCK", 64)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    rows = [("A", 2024, 1, 1, 5 if i % 3 else rng.randrange(9), i % 11, rng.getrandbits(63)) for i in range(6000)]
    rows += [("B", 2024, 1, 1, 5, 3, 1), ("B", 2024, 1, 1, 5, 4, 0), ("A", 2024, 1, 2, 5, 9, 7)]
    pings = spark.createDataFrame(rows, PINGS)
    for df in (pings, pings.withColumn("ord", F.expr("cast(ord as decimal(38,0)) * 8589934592"))):
        blocks = daily._blocked(df).where("user_id = 'A' AND day = 1 AND minute_of_day = 5").groupBy("block").count().collect()
        assert len(blocks) > 20 and max(r["count"] for r in blocks) < 8 * 64
        got = {(r.user_id, r.day, r.seq_no): (r.minute_of_day, r.cell_id) for r in daily.numbered_pings(df).collect()}
        wanted, place = {}, {}
        for user, _, _, day, minute, cell, _ in sorted(rows, key=lambda r: (r[0], r[3], r[4], r[6])):
            n = place[user, day] = place.get((user, day), -1) + 1
            wanted[user, day, n] = (minute, cell)
        assert got == wanted


def test_pooled_start_reads_few_rows(spark):
    """Only days with a low draw meet in one task, and they are the lowest of all."""
    days = vectors(spark, [(f"u{u}", d, [u, d]) for u in range(400) for d in range(20)])
    points = C.lay_out(days, C.POOLED)
    drawn = points.withColumn("draw", F.expr(C.digest(C.USER_DAY, C.SEED)))
    assert C._lowest_draws(drawn, 10).count() < 200
    lowest = [r.cells for r in drawn.orderBy("draw").limit(10).collect()]
    assert [c.cells for c in C.initial_centres(points, 10, C.POOLED).first().centres] == lowest
    assert len(C.initial_centres(points.limit(3), 10, C.POOLED).first().centres) == 3
