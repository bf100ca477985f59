"""Test sequences and train/test split. Both are row-local: no shuffle, no window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.functions.hashing import digest, digest_int
from cellpath.schema import INTERVAL_MINUTES, PREVIOUS_POINTS, SEED, USER_DAY


_DAY_KEY = f"concat_ws('|', {', '.join(USER_DAY)})"


def sample_sequences(
    vectors: DataFrame,
    previous_points: int = PREVIOUS_POINTS,
    interval: int = INTERVAL_MINUTES,
    seed: int = SEED,
) -> DataFrame:
    """Random points of each day in distinct slots, by time: ``points array<struct<minute, cell_id>>``.

    Draws ``previous_points + 1`` slots, or all when the day has fewer, and a
    random minute in each. The draw of a slot is the md5 of the day's key, the slot
    and the seed: its start orders the slots, eight digits further on give the minute.
    """
    draws = f"""transform(cells, (c, s) -> named_struct(
        'draw', md5(concat(day_key, '|', s, '|{seed}')), 'slot', s, 'cell_id', c))"""
    chosen = f"slice(sort_array({draws}), 1, {previous_points + 1})"
    minute = f"cast(d.slot * {interval} + {digest_int('d.draw', 9)} % {interval} as int)"
    points = f"sort_array(transform({chosen}, d -> named_struct('minute', {minute}, 'cell_id', d.cell_id)))"
    # The outer lambda makes the key once per day instead of once per slot.
    return vectors.select(*USER_DAY, F.expr(f"transform(array({_DAY_KEY}), day_key -> {points})[0] AS points"))


def past_and_future(sequences: DataFrame) -> DataFrame:
    """Split each sequence into ``past`` (all points but the last) and the last one as target."""
    keys = [c for c in sequences.columns if c != "points"]
    return sequences.select(
        *keys,
        F.slice("points", 1, F.size("points") - 1).alias("past"),
        F.element_at("points", -1)["minute"].alias("next_minute"),
        F.element_at("points", -1)["cell_id"].alias("actual_cell"),
    )


def train_test_split(vectors: DataFrame, train_percent: int = 80, seed: int = SEED) -> DataFrame:
    """Mark every day as train or test; a day stays on its side whatever else is in the table."""
    draw = digest_int(digest(USER_DAY, seed))
    return vectors.withColumn("is_train", F.expr(f"{draw} % 100 < {train_percent}"))
