"""From pings to one vector of dominant cells per user and day.

A ping's cell holds until the next ping; before the first one it is unknown. For
each slot of the day, with ``last`` the slot of the day's last ping:

* from ``last`` on: the cell of the last ping;
* earlier slots without a ping: the cell that holds all through;
* earlier slots with a ping: the cell held longest, lost signal left out. The cell
  carried in and every cell pinged in the slot compete, even with no minute at all.
  Ties: a known cell first, then the smaller id. Nothing left: unknown.

Pings first collapse to one row per user and minute with map-side combine, so
a user or a day with any number of pings ends as at most 1,440 rows. Everything
after that runs in one stage, co-partitioned by user and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from cellpath.functions.ranking import cell_of_dwell, dwell_key, dwell_of
from cellpath.schema import (
    INTERVAL_MINUTES,
    LOST_SIGNAL_CELL,
    UNKNOWN_CELL,
    USER_DAY,
    USER_MONTH,
    slots_per_day,
)
from cellpath.session import shuffle_partitions


def _by_minute() -> WindowSpec:
    return W.partitionBy(*USER_DAY).orderBy("minute_of_day")


def _slot(minute: str, interval: int) -> Column:
    return F.expr(f"cast({minute} div {interval} as int)")


def minute_states(pings: DataFrame, lost_cell: int = LOST_SIGNAL_CELL, *more: Column) -> DataFrame:
    """One row per user, day and minute: the cell that holds on, the smallest known cell seen, and ``more`` aggregates.

    Pings that share a minute with a later one have no dwell, so of them only the
    one that wins a tie at zero can ever matter. The number of partitions is fixed:
    what follows is heavy for its bytes, and coalescing by size would serialise it.
    """
    competes = ~F.col("cell_id").isin(lost_cell, UNKNOWN_CELL)
    return (
        pings.groupBy(*USER_DAY, "minute_of_day")
        .agg(
            F.max_by("cell_id", "ord").alias("cell_id"),
            F.min(F.when(competes, F.col("cell_id"))).alias("low_cell"),
            *more,
        )
        .repartition(shuffle_partitions(pings.sparkSession), *USER_MONTH)
    )


def dwell_segments(pings: DataFrame) -> DataFrame:
    """Stretches of time in one cell, up to the last ping of the day."""
    return minute_states(pings).select(
        *USER_DAY,
        F.lag("minute_of_day", 1, 0).over(_by_minute()).alias("start_minute"),
        F.col("minute_of_day").alias("end_minute"),
        F.lag("cell_id", 1, UNKNOWN_CELL).over(_by_minute()).alias("cell_id"),
    )


def slot_dwell(pings: DataFrame, interval: int = INTERVAL_MINUTES) -> DataFrame:
    """Minutes per user, day, slot and cell, with the cells that were seen for no time at all.

    A minute row gives the time since the row before, cut into slots, to the cell that held, and no time to every cell seen in the minute.
    """
    rows = minute_states(pings, LOST_SIGNAL_CELL, F.collect_set("cell_id").alias("seen")).select(
        *USER_DAY,
        F.lag("minute_of_day", 1, 0).over(_by_minute()).alias("start_minute"),
        F.col("minute_of_day").alias("end_minute"),
        F.lag("cell_id", 1, UNKNOWN_CELL).over(_by_minute()).alias("held"),
        "seen",
    )
    held = f"""transform(sequence(cast(start_minute div {interval} as int), cast(end_minute div {interval} as int)), s -> named_struct(
        'slot', s, 'cell_id', held,
        'dwell', least(end_minute, (s + 1) * {interval}) - greatest(start_minute, s * {interval})))"""
    seen = f"transform(seen, c -> named_struct('slot', cast(end_minute div {interval} as int), 'cell_id', c, 'dwell', 0))"
    pieces = rows.selectExpr(*USER_DAY, f"inline(concat({held}, {seen}))")
    return pieces.groupBy(*USER_DAY, "slot", "cell_id").agg(F.sum("dwell").alias("dwell"))


def _longest(lost_cell: int) -> Column:
    return F.expr(f"max(if(cell_id <> {lost_cell}, {dwell_key('dwell', 'cell_id')}, null))").alias("best")


def dominant_cells(dwell: DataFrame, lost_cell: int = LOST_SIGNAL_CELL) -> DataFrame:
    """The cell held longest per slot, lost signal left out; unknown where nothing else was held."""
    return (
        dwell.groupBy(*USER_DAY, "slot")
        .agg(_longest(lost_cell))
        .selectExpr(
            *USER_DAY, "slot",
            f"coalesce({cell_of_dwell('best')}, {UNKNOWN_CELL}) AS cell_id",
            f"coalesce({dwell_of('best')}, 0) AS dwell",
        )
    )


def _visited_slots(pings: DataFrame, interval: int, lost_cell: int) -> DataFrame:
    """Slots with a ping: ``winner`` by dwell, and ``carry``, the cell that holds on after the slot.

    A minute row can touch its own slot in three ways only: the cell carried up to
    the minute, its own cell up to the end of the slot when no ping follows in it,
    and the tie candidate. Slots without a ping need no row.
    """
    start_of_slot = F.col("slot") * interval
    rows = (
        minute_states(pings, lost_cell)
        .withColumn("slot", _slot("minute_of_day", interval))
        .withColumn("from_minute", F.lag("minute_of_day", 1, 0).over(_by_minute()))
        .withColumn("from_cell", F.lag("cell_id", 1, UNKNOWN_CELL).over(_by_minute()))
        .withColumn("closes_slot", F.lead("slot", 1, -1).over(_by_minute()) != F.col("slot"))
    )

    def piece(cell: Column, dwell: Column, carry: Column) -> Column:
        return F.struct(cell.alias("cell_id"), dwell.alias("dwell"), carry.alias("carry"))

    none = F.lit(None).cast("int")
    pieces = F.array(
        piece(F.col("from_cell"), F.col("minute_of_day") - F.greatest("from_minute", start_of_slot), none),
        piece(
            F.when(F.col("closes_slot"), F.col("cell_id")),
            start_of_slot + interval - F.col("minute_of_day"),
            F.when(F.col("closes_slot"), F.col("cell_id")),
        ),
        piece(F.col("low_cell"), F.lit(0), none),
    )
    per_cell = (
        rows.select(*USER_DAY, "slot", F.inline(pieces))
        .where("cell_id IS NOT NULL")
        .groupBy(*USER_DAY, "slot", "cell_id")
        .agg(F.sum("dwell").alias("dwell"), F.max("carry").alias("carry"))
    )
    return (
        per_cell.groupBy(*USER_DAY, "slot")
        .agg(_longest(lost_cell), F.max("carry").alias("carry"))
        .withColumn("winner", F.expr(f"coalesce({cell_of_dwell('best')}, {UNKNOWN_CELL})"))
    )


def day_vectors(
    pings: DataFrame,
    interval: int = INTERVAL_MINUTES,
    lost_cell: int = LOST_SIGNAL_CELL,
) -> DataFrame:
    """``cells array<int>`` per user and day, one cell per slot."""
    slots = slots_per_day(interval)
    visited = (
        _visited_slots(pings, interval, lost_cell)
        .groupBy(*USER_DAY)
        .agg(F.sort_array(F.collect_list(F.struct("slot", "winner", "carry"))).alias("v"))
    )
    # Each visited slot gives its winner followed by the carried cell up to the next
    # visited slot; the last one gives the carried cell to the end of the day.
    cells = F.expr(f"""
        flatten(concat(
            array(array_repeat({UNKNOWN_CELL}, v[0].slot)),
            transform(v, (x, i) -> if(i + 1 = size(v),
                array_repeat(x.carry, {slots} - x.slot),
                concat(array(x.winner), array_repeat(x.carry, get(v, i + 1).slot - x.slot - 1))))))
    """)
    return visited.select(*USER_DAY, cells.alias("cells"))


def explode_slots(vectors: DataFrame) -> DataFrame:
    """Long form of day vectors: one row per slot."""
    keys = [c for c in vectors.columns if c != "cells"]
    return vectors.select(*keys, F.posexplode("cells").alias("slot", "cell_id"))


def day_slots(pings: DataFrame, interval: int = INTERVAL_MINUTES, lost_cell: int = LOST_SIGNAL_CELL) -> DataFrame:
    return explode_slots(day_vectors(pings, interval, lost_cell))
