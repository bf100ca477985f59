"""Fill the unknown start of a day with the cell in which the previous day ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellpath.schema import UNKNOWN_CELL, USER_DAY, USER_MONTH


def backfill(vectors: DataFrame, strict_run: bool = True) -> DataFrame:
    """Replace the leading unknown slots of a day that follows directly on another.

    Months are independent. With ``strict_run`` the first day of a run of days
    passes nothing on, so that a day needs two predecessors in a row; without it,
    one is enough. A day that is unknown throughout passes on what it received.

    One window over at most a month of days per user; no shuffle of its own when
    the vectors come straight from pings.
    """
    by_day = W.partitionBy(*USER_MONTH).orderBy("day")
    before = by_day.rowsBetween(W.unboundedPreceding, -1)

    ends = F.when(~F.exists("cells", lambda c: c != UNKNOWN_CELL), None).otherwise(F.element_at("cells", -1))
    first_day_ends = F.lit(UNKNOWN_CELL) if strict_run else F.coalesce(ends, F.lit(UNKNOWN_CELL))
    known_from = F.array_position(F.transform("cells", lambda c: c != UNKNOWN_CELL), True)
    unknown_slots = F.when(known_from == 0, F.size("cells")).otherwise(known_from - 1).cast("int")

    return (
        vectors.withColumn("follows", F.col("day") - F.lag("day", 1, -1).over(by_day) == 1)
        .withColumn("ends", F.when(F.col("follows"), ends).otherwise(first_day_ends))
        .withColumn("fill", F.last("ends", ignorenulls=True).over(before))
        .withColumn("unknown_slots", F.when(F.col("follows"), unknown_slots).otherwise(0))
        .select(
            *USER_DAY,
            F.when(
                (F.col("unknown_slots") > 0) & (F.col("fill") != UNKNOWN_CELL),
                F.concat(
                    F.array_repeat("fill", F.col("unknown_slots")),
                    F.slice("cells", F.col("unknown_slots") + 1, F.size("cells")),
                ),
            ).otherwise(F.col("cells")).alias("cells"),
        )
    )


def unknown_share(slots: DataFrame) -> DataFrame:
    """Share of unknown cells per slot of the day."""
    unknown = F.sum(F.when(F.col("cell_id") == UNKNOWN_CELL, 1).otherwise(0))
    return slots.groupBy("slot").agg(
        F.count("*").alias("n_days"),
        unknown.alias("n_unknown"),
        (unknown.cast("double") / F.count("*")).alias("unknown_share"),
    )
