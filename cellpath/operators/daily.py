"""Daily ping sequences and record counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellpath.operators.joins import join_shared
from cellpath.schema import MINUTES_PER_DAY, USER_DAY, USER_MONTH
from cellpath.session import checkpoint

# A minute with about this many pings or more is cut into blocks of about as many.
_BLOCK = 1 << 20
# Pings of a block that are looked at to find where it ends.
_LOOKED_AT = 8

_MINUTE = [*USER_DAY, "minute_of_day"]


def _block_starts(pings: DataFrame) -> DataFrame:
    """``starts`` of the blocks after the first of every minute that has several: every so many of its sampled ``ord``.

    The sample is by hash, so it never changes; of a minute below a block's size it mostly leaves less than a start.
    """
    sample = pings.where(F.pmod(F.xxhash64("ord"), F.lit(max(1, _BLOCK // _LOOKED_AT))) == 0)
    ordered = sample.groupBy(*_MINUTE).agg(F.sort_array(F.collect_list("ord")).alias("looked_at"))
    starts = f"filter(looked_at, (x, i) -> (i + 1) % {_LOOKED_AT} = 0)"
    return ordered.selectExpr(*_MINUTE, f"{starts} AS starts").where("size(starts) > 0")


def _blocked(pings: DataFrame) -> DataFrame:
    """Pings with the number of their ``block`` in the minute, by ``ord``."""
    starts = checkpoint(_block_starts(pings))
    size = starts.agg(F.sum(F.size("starts") * 16 + 64)).first()[0]
    if size is None:
        return pings.withColumn("block", F.lit(0))
    found = join_shared(pings, starts, _MINUTE, size, [*_MINUTE, "ord"], "left")
    # Binary search: the number of starts up to ``ord``.
    step = """if(a.low >= a.high, a, if(get(starts, (a.low + a.high) div 2) <= ord,
        named_struct('low', cast((a.low + a.high) div 2 + 1 as int), 'high', a.high),
        named_struct('low', a.low, 'high', cast((a.low + a.high) div 2 as int))))"""
    block = f"aggregate(sequence(1, 32), named_struct('low', 0, 'high', size(starts)), (a, i) -> {step}).low"
    return found.withColumn("block", F.expr(f"if(starts IS NULL, 0, {block})")).drop("starts")


def numbered_pings(pings: DataFrame) -> DataFrame:
    """Pings with ``seq_no``, their position in the day (from 0) by minute and ``ord``.

    A day may hold any number of pings, with any values of ``ord``, so no task sorts a whole day: a minute with very many is cut into blocks by
    sampled quantiles of its ``ord``. Rows are numbered per block, and a running sum over block counts gives the offset.
    """
    block = [*_MINUTE, "block"]
    blocked = _blocked(pings)
    before = (
        W.partitionBy(*USER_DAY).orderBy("minute_of_day", "block").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = blocked.groupBy(*block).agg(F.count("*").alias("n")).select(
        *block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    in_block = F.row_number().over(W.partitionBy(*block).orderBy("ord")) - 1
    return (
        blocked.withColumn("in_block", in_block)
        .join(offsets, block)
        .select(*_MINUTE, "cell_id", "ord", (F.col("offset") + F.col("in_block")).alias("seq_no"))
    )


def daily_sequences(pings: DataFrame, part_size: int = MINUTES_PER_DAY) -> DataFrame:
    """``points array<struct<minute, cell_id>>`` per user and day, in parts of at most ``part_size``."""
    ordered = F.sort_array(F.collect_list(F.struct("seq_no", "minute_of_day", "cell_id")))
    points = F.transform(
        ordered, lambda p: F.struct(p["minute_of_day"].alias("minute"), p["cell_id"].alias("cell_id"))
    )
    return (
        numbered_pings(pings)
        .withColumn("part_no", F.expr(f"seq_no div {part_size}"))
        .groupBy(*USER_DAY, "part_no")
        .agg(points.alias("points"))
    )


def records_per_user_month(pings: DataFrame) -> DataFrame:
    """Number of pings and of days with pings per user and month, combined map-side."""
    per_day = pings.groupBy(*USER_DAY).agg(F.count("*").alias("n"))
    return per_day.groupBy(*USER_MONTH).agg(F.sum("n").alias("n_pings"), F.count("*").alias("n_days"))
