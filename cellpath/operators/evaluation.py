"""Compare ranked predictions with what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellpath.schema import UNKNOWN_CELL


def mark_hits(predictions: DataFrame) -> DataFrame:
    """``hit`` is 1 where the predicted cell is the actual one."""
    return predictions.withColumn("hit", F.when(F.col("cell_id") == F.col("actual_cell"), 1).otherwise(0))


def rank_hits(predictions: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """Hits per rank. ``n_predictions`` is the number of sequences, also of those without
    a model, so ``predictions`` has to come with ``keep_unpredicted=True``.

    Every sequence has exactly one row with rank 1 or without a rank; counting those
    in the same aggregate saves a second pass.
    """
    if drop_unknown:
        predictions = predictions.where(F.col("actual_cell") != UNKNOWN_CELL)
    per_rank = mark_hits(predictions).groupBy("rank").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    # At most top_k + 1 rows are left here.
    first = F.when(F.coalesce("rank", F.lit(1)) == 1, F.col("n"))
    return (
        per_rank.withColumn("n_predictions", F.sum(first).over(W.partitionBy()))
        .where("rank IS NOT NULL")
        .select("rank", "hits", "n_predictions", (F.col("hits").cast("double") / F.col("n_predictions")).alias("hit_rate"))
    )


def top_k_hit_rate(hits: DataFrame) -> DataFrame:
    """Share of sequences whose actual cell is among the first ``rank`` predictions."""
    so_far = F.sum("hits").over(W.orderBy("rank"))
    return hits.select(
        "rank", so_far.alias("hits_up_to_rank"), "n_predictions",
        (so_far.cast("double") / F.col("n_predictions")).alias("hit_rate"),
    )
