"""The model: per cluster and slot the most frequent cells with their probabilities.

One long table, ``cluster_id, slot, rank, cell_id, freq, prob, interval_minutes`` with
the group in front. ``slot`` is a key column, never a position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellpath.operators.clustering import PER_USER
from cellpath.schema import INTERVAL_MINUTES, TOP_K


def top_cells(counts: DataFrame, top_k: int = TOP_K, by: Sequence[str] = PER_USER) -> DataFrame:
    """The ``top_k`` cells per cluster and slot; ties go to the smaller cell id."""
    slot = W.partitionBy(*by, "cluster_id", "slot")
    rank = F.row_number().over(slot.orderBy(F.desc("freq"), F.asc("cell_id")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top_k)


def model_from_counts(
    counts: DataFrame,
    top_k: int = TOP_K,
    by: Sequence[str] = PER_USER,
    interval: int = INTERVAL_MINUTES,
) -> DataFrame:
    """Model table; probabilities are over the kept cells only."""
    kept = F.sum("freq").over(W.partitionBy(*by, "cluster_id", "slot"))
    return top_cells(counts, top_k, by).select(
        *by, "cluster_id", "slot", "rank", "cell_id", "freq",
        (F.col("freq").cast("double") / kept).alias("prob"),
        F.lit(interval).alias("interval_minutes"),
    )


def nested_model(model: DataFrame, by: Sequence[str] = PER_USER) -> DataFrame:
    """One row per cluster: ``slots map<int, array<struct<cell_id, prob>>>``, cells by rank."""
    per_slot = model.groupBy(*by, "cluster_id", "slot").agg(
        F.sort_array(F.collect_list(F.struct("rank", "cell_id", "prob"))).alias("ranked")
    )
    cells = F.transform("ranked", lambda r: F.struct(r["cell_id"].alias("cell_id"), r["prob"].alias("prob")))
    return per_slot.groupBy(*by, "cluster_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", cells.alias("cells"))))).alias("slots")
    )


def model_count(model: DataFrame, by: Sequence[str] = PER_USER) -> DataFrame:
    """Number of clusters that have a model."""
    return model.agg(F.count_distinct(*by, "cluster_id").alias("n_models"))
