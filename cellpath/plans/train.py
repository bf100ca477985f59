"""Build a model from day vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cellpath.functions.distance import Distance, squared
from cellpath.operators.clustering import PER_USER, POOLED, assign, initial_centres, iterate, lay_out, slot_counts
from cellpath.operators.model import model_from_counts
from cellpath.schema import INTERVAL_MINUTES, ITERATIONS, KMEANS_K, KMODES_K, SEED, TOP_K, slots_per_day
from cellpath.session import checkpoint, shuffle_partitions


def cluster_days(
    points: DataFrame,
    method: str = "kmeans",
    k: int | None = None,
    iterations: int = ITERATIONS,
    by: Sequence[str] = PER_USER,
    seed: int = SEED,
    interval: int = INTERVAL_MINUTES,
    distance: Distance = squared,
) -> DataFrame:
    """Every day with the cluster its model is built from; ``points`` as ``lay_out`` stores them.

    K-means assigns once more with the final centres. K-modes keeps the assignment of
    its last round, made before the centres moved for the last time.
    """
    if method not in ("kmeans", "kmodes"):
        raise ValueError(f"unknown method {method!r}")
    k = k or (KMEANS_K if method == "kmeans" else KMODES_K)
    slots = slots_per_day(interval)
    rounds = iterations if method == "kmeans" else iterations - 1
    centres = initial_centres(points, k, by, seed)
    if tuple(by) != POOLED:
        # Dealt out by group once more, since the planner does not know how a grouped function leaves its rows: all that follows stays in place.
        return assign(points, centres, k, slots, by, distance, rounds, method).repartition(shuffle_partitions(points.sparkSession), *by)
    centres = iterate(points, checkpoint(centres), k, slots, rounds, by, method, distance)
    return assign(points, centres, k, slots, by, distance)


def model_of_points(
    points: DataFrame,
    method: str = "kmeans",
    k: int | None = None,
    iterations: int = ITERATIONS,
    by: Sequence[str] = PER_USER,
    seed: int = SEED,
    top_k: int = TOP_K,
    interval: int = INTERVAL_MINUTES,
    distance: Distance = squared,
) -> DataFrame:
    """Model table of all groups at once, from laid-out points."""
    assigned = cluster_days(points, method, k, iterations, by, seed, interval, distance)
    return model_from_counts(slot_counts(assigned, by), top_k, by, interval)


def build_model(vectors: DataFrame, by: Sequence[str] = PER_USER, **options) -> DataFrame:
    """Model table from day vectors; ``options`` as for :func:`model_of_points`."""
    return model_of_points(lay_out(vectors, by), by=by, **options)
