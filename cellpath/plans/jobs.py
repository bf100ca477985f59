"""The three jobs end to end: prepare, train, evaluate. Files in, files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.operators.backfill import backfill
from cellpath.operators.clustering import PER_USER
from cellpath.operators.evaluation import rank_hits
from cellpath.operators.prediction import predict
from cellpath.operators.sampling import past_and_future, sample_sequences
from cellpath.operators.slots import day_vectors
from cellpath.plans.train import build_model
from cellpath.schema import INTERVAL_MINUTES, LOST_SIGNAL_CELL, PREVIOUS_POINTS, SEED, slots_per_day
from cellpath.session import scratch_path
from cellpath.sources.model_store import read_model, write_model
from cellpath.sources.pings import parse_pings, read_ping_lines, sort_out
from cellpath.sources.text import (
    parse_sequences,
    parse_vectors,
    read_vectors,
    rejected_sequences,
    rejected_vectors,
    sequence_lines,
    vector_lines,
    write_lines,
)


def prepared_vectors(
    pings: DataFrame,
    interval: int = INTERVAL_MINUTES,
    lost_cell: int = LOST_SIGNAL_CELL,
    strict_run: bool = True,
) -> DataFrame:
    """Pings to gap-filled day vectors."""
    return backfill(day_vectors(pings, interval, lost_cell), strict_run)


def prepare(
    spark: SparkSession,
    pings_path: str,
    vectors_path: str,
    sequences_path: str,
    interval: int = INTERVAL_MINUTES,
    previous_points: int = PREVIOUS_POINTS,
    seed: int = SEED,
    rejects_path: str | None = None,
) -> None:
    """Ping lines to day vectors and test sequences, both as text; lines that are no pings go to ``rejects_path``."""
    lines = read_ping_lines(spark, pings_path)
    if rejects_path is None:
        pings = parse_pings(lines)
    else:
        # Both kinds of lines come from one scan of the text.
        pings, rejects = sort_out(lines, scratch_path(spark, "parsed"))
        write_lines(rejects.select("value"), rejects_path)
    vectors = prepared_vectors(pings, interval)
    write_lines(vector_lines(vectors), vectors_path)
    # The sequences start from the stored vectors: the pings are read once.
    sequences = sample_sequences(read_vectors(spark, vectors_path), previous_points, interval, seed)
    write_lines(sequence_lines(sequences), sequences_path)


def _lines_of(lines: DataFrame, user_id: str | None) -> DataFrame:
    """Lines of one user, chosen before any is split."""
    return lines if user_id is None else lines.where(F.col("value").startswith(f"{user_id}|"))


def train(
    spark: SparkSession, vectors_path: str, model_path: str, user_id: str | None = None, rejects_path: str | None = None, **options
) -> None:
    """Stored day vectors to a stored model, per user or pooled; ``options`` as for ``build_model``.

    Lines that are no vectors of the interval are left out; with ``rejects_path`` they are written there.
    """
    lines = _lines_of(spark.read.text(vectors_path), user_id)
    slots = slots_per_day(options.get("interval", INTERVAL_MINUTES))
    if rejects_path is not None:
        write_lines(rejected_vectors(lines, slots).select("value"), rejects_path)
    write_model(build_model(parse_vectors(lines, slots), **options), model_path)


def evaluate(
    spark: SparkSession,
    sequences_path: str,
    model_path: str,
    user_id: str | None = None,
    by: Sequence[str] = PER_USER,
    rejects_path: str | None = None,
) -> DataFrame:
    """Hits per rank of a stored model on stored test sequences; ``by`` as the model was trained.

    Lines that are no sequences are left out; with ``rejects_path`` they are written there.
    """
    lines = _lines_of(spark.read.text(sequences_path), user_id)
    if rejects_path is not None:
        write_lines(rejected_sequences(lines).select("value"), rejects_path)
    sequences = parse_sequences(lines)
    model = read_model(spark, model_path, user_id if tuple(by) == PER_USER else None)
    return rank_hits(predict(past_and_future(sequences), model, by=by, keep_unpredicted=True))
