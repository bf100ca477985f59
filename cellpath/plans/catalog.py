"""Registered queries: name -> ``(spark, sf_dir) -> DataFrame`` over the ``events`` table.

Nested results are written out as rows or text, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.functions.distance import hamming
from cellpath.operators import clustering as C
from cellpath.operators import daily, sampling, slots
from cellpath.operators.backfill import backfill, unknown_share
from cellpath.operators.evaluation import mark_hits, rank_hits, top_k_hit_rate
from cellpath.operators.model import model_count, top_cells
from cellpath.operators.prediction import best_model, model_scores, predict
from cellpath.plans import jobs
from cellpath.plans.jobs import prepared_vectors
from cellpath.plans.train import cluster_days, model_of_points
from cellpath.schema import ITERATIONS, KMEANS_K, KMODES_K, USER_DAY, slots_per_day
from cellpath.session import scratch_path, shuffle_partitions
from cellpath.sources import pings as P
from cellpath.sources import text
from cellpath.sources.model_store import publish_model, read_model, write_model

# Parameters of the registered queries: those of the API.
K = KMEANS_K
MODES_K = KMODES_K
ROUNDS = ITERATIONS
SLOTS = slots_per_day()
USER = 21
SEQUENCE = [*USER_DAY, "next_minute", "actual_cell"]

Query = Callable[[SparkSession, str], DataFrame]


def _ping_line() -> Column:
    """A ping as a CSV line."""
    return F.concat_ws(
        ",",
        "user_id",
        "year",
        "month",
        "day",
        F.dayofweek(F.make_date("year", "month", "day")),
        F.expr("minute_of_day div 60"),
        F.col("minute_of_day") % 60,
        F.lit("area"),
        "cell_id",
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as CSV ping lines, those of type ``error`` and ``signup`` damaged."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pings = events.select(*P.event_ping_columns(), "event_type", F.col("value").alias("amount"))
    lines = pings.withColumn("line", _ping_line())
    fields = F.split("line", ",")

    def with_field(position: int, value: Column) -> Column:
        parts = [value if i == position else F.get(fields, F.lit(i)) for i in range(9)]
        return F.concat_ws(",", *parts)

    month = F.get(fields, F.lit(2))
    error = (
        F.when(F.col("amount") < 10, F.array_join(F.slice(fields, 1, 8), ","))
        .when(F.col("amount") < 20, with_field(2, F.concat(F.lit(" "), month, F.lit(" "))))
        .when(F.col("amount") < 30, with_field(2, F.concat(month, F.lit(".7"))))
        .when(F.col("amount") < 40, with_field(8, F.lit("99999999999")))
        .otherwise(F.lit(""))
    )
    damaged = (
        F.when(F.col("event_type") == "error", error)
        .when(F.col("event_type") == "signup", with_field(5, F.lit("24")))
        .otherwise(F.col("line"))
    )
    return lines.select(damaged.alias("value"), "ord")


def _pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_event_pings(spark, sf_dir)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_vectors(_pings(spark, sf_dir))


def _wide(vectors: DataFrame) -> DataFrame:
    hours = [F.expr(f"cells[{s}]").alias(f"h{s:02d}") for s in range(SLOTS)]
    return vectors.select(*USER_DAY, *hours)


def _centre_rows(centres: DataFrame, by=C.PER_USER) -> DataFrame:
    rows = C.explode_centres(centres, by).select(*by, "cluster_id", F.posexplode("cells").alias("slot", "cell_id"))
    return rows.drop("pool")


def _points(spark: SparkSession, sf_dir: str, by=C.PER_USER) -> DataFrame:
    return C.lay_out(_vectors(spark, sf_dir), by)


def _start(spark: SparkSession, sf_dir: str, by=C.PER_USER, k: int = K) -> tuple[DataFrame, DataFrame]:
    points = _points(spark, sf_dir, by)
    return points, C.checkpoint(C.initial_centres(points, k, by))


def _centres(spark: SparkSession, sf_dir: str, method: str, rounds: int = ROUNDS, by=C.PER_USER, k: int = K) -> DataFrame:
    points, centres = _start(spark, sf_dir, by, k)
    return _centre_rows(C.iterate(points, centres, k, SLOTS, rounds, by, method), by)


def _mode_centres(spark: SparkSession, sf_dir: str, distance=C.squared) -> DataFrame:
    points, centres = _start(spark, sf_dir, k=MODES_K)
    return _centre_rows(C.iterate(points, centres, MODES_K, SLOTS, ROUNDS, method="kmodes", distance=distance))


def _one_step(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    points, centres = _start(spark, sf_dir)
    return _centre_rows(C.step(points, centres, K, SLOTS, method=method))


def _nearest(spark: SparkSession, sf_dir: str, distance=C.squared) -> DataFrame:
    points, centres = _start(spark, sf_dir)
    return C.assign(points, centres, K, SLOTS, distance=distance).select(*USER_DAY, "cluster_id", "distance")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.slot_counts(cluster_days(_points(spark, sf_dir), "kmeans", K, ROUNDS))


def _model(spark: SparkSession, sf_dir: str, method: str = "kmeans", distance=C.squared) -> DataFrame:
    return model_of_points(_points(spark, sf_dir), method, distance=distance)


def _half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lay_out(prepared_vectors(_pings(spark, sf_dir), 30))


def _half_hour_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval comes from the model."""
    days = _half_hours(spark, sf_dir)
    model = C.checkpoint(model_of_points(days, interval=30))
    sequences = sampling.past_and_future(sampling.sample_sequences(days, interval=30))
    return rank_hits(predict(sequences, model, keep_unpredicted=True))


def _repeated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence three times: each counts."""
    sequences, model = _sequences_and_model(spark, sf_dir)
    return rank_hits(predict(sequences.union(sequences).union(sequences), model, keep_unpredicted=True))


def _pooled_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_of_points(_points(spark, sf_dir, C.POOLED), "kmodes", by=C.POOLED)


def _sequences(days: DataFrame) -> DataFrame:
    return sampling.past_and_future(sampling.sample_sequences(days))


def _sequences_and_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both from the same stored days; the model is stored too, prediction reads it more than once."""
    points = _points(spark, sf_dir)
    return _sequences(points), C.checkpoint(model_of_points(points, "kmeans", K, ROUNDS))


def _predictions(spark: SparkSession, sf_dir: str, keep_unpredicted: bool = False) -> DataFrame:
    return predict(*_sequences_and_model(spark, sf_dir), keep_unpredicted=keep_unpredicted)


def _held_out_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the training days only, evaluate on the others."""
    days = C.lay_out(sampling.train_test_split(_vectors(spark, sf_dir)))
    model = C.checkpoint(model_of_points(days.where("is_train"), "kmeans", K, ROUNDS))
    return rank_hits(predict(_sequences(days.where("NOT is_train")), model, keep_unpredicted=True))


def _pooled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir, C.POOLED)
    model = C.checkpoint(model_of_points(points, "kmodes", by=C.POOLED))
    return rank_hits(predict(_sequences(points), model, by=C.POOLED, keep_unpredicted=True))


def _stored_jobs(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """The prepare job on ping text: days, sequences, rejects."""
    pings, *stored = (scratch_path(spark, name) for name in ("pings", "days", "sequences", "rejects"))
    text.write_lines(raw_lines(spark, sf_dir).select("value"), pings)
    jobs.prepare(spark, pings, stored[0], stored[1], rejects_path=stored[2])
    return tuple(stored)


def _pings_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pings")
    text.write_lines(raw_lines(spark, sf_dir).select("value"), path)
    return P.parse_pings(P.read_ping_lines(spark, path)).drop("ord")


def _prepare_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the prepare job writes, by kind."""
    paths = zip(("day", "sequence", "reject"), _stored_jobs(spark, sf_dir))
    kinds = [spark.read.text(path).select(F.lit(kind).alias("kind"), "value") for kind, path in paths]
    return kinds[0].union(kinds[1]).union(kinds[2])


def _damaged(lines: DataFrame) -> DataFrame:
    """Lines of days 1 to 6 of a month, damaged in six ways."""
    day = F.split("value", "[|]")[3]
    broken = (
        F.when(day == "1", F.regexp_replace("value", "[|][^|]*$", ""))
        .when(day == "2", F.regexp_replace("value", "^[^|]*", ""))
        .when(day == "3", F.regexp_replace("value", "^([^|]*[|])", "$1 "))
        .when(day == "4", F.concat("value", F.lit("x")))
        .when(day == "5", F.concat("value", F.lit("|")))
        .when(day == "6", F.concat("value", F.lit(",7")))
        .otherwise(F.col("value"))
    )
    return lines.select(broken.alias("value"))


def _parts(spark: SparkSession, sf_dir: str, lines: DataFrame, good, bad) -> DataFrame:
    """Damaged lines stored as text and read back: those that parse, as text again, and the rejects."""
    path = scratch_path(spark, "damaged")
    text.write_lines(_damaged(lines), path)
    stored = spark.read.text(path)
    return good(stored).select("value", F.lit(None).cast("string").alias("reason")).union(bad(stored))


def _vector_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.vector_lines(_vectors(spark, sf_dir))
    return _parts(spark, sf_dir, lines, lambda x: text.vector_lines(text.parse_vectors(x, SLOTS)), lambda x: text.rejected_vectors(x, SLOTS))


def _sequence_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.sequence_lines(sampling.sample_sequences(_vectors(spark, sf_dir)))
    return _parts(spark, sf_dir, lines, lambda x: text.sequence_lines(text.parse_sequences(x)), text.rejected_sequences)


def _one_user_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train one user from day text."""
    days, model = scratch_path(spark, "days"), scratch_path(spark, "model")
    text.write_lines(text.vector_lines(_vectors(spark, sf_dir)), days)
    jobs.train(spark, days, model, user_id=str(USER))
    return read_model(spark, model, str(USER))


def _hits_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three jobs with a pooled model that is stored in between."""
    days, sequences, model = (scratch_path(spark, n) for n in ("days", "sequences", "model"))
    vectors = _points(spark, sf_dir)
    text.write_lines(text.vector_lines(vectors), days)
    text.write_lines(text.sequence_lines(sampling.sample_sequences(vectors)), sequences)
    jobs.train(spark, days, model, by=C.POOLED, method="kmodes")
    return jobs.evaluate(spark, sequences, model, by=C.POOLED)


def _pooled_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, published = scratch_path(spark, "model"), scratch_path(spark, "published")
    write_model(_pooled_model(spark, sf_dir), stored)
    publish_model(spark, stored, published)
    return read_model(spark, published).drop("pool")


def _vectors_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    text.write_lines(text.vector_lines(_vectors(spark, sf_dir)), path)
    return slots.explode_slots(text.read_vectors(spark, path))


def _sequences_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sequences")
    text.write_lines(text.sequence_lines(sampling.sample_sequences(_vectors(spark, sf_dir))), path)
    return text.read_sequences(spark, path).select(*USER_DAY, F.inline("points"))


def _model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, published = scratch_path(spark, "model"), scratch_path(spark, "published")
    buckets = shuffle_partitions(spark)
    write_model(_model(spark, sf_dir), stored, buckets)
    publish_model(spark, stored, published)
    return read_model(spark, published)


def queries() -> dict[str, Query]:
    return {
        # pings
        "pings_parse": lambda s, d: P.parse_pings(raw_lines(s, d)),
        "pings_rejects": lambda s, d: P.rejected_lines(raw_lines(s, d)),
        "minute_of_day": lambda s, d: _pings(s, d).select("ord", "minute_of_day"),
        "user_filter": lambda s, d: P.for_user(_pings(s, d), USER),
        "daily_sequences": lambda s, d: daily.daily_sequences(_pings(s, d)).select(
            *USER_DAY, "part_no", text.points_text().alias("points")
        ),
        "records_per_user_month": lambda s, d: daily.records_per_user_month(_pings(s, d)),
        # slots
        "dwell_segments": lambda s, d: slots.dwell_segments(_pings(s, d)),
        "slot_dwell": lambda s, d: slots.slot_dwell(_pings(s, d)),
        "dominant_cell_no_lost_signal": lambda s, d: slots.dominant_cells(slots.slot_dwell(_pings(s, d))),
        "day_slots": lambda s, d: slots.day_slots(_pings(s, d)),
        "day_slots_30min": lambda s, d: slots.day_slots(_pings(s, d), interval=30),
        "day_vectors": lambda s, d: _wide(slots.day_vectors(_pings(s, d))),
        # backfill
        "day_slots_backfilled": lambda s, d: slots.explode_slots(_vectors(s, d)),
        "day_slots_backfilled_lenient": lambda s, d: slots.explode_slots(
            backfill(slots.day_vectors(_pings(s, d)), strict_run=False)
        ),
        "unknown_slot_share": lambda s, d: unknown_share(slots.explode_slots(_vectors(s, d))),
        # test set
        "test_points": lambda s, d: sampling.sample_sequences(_vectors(s, d)).select(*USER_DAY, F.inline("points")),
        "test_sequences_text": lambda s, d: text.sequence_lines(sampling.sample_sequences(_vectors(s, d))),
        "past_future_split": lambda s, d: _sequences(_vectors(s, d)).select(
            *SEQUENCE, text.points_text("past").alias("past")
        ),
        "train_test_split": lambda s, d: sampling.train_test_split(_vectors(s, d)).select(*USER_DAY, "is_train"),
        # clustering
        "initial_centres": lambda s, d: _centre_rows(_start(s, d)[1]),
        "nearest_centre": _nearest,
        "nearest_centre_hamming": lambda s, d: _nearest(s, d, hamming),
        "kmeans_step": lambda s, d: _one_step(s, d, "kmeans"),
        "kmeans_centres": lambda s, d: _centres(s, d, "kmeans"),
        "kmodes_step": lambda s, d: _one_step(s, d, "kmodes"),
        "kmodes_centres": _mode_centres,
        "kmodes_centres_hamming": lambda s, d: _mode_centres(s, d, hamming),
        "kmodes_centres_pooled": lambda s, d: _centres(s, d, "kmodes", by=C.POOLED, k=MODES_K),
        "kmeans_centres_pooled": lambda s, d: _centres(s, d, "kmeans", by=C.POOLED),
        # model
        "cluster_slot_counts": _counts,
        "cluster_topk": lambda s, d: top_cells(_counts(s, d)),
        "model_kmeans": _model,
        "model_kmodes": lambda s, d: _model(s, d, "kmodes"),
        "model_kmodes_hamming": lambda s, d: _model(s, d, "kmodes", hamming),
        "model_kmeans_30min": lambda s, d: model_of_points(_half_hours(s, d), interval=30),
        "model_kmodes_pooled": lambda s, d: _pooled_model(s, d).drop("pool"),
        "model_count": lambda s, d: model_count(_model(s, d)),
        # prediction
        "model_scores": lambda s, d: model_scores(*_sequences_and_model(s, d)),
        "best_model": lambda s, d: best_model(*_sequences_and_model(s, d)),
        "predict_next": _predictions,
        "predicted_vs_actual": lambda s, d: mark_hits(_predictions(s, d)).select(*SEQUENCE, "rank", "cell_id", "hit"),
        "rank_hits": lambda s, d: rank_hits(_predictions(s, d, True)),
        "rank_hits_30min": _half_hour_hits,
        "rank_hits_repeated": _repeated_hits,
        "rank_hits_from_store": _hits_from_store,
        "rank_hits_held_out": _held_out_hits,
        "rank_hits_pooled": _pooled_hits,
        "hit_rate_topk": lambda s, d: top_k_hit_rate(rank_hits(_predictions(s, d, True))),
        # round trips
        "day_vectors_text": lambda s, d: text.vector_lines(_vectors(s, d)),
        "day_vectors_roundtrip": _vectors_round_trip,
        "test_sequences_roundtrip": _sequences_round_trip,
        "model_store_roundtrip": _model_round_trip,
        "model_store_roundtrip_pooled": _pooled_round_trip,
        # jobs on text
        "pings_from_text": _pings_from_text,
        "prepare_job": _prepare_job,
        "train_job_one_user": _one_user_job,
        "day_vectors_rejects": _vector_rejects,
        "test_sequences_rejects": _sequence_rejects,
    }
