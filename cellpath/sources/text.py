"""Text formats: ``user|year|month|day|payload``, one user and day per line.

Day vectors carry ``c0,c1,...``; sequences carry ``t,c!t,c!...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.schema import MINUTES_PER_DAY, USER_DAY


def _line(payload: Column) -> Column:
    return F.concat_ws("|", *USER_DAY, payload).alias("value")


def points_text(points: str = "points") -> Column:
    """``t,c!t,c!...`` from an array of points."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["minute"], p["cell_id"])), "!")


def cells_text(cells: str = "cells") -> Column:
    return F.array_join(F.col(cells).cast("array<string>"), ",")


def vector_lines(vectors: DataFrame) -> DataFrame:
    return vectors.select(_line(cells_text()))


def sequence_lines(sequences: DataFrame) -> DataFrame:
    return sequences.select(_line(points_text()))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def _strict_int(text: str) -> str:
    # A cast alone would accept padded text such as ' 5 '.
    return f"if({text} rlike '^[+-]?[0-9]+$', try_cast({text} as int), null)"


def _typed(lines: DataFrame, payload: str) -> DataFrame:
    """Head and payload of lines of five fields, each part null where it does not parse; ``n_fields`` counts them.

    The generator keeps later filters from being pushed below the parsing, which would then be done twice.
    """
    head = ["get(fields, 0) AS user_id"] + [f"{_strict_int(f'get(fields, {i})')} AS {n}" for i, n in enumerate(USER_DAY[1:], start=1)]
    typed = f"inline(array(struct(size(fields) AS n_fields, {', '.join(head)}, {payload})))"
    return lines.selectExpr("value", "split(value, '[|]') AS fields").selectExpr("value", typed)


_HEAD_FAILS = "n_fields <> 5 OR user_id = '' OR year IS NULL OR month IS NULL OR day IS NULL"


def _typed_vectors(lines: DataFrame, slots: int | None) -> DataFrame:
    cells = f"transform(split(get(fields, 4), ','), c -> {_strict_int('c')})"
    wrong = "false" if slots is None else f"size(cells) <> {slots}"
    reason = f"""CASE WHEN {_HEAD_FAILS} THEN 'malformed' WHEN exists(cells, c -> c IS NULL) THEN 'malformed cell'
        WHEN {wrong} THEN 'wrong number of slots' END"""
    return _typed(lines, f"{cells} AS cells").withColumn("reason", F.expr(reason))


def _typed_sequences(lines: DataFrame) -> DataFrame:
    point = f"""transform(split(get(fields, 4), '!'), p -> if(size(split(p, ',')) = 2, named_struct(
        'minute', {_strict_int("get(split(p, ','), 0)")}, 'cell_id', {_strict_int("get(split(p, ','), 1)")}),
        cast(null as struct<minute: int, cell_id: int>)))"""
    reason = f"""CASE WHEN {_HEAD_FAILS} THEN 'malformed'
        WHEN exists(points, p -> p IS NULL OR p.minute IS NULL OR p.cell_id IS NULL) THEN 'malformed point'
        WHEN exists(points, p -> p.minute < 0 OR p.minute >= {MINUTES_PER_DAY}) THEN 'minute out of range' END"""
    return _typed(lines, f"{point} AS points").withColumn("reason", F.expr(reason))


def parse_vectors(lines: DataFrame, slots: int | None = None) -> DataFrame:
    """Day vectors of the well-formed lines; with ``slots`` those of that length only."""
    return _typed_vectors(lines, slots).where("reason IS NULL").select(*USER_DAY, "cells")


def rejected_vectors(lines: DataFrame, slots: int | None = None) -> DataFrame:
    """The complement of :func:`parse_vectors`, with the reason."""
    return _typed_vectors(lines, slots).where("reason IS NOT NULL").select("value", "reason")


def parse_sequences(lines: DataFrame) -> DataFrame:
    """Sequences of the well-formed lines."""
    return _typed_sequences(lines).where("reason IS NULL").select(*USER_DAY, "points")


def rejected_sequences(lines: DataFrame) -> DataFrame:
    """The complement of :func:`parse_sequences`, with the reason."""
    return _typed_sequences(lines).where("reason IS NOT NULL").select("value", "reason")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequences with a ``sequence_id``, since a day may have several of them."""
    return parse_sequences(spark.read.text(path)).withColumn("sequence_id", F.monotonically_increasing_id())
