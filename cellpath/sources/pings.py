"""Ping sources: CSV text and the ``events`` table.

Both give ``user_id, year, month, day, minute_of_day, cell_id, ord``; ``ord`` is
unique and orders pings that fall into the same minute.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.operators.joins import join_shared
from cellpath.schema import MINUTES_PER_DAY, USER_DAY

PING_COLUMNS = USER_DAY + ["minute_of_day", "cell_id", "ord"]

# Position of each field in a CSV ping line (fixed values); day of week (4) and
# area (7) are not read.
CSV_FIELDS = {"year": 1, "month": 2, "day": 3, "hour": 5, "minute": 6, "cell_id": 8}


# Bytes of a file and lines of a scan task: positions are made of a file's rank, a block's start and a line's number.
_FILE_BITS = 40
_LINE_BITS = 33


# Names of files come with one or three slashes after the scheme.
_SLASHES = "^([a-z0-9]+):/+"


def read_ping_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines with their input position as ``ord``: by file name, then by place in the file.

    A position is made of the rank of the file, the start of the block that was read, and the line's number among those of
    the task. Blocks never change places, however the planner cuts files and packs blocks into tasks, so the order is always the same; the numbers differ.
    """
    lines = spark.read.text(path)
    numbered = lines.select(
        "value",
        F.regexp_replace("_metadata.file_path", _SLASHES, "$1:/").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().bitwiseAND((1 << _LINE_BITS) - 1).alias("line"),
    )
    # The driver holds the list of files already; names come with and without escapes.
    files = sorted(lines.inputFiles())
    ranks = {re.sub(_SLASHES, r"\1:/", name): i for i, file in enumerate(files) for name in (file, unquote(file))}
    ranked = spark.createDataFrame(list(ranks.items()), "file string, file_rank long")
    found = join_shared(numbered, ranked, ["file"], sum(map(len, ranks)) + 64 * len(ranks), ["file", "start"], "left")
    rank = "coalesce(file_rank, raise_error(concat('no rank for file ', file)))"
    ord_ = f"""cast(cast({rank} as decimal(20,0)) * cast({1 << _FILE_BITS} as decimal(13,0)) + start as decimal(38,0))
        * cast({1 << _LINE_BITS} as decimal(10,0)) + line"""
    return found.selectExpr("value", f"cast({ord_} as decimal(38,0)) AS ord")


def _strict_int(text: Column) -> Column:
    # A cast alone would accept padded text such as ' 5 '.
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def _typed_lines(lines: DataFrame) -> DataFrame:
    # The generator keeps the later filter from being pushed below the parsing,
    # which would then be done twice.
    typed = [_strict_int(F.get("fields", F.lit(pos))).alias(name) for name, pos in CSV_FIELDS.items()]
    parsed = F.struct(F.get("fields", F.lit(0)).alias("user_id"), *typed)
    return lines.select("value", "ord", F.split("value", ",").alias("fields")).select(
        "value", "ord", F.inline(F.array(parsed))
    )


def _reason() -> Column:
    """Why a line is rejected, null for a good line."""
    missing = F.lit(False)
    for name in CSV_FIELDS:
        missing = missing | F.col(name).isNull()
    # bigint: hour and minute may be any int here.
    minute = F.col("hour").cast("bigint") * 60 + F.col("minute")
    return (
        F.when(missing, F.lit("malformed"))
        .when((minute < 0) | (minute >= MINUTES_PER_DAY), F.lit("minute out of range"))
    )


def parse_pings(lines: DataFrame) -> DataFrame:
    """Typed pings of the well-formed lines."""
    return _pings_of(_typed_lines(lines).where(_reason().isNull()))


def _pings_of(typed: DataFrame) -> DataFrame:
    return typed.withColumn("minute_of_day", minute_of_day(F.col("hour"), F.col("minute"))).select(*PING_COLUMNS)


def sort_out(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Pings and rejected lines of one scan: both are written to ``path``, each kind to a folder, and read from there."""
    spark = lines.sparkSession
    judged = _typed_lines(lines).withColumn("reason", _reason()).withColumn("value", F.expr("if(reason IS NULL, null, value)"))
    judged.withColumn("rejected", F.col("reason").isNotNull()).write.partitionBy("rejected").parquet(path)
    stored = spark.read.schema(judged.withColumn("rejected", F.lit(True)).schema).parquet(path)
    return _pings_of(stored.where("NOT rejected")), stored.where("rejected").select("value", "ord", "reason")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The complement of :func:`parse_pings`, with the reason."""
    return _typed_lines(lines).withColumn("reason", _reason()).where("reason IS NOT NULL").select("value", "ord", "reason")


def minute_of_day(hour: Column, minute: Column) -> Column:
    return (hour * 60 + minute).cast("int")


def for_user(df: DataFrame, user_id) -> DataFrame:
    """Rows of one user; on Parquet the predicate reaches the scan."""
    return df.where(F.col("user_id") == F.lit(user_id))


def event_ping_columns() -> list[Column]:
    """The columns that make a ping of a row of ``events``.

    The cell is derived from ``props.k``: ten cells, of which cell 1 is a lost signal.
    """
    cell = F.get_json_object("props", "$.k").cast("int") % 10
    return [
        F.col("user_id"),
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"),
        minute_of_day(F.hour("ts"), F.minute("ts")).alias("minute_of_day"),
        cell.cast("int").alias("cell_id"),
        F.col("event_id").alias("ord"),
    ]


def pings_from_events(events: DataFrame) -> DataFrame:
    """Read the ``events`` table as pings."""
    return events.select(*event_ping_columns())


def read_event_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
