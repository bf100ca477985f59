"""Models as Parquet, split by a hash of the user so that one user reads one folder.

The number of folders is stored with the model. A pooled model has a single folder.

A place holds versions, which never change, and a log of them. A version counts once it is whole and its line is in the log, which appears
there as one file; readers take the last line. So a reader always meets one whole model, whatever a writer does meanwhile or leaves undone.
Old versions stay for those who still read them; ``versions`` lists them, and what it does not list may be deleted.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_BUCKETS = 256


def _bucket(user: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user.cast("string")), F.lit(buckets)).cast("int")


def _order(model: DataFrame) -> list[str]:
    return [c for c in ("user_bucket", "user_id", "pool", "cluster_id", "slot", "rank") if c in model.columns]


_LOG = "sequence long, version string, buckets int"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions of a place, the last first; none where nothing was stored."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{path.rstrip('/')}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r.version for r in log.orderBy(F.desc("sequence"), F.desc("version")).collect()]


def _current(spark: SparkSession, path: str) -> str:
    """Folder of the last version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no model in {path}")
    return f"{path.rstrip('/')}/versions/{found[0]}"


def _add_version(stored: DataFrame, path: str, buckets: int) -> None:
    """Write a version whole, then its line in the log."""
    spark, version = stored.sparkSession, uuid.uuid4().hex
    stored.write.partitionBy("user_bucket").parquet(f"{path.rstrip('/')}/versions/{version}")
    sequence = len(versions(spark, path)) + 1
    line = spark.createDataFrame([(sequence, version, buckets)], _LOG)
    line.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/log")


def write_model(model: DataFrame, path: str, buckets: int = STORE_BUCKETS) -> None:
    """Store a model, per user or pooled, as the last version of a place.

    Rebalancing gives files of even size: small folders get one, big ones several.
    """
    per_user = "user_id" in model.columns
    bucket = _bucket(F.col("user_id"), buckets) if per_user else F.lit(0)
    stored = model.withColumn("user_bucket", bucket).withColumn("store_buckets", F.lit(buckets if per_user else 1))
    _add_version(stored.hint("rebalance", "user_bucket").sortWithinPartitions(*_order(stored)), path, buckets if per_user else 1)


# Columns of a stored model without rows, which leaves no file to take them from.
_EMPTY = """user_id string, cluster_id int, slot int, rank int, cell_id int, freq bigint, prob double,
    interval_minutes int, store_buckets int, user_bucket int"""


def read_model(spark: SparkSession, path: str, user_id=None) -> DataFrame:
    """Load the last version of a stored model; with ``user_id`` only that user's folder is read."""
    folder = _current(spark, path)
    try:
        model = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        model = spark.read.schema(_EMPTY).parquet(folder)
    if user_id is not None:
        if "user_id" not in model.columns:
            raise ValueError(f"the model in {path} is pooled; it has no users")
        one = model.select("store_buckets").first()
        if one is not None:
            model = model.where(F.col("user_bucket") == _bucket(F.lit(user_id), one[0]))
        model = model.where(F.col("user_id") == F.lit(user_id))
    return model.drop("user_bucket", "store_buckets")


def publish_model(spark: SparkSession, source: str, target: str) -> None:
    """Make the last version of a place the last version of another.

    Nothing is shuffled, and the order within files stays.
    """
    stored = spark.read.parquet(_current(spark, source))
    one = stored.select("store_buckets").first()
    _add_version(stored.sortWithinPartitions(*_order(stored)), target, one[0] if one else 1)
