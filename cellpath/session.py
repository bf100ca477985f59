"""Session construction and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellpath")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from the session.

    Only a local session that names none (a test) gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cellpath-"))
    return configured or sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucketed_table(df: DataFrame, keys: Sequence[str], name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``keys`` to the shared folder and read it back.

    The stored layout is known to the planner: joins and aggregations on ``keys``
    need no shuffle, however often the table is read. It also cuts lineage.
    """
    spark = df.sparkSession
    buckets = shuffle_partitions(spark)
    table = f"cellpath_{name}_{uuid.uuid4().hex}"
    options = {"compression": compression} if compression else {}
    (
        df.repartition(buckets, *keys)
        .write.options(**options)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", f"{shared_dir(spark).rstrip('/')}/{table}")
        .saveAsTable(table)
    )
    return spark.table(table)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage reliably: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
