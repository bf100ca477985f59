"""Results kept between the steps of an operator."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from cellpath.session import scratch_path, shuffle_partitions


def stage(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends here.

    For results of whole passes over texts, which must not run twice if an executor is lost, and for
    what rounds build on. A ``small`` result (ids and links) goes to an eighth as many files.
    """
    path = scratch_path(df.sparkSession, name)
    if small:
        df = df.coalesce(max(1, shuffle_partitions(df.sparkSession) // 8))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks while it is used more than once.

    Its lineage stays: what a lost executor held is computed again. For small results of joins
    and aggregations over staged tables, which would otherwise leave a file per partition in the shared folder.
    """
    return df.persist(StorageLevel.DISK_ONLY)
