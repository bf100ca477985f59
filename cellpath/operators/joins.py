"""Joining a big table with one shared model or centre set that all rows need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.session import shuffle_partitions

# A shared table up to this size is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def join_shared(rows: DataFrame, shared: DataFrame, on: Sequence[str], size: int, spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``shared`` of at most ``size`` bytes.

    Keys repeat without limit in ``rows``, so they are not shuffled by key. A small
    table is broadcast; a bigger one is copied once per shuffle partition, and the
    rows are spread over the copies by the ``spread`` columns.
    """
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(shared), list(on), how)
    copies = shuffle_partitions(rows.sparkSession)
    numbered = shared.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    spread_rows = rows.withColumn("copy", F.pmod(F.xxhash64(*spread), F.lit(copies)).cast("int"))
    return spread_rows.join(numbered.hint("merge"), [*on, "copy"], how).drop("copy")
