"""Sets of hashes as bitmaps of bounded size, broadcast to filter rows before anything moves.

A bitmap may let more through than its set holds, never less; exact joins follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB, however many hashes there are.
MOST_BITS = 1 << 26


def bitmap(hashes: DataFrame, per_hash: int = 64) -> np.ndarray:
    """Bits of the hashes in column ``h``, ``per_hash`` for each as long as ``MOST_BITS`` allow."""
    count = hashes.select(F.approx_count_distinct("h")).first()[0]
    bits = min(MOST_BITS, 1 << max(16, (per_hash * count).bit_length()))
    place = F.col("h").bitwiseAND(bits - 1)
    cells = (
        hashes.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bit"].to_numpy().view(np.uint64)
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(np.bool_)
