"""Seeded pseudo-random draws that any SQL engine can repeat.

A draw is an md5 over the row's key and the seed, so a retried task, another
partitioning or another cluster size gives the same sample.
"""

from __future__ import annotations

from collections.abc import Sequence


def digest(columns: Sequence[str], seed: int) -> str:
    """SQL text: md5 over the ``|``-joined columns and seed."""
    return f"md5(concat_ws('|', {', '.join(columns)}, '{seed}'))"


def digest_int(hexdigest: str, start: int = 1, digits: int = 8) -> str:
    """SQL text: some hex digits (15 at most) of a digest, from position ``start``, as a non-negative bigint."""
    return f"cast(conv(substring({hexdigest}, {start}, {digits}), 16, 10) as bigint)"
