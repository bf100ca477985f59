"""Order-preserving integer keys, as SQL text, so that an argmax stays a plain hash aggregate.

``max`` over a struct makes Spark sort its input; ``max`` over a number does not.
A dwell time is below 2^12 and a cell id fits 32 bits, so both go into one bigint.
Counts have no such bound and share a decimal with the id.
"""

from __future__ import annotations

from cellpath.schema import UNKNOWN_CELL

_INT_MAX = 2147483647
_CELL_RANGE = 1 << 32


def dwell_key(dwell: str, cell: str) -> str:
    """Larger is better: longer dwell, then a known cell, then the smaller cell id."""
    known = f"if({cell} = {UNKNOWN_CELL}, 0L, {_CELL_RANGE}L)"
    return f"shiftleft(cast({dwell} as bigint), 33) + {known} + ({_INT_MAX}L - {cell})"


def cell_of_dwell(key: str) -> str:
    """The cell id packed into :func:`dwell_key`."""
    return f"cast({_INT_MAX}L - ({key} & {_CELL_RANGE - 1}L) as int)"


def dwell_of(key: str) -> str:
    """The dwell time packed into :func:`dwell_key`."""
    return f"cast(shiftright({key}, 33) as int)"


def count_key(freq: str, cell: str) -> str:
    """Larger is better: more frequent, then the smaller cell id."""
    return f"cast(cast({freq} as decimal(20,0)) * {_CELL_RANGE}L + ({_INT_MAX}L - {cell}) as decimal(31,0))"


def cell_of_count(key: str) -> str:
    """The cell id packed into :func:`count_key`."""
    return f"cast({_INT_MAX}L - cast({key} % {_CELL_RANGE}L as bigint) as int)"
