"""Distances between day vectors, for whole numpy arrays of points and centres.

A distance is a sum over slots of an integer term. Where a growing function of it obeys the triangle inequality (``metric``), rounds of
clustering carry bounds instead of computing it anew; any other distance works without. Squared distances are matrix products wherever
floating point holds every number of the sum exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Distances computed at a time: bounds the memory of a task, whatever the number of points and centres.
CHUNK = 1 << 22
# The same for matrix products, whose results stay in a core's cache.
PRODUCT_CHUNK = 1 << 18


@dataclass(frozen=True)
class Distance:
    """``term`` gives the share of a slot for integer arrays; ``largest`` bounds it for cells at most ``span`` apart.

    ``product`` says that the term is the squared difference.
    """

    name: str
    term: Callable[[np.ndarray, np.ndarray], np.ndarray]
    largest: Callable[[int], int]
    metric: Callable[[np.ndarray], np.ndarray] | None = None
    product: bool = False

    def check(self, cells: np.ndarray, centres: np.ndarray) -> None:
        """An error if distances could pass 63 bits."""
        if cells.size and centres.size:
            span = max(int(cells.max()), int(centres.max())) - min(int(cells.min()), int(centres.min()))
            if self.largest(span) * cells.shape[1] >= 1 << 63:
                raise OverflowError(f"{self.name} distance of cells {span} apart exceeds 63 bits")

    def pairs(self, cells: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Distance of each point to the centre in the same row."""
        return self.term(cells, centres).sum(axis=1, dtype=np.int64)

    def exact(self, cells: np.ndarray, centres: np.ndarray) -> type | None:
        """The narrowest floating point in which matrix products give exact distances; none if no one does."""
        if not self.product or not cells.size or not centres.size:
            return None
        most = max(abs(int(f(x))) for f in (np.max, np.min) for x in (cells, centres))
        bound = 4 * cells.shape[1] * most * most
        return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else None

    def table(self, cells: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Distance of every point (row) to every centre (column)."""
        total = np.zeros((len(cells), len(centres)), np.int64)
        for slot in range(cells.shape[1]):
            total += self.term(cells[:, slot, None], centres[None, :, slot])
        return total


def _squared_term(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return gap * gap


def _differs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y).astype(np.int64)


def _as_float(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64)


#: Sum over slots of the squared difference of cell ids.
squared = Distance("squared", _squared_term, lambda span: span * span, np.sqrt, product=True)

#: Number of slots in which the two days differ.
hamming = Distance("hamming", _differs, lambda span: 1, _as_float)
