"""Rounds of clustering over numpy arrays of points: what a task does with its points, or with all days of a user.

Every point carries an upper bound for the distance to its centre and a lower one for that to any other. Centres that move shift the bounds by
how far they moved; only a point whose bounds cross computes distances again, first to its own centre, then to those near that one.
Bounds are compared with a margin far above rounding, so results are those of computing every distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cellpath.functions.distance import CHUNK, PRODUCT_CHUNK, Distance

_MARGIN = 1e-9


def nearest(cells: np.ndarray, centres: np.ndarray, distance: Distance) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the nearest centre (ties: the first), its distance, and the distance of the nearest other one (-1: there is none)."""
    distance.check(cells, centres)
    n, k = len(cells), len(centres)
    at, best, other = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    kind = distance.exact(cells, centres)
    rows = max(1, (PRODUCT_CHUNK if kind else CHUNK) // max(k, 1))
    if kind:
        right = centres.astype(kind)
        right_size = (right * right).sum(axis=1)
    for start in range(0, n, rows):
        part = slice(start, start + rows)
        if kind:
            left = cells[part].astype(kind)
            table = left @ (-2 * right.T)
            table += right_size
            table += (left * left).sum(axis=1)[:, None]
        else:
            table = distance.table(cells[part], centres)
        line = np.arange(len(table))
        at[part] = table.argmin(axis=1)
        best[part] = table[line, at[part]]
        if k > 1:
            table[line, at[part]] = np.inf if kind else np.iinfo(np.int64).max
            other[part] = table.min(axis=1)
    return at, best, other


@dataclass
class State:
    """Centre of every point by its place, with bounds (infinite where unknown or without another centre)."""

    at: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def assign_all(cells: np.ndarray, centres: np.ndarray, distance: Distance) -> State:
    at, best, other = nearest(cells, centres, distance)
    if distance.metric is None:
        return State(at, np.full(len(at), np.inf), np.full(len(at), -np.inf))
    return State(at, distance.metric(best), np.where(other < 0, np.inf, distance.metric(np.maximum(other, 0))))


def moves_of(old: np.ndarray, new: np.ndarray, distance: Distance) -> np.ndarray:
    """How far each centre moved, in the metric of the bounds."""
    return np.zeros(len(old)) if distance.metric is None else distance.metric(distance.pairs(old, new))


def _crossed(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return ~(upper * (1 + _MARGIN) + _MARGIN < lower * (1 - _MARGIN))


def assign_again(cells: np.ndarray, centres: np.ndarray, moves: np.ndarray, before: State, distance: Distance) -> State:
    """Nearest centres after all moved by ``moves``; ``before.at`` are places among them."""
    if distance.metric is None:
        return assign_all(cells, centres, distance)
    at, upper = before.at.copy(), before.upper + moves[before.at]
    lower = before.lower - moves.max(initial=0)
    open_ = np.flatnonzero(_crossed(upper, lower))
    upper[open_] = distance.metric(distance.pairs(cells[open_], centres[at[open_]]))
    open_ = open_[_crossed(upper[open_], lower[open_])]
    # Near centres only where distances are dear: a product of all is quicker than many small tables.
    if len(centres) < len(open_) and len(centres) ** 2 <= CHUNK and distance.exact(cells, centres) is None:
        between = distance.metric(distance.table(centres, centres))
        for place in np.unique(at[open_]):
            mine = open_[at[open_] == place]
            at[mine], upper[mine], lower[mine] = _among_neighbours(cells[mine], centres, between[place], upper[mine], distance)
    elif len(open_):
        found = assign_all(cells[open_], centres, distance)
        at[open_], upper[open_], lower[open_] = found.at, found.upper, found.lower
    return State(at, upper, lower)


def _among_neighbours(cells: np.ndarray, centres: np.ndarray, from_own: np.ndarray, own: np.ndarray, distance: Distance) -> tuple[np.ndarray, ...]:
    """Nearest centre and bounds of points of one cluster, at distance ``own`` of its centre.

    A centre twice as far from theirs as they are cannot be nearer, so it is left out.
    """
    near = from_own <= 2 * own.max() * (1 + _MARGIN) + _MARGIN
    places = np.flatnonzero(near)
    found = assign_all(cells, centres[places], distance)
    beyond = from_own[~near].min() - own if len(places) < len(centres) else np.inf
    return places[found.at], found.upper, np.minimum(found.lower, beyond)


def truncated_mean(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Integer mean, truncated towards zero."""
    return np.sign(sums) * (np.abs(sums) // sizes[:, None])


def _means(cells: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Clusters that have points, and their means."""
    sizes = np.bincount(at, minlength=k)
    sums = np.zeros((k, cells.shape[1]), np.int64)
    np.add.at(sums, at, cells)
    held = np.flatnonzero(sizes)
    return held, truncated_mean(sums[held], sizes[held])


def _modes(cells: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters that have points, and the most frequent cell of each slot (ties: the smallest)."""
    slots = cells.shape[1]
    group = (at[:, None] * slots + np.arange(slots)).ravel()
    keys, counts = np.unique(np.stack([group, cells.ravel()], 1), axis=0, return_counts=True)
    order = np.lexsort((keys[:, 1], -counts, keys[:, 0]))
    keys = keys[order]
    first = np.concatenate([[True], keys[1:, 0] != keys[:-1, 0]])
    return np.unique(at), keys[first, 1].reshape(-1, slots)


@dataclass
class Outcome:
    """Centres by cluster id after some rounds, and the rounds it took until nothing changed (or all)."""

    ids: np.ndarray
    centres: np.ndarray
    rounds: int


def _small_sums(cells: np.ndarray) -> bool:
    """Whether sums over all points are exact in floating point, and quotients by numbers of points truncate as integers do."""
    return len(cells) * max(abs(int(cells.max())), abs(int(cells.min()))) < 1 << 51


def _run_means(cells: np.ndarray, ids: np.ndarray, centres: np.ndarray, rounds: int) -> Outcome:
    """Rounds of k-means over a few points: products of small matrices, all exact, without bounds."""
    points, known, places = cells.astype(np.float64), centres.astype(np.float64), np.arange(len(ids))
    for done in range(1, rounds + 1):
        at = ((known * known).sum(axis=1) - 2 * (points @ known.T)).argmin(axis=1)
        held = (at[:, None] == places).astype(np.float64)
        sizes = held.sum(axis=0)[:, None]
        moved = np.where(sizes > 0, np.trunc((held.T @ points) / np.maximum(sizes, 1)), known)
        if np.array_equal(moved, known):
            return Outcome(ids, centres if done == 1 else known.astype(np.int64), done)
        known = moved
    return Outcome(ids, known.astype(np.int64), rounds)


def run(cells: np.ndarray, ids: np.ndarray, centres: np.ndarray, rounds: int, method: str, distance: Distance) -> Outcome:
    """Up to ``rounds`` rounds over all points of one group; stops when a round changes no centre.

    Centres are computed anew only for clusters that a point joined or left. An empty cluster keeps its centre in
    k-means and vanishes in k-modes. ``ids`` are sorted.
    """
    if not len(cells) or not len(ids):
        return Outcome(ids, centres, 0)
    if method == "kmeans" and len(cells) * len(ids) <= PRODUCT_CHUNK and distance.exact(cells, centres) and _small_sums(cells):
        return _run_means(cells, ids, centres, rounds)
    state = None
    for done in range(1, rounds + 1):
        if state is None:
            old, state = None, assign_all(cells, centres, distance)
            touched = np.ones(len(cells), np.bool_)
        else:
            old, state = state, assign_again(cells, centres, moves, state, distance)
            changed = np.flatnonzero(old.at != state.at)
            hit = np.zeros(len(ids), np.bool_)
            hit[old.at[changed]] = hit[state.at[changed]] = True
            touched = hit[state.at]
        moved = centres.copy()
        if touched.any():
            rule = _modes(cells[touched], state.at[touched]) if method == "kmodes" else _means(cells[touched], state.at[touched], len(ids))
            moved[rule[0]] = rule[1]
        moves = moves_of(centres, moved, distance)
        same = np.array_equal(moved, centres)
        centres = moved
        if method == "kmodes":
            held = np.bincount(state.at, minlength=len(ids)) > 0
            if not held.all():
                same = False
                place = np.cumsum(held) - 1
                ids, centres, moves = ids[held], centres[held], moves[held]
                state.at = place[state.at]
        if same:
            return Outcome(ids, centres, done)
    return Outcome(ids, centres, rounds)
