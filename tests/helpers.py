"""Small fixtures and brute-force versions of the rules."""

from __future__ import annotations

from collections import Counter, defaultdict

PINGS = "user_id string, year int, month int, day int, minute_of_day int, cell_id int, ord long"
VECTORS = "user_id string, year int, month int, day int, cells array<int>"
MODEL = "user_id string, cluster_id int, slot int, rank int, cell_id int, freq long, prob double, interval_minutes int"
SEQUENCES = "user_id string, year int, month int, day int, points array<struct<minute: int, cell_id: int>>"


def pings(spark, rows):
    """Rows ``(user, day, minute, cell)`` of January 2024; position is the order."""
    return spark.createDataFrame([(u, 2024, 1, d, m, c, i) for i, (u, d, m, c) in enumerate(rows)], PINGS)


def vectors(spark, rows):
    """Rows ``(user, day, cells)`` of January 2024."""
    return spark.createDataFrame([(u, 2024, 1, d, c) for u, d, c in rows], VECTORS)


def by_key(df, *keys):
    """Last column by key."""
    value = next(c for c in reversed(df.columns) if c not in keys)
    rows = df.collect()
    found = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r[value] for r in rows}
    assert len(found) == len(rows)
    return found


def slow_day_vector(day_pings, interval=60, lost=1):
    """The slot rule for one day, over minutes: ``day_pings`` are ``(minute, cell)`` in order."""
    held, seen = {}, defaultdict(set)
    for minute in range(1440):
        before = [c for m, c in day_pings if m <= minute]
        held[minute] = before[-1] if before else -1
    for position, (minute, cell) in enumerate(day_pings):
        carried = day_pings[position - 1][1] if position else -1
        seen[minute // interval] |= {cell, carried}
    last = max(m for m, _ in day_pings) // interval
    result = []
    for slot in range(1440 // interval):
        minutes = range(slot * interval, (slot + 1) * interval)
        if slot >= last:
            result.append(day_pings[-1][1])
        elif slot not in seen:
            result.append(held[minutes[0]])
        else:
            dwell = Counter({c: 0 for c in seen[slot]})
            dwell.update(held[m] for m in minutes)
            candidates = [c for c in dwell if c != lost]
            result.append(min(candidates, key=lambda c: (-dwell[c], c == -1, c)) if candidates else -1)
    return result


def slow_backfill(days):
    """The fill rule for one user-month: ``{day: cells}``."""
    filled, carry, previous = {}, -1, -1
    for day in sorted(days):
        cells = list(days[day])
        if day == previous + 1:
            known = next((i for i, c in enumerate(cells) if c != -1), len(cells))
            cells[:known] = [carry] * known
            carry = cells[-1]
        else:
            carry = -1
        filled[day], previous = cells, day
    return filled


def slow_rounds(points, centres, rounds, method):
    """K-means or k-modes over ``[cells]`` with centres ``{id: cells}``."""

    def nearest(cells):
        return min(centres, key=lambda i: (sum((a - b) ** 2 for a, b in zip(cells, centres[i])), i))

    for _ in range(rounds):
        members = defaultdict(list)
        for cells in points:
            members[nearest(cells)].append(cells)
        if method == "kmeans":
            moved = {i: [int(sum(c) / len(c)) for c in zip(*m)] for i, m in members.items()}
            centres = {**centres, **moved}
        else:
            centres = {
                i: [min(Counter(c).items(), key=lambda kv: (-kv[1], kv[0]))[0] for c in zip(*m)]
                for i, m in members.items()
            }
    return centres, [nearest(cells) for cells in points]
