"""Column groups and fixed values shared by every operator."""

from __future__ import annotations

# Keys.
USER_MONTH = ["user_id", "year", "month"]
USER_DAY = USER_MONTH + ["day"]

# These must stay as they are for results to be comparable.
UNKNOWN_CELL = -1
LOST_SIGNAL_CELL = 1
MINUTES_PER_DAY = 1440
INTERVAL_MINUTES = 60
TOP_K = 3
PREVIOUS_POINTS = 3
KMEANS_K = 5
KMODES_K = 400
ITERATIONS = 30
SEED = 42


def slots_per_day(interval: int = INTERVAL_MINUTES) -> int:
    """Number of slots in a day; the interval has to divide the day evenly."""
    if interval <= 0 or MINUTES_PER_DAY % interval:
        raise ValueError(f"interval must divide {MINUTES_PER_DAY} minutes, got {interval}")
    return MINUTES_PER_DAY // interval
