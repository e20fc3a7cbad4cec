"""Structural breaks by penalised change-point search (PELT, Gaussian kernel cost), one series at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def pair_distance(x: np.ndarray, rank: int) -> float:
    """The rank-th smallest (from 1) of the distances of all pairs, in memory of the series' length.

    Pairs within a distance are counted on the sorted values; the distance is found by halving the range of doubles, whose
    bits are in the order of their values.
    """
    x = np.sort(x)
    first = np.arange(len(x))
    within = lambda d: int((np.searchsorted(x, x + d, side="right") - first - 1).sum())
    low, high = 0, int(np.float64(x[-1] - x[0]).view(np.int64))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if within(np.int64(middle).view(np.float64)) >= rank else (middle + 1, high)
    return float(np.int64(low).view(np.float64))


def _scale(x: np.ndarray) -> float:
    """The median of the squared distances of all pairs."""
    pairs = len(x) * (len(x) - 1) // 2
    return (pair_distance(x, (pairs + 1) // 2) ** 2 + pair_distance(x, pairs // 2 + 1) ** 2) / 2


def change_points(x: np.ndarray, penalty: float = 3.0, least: int = 2) -> list[int]:
    """Ends of segments, the last excluded. Cost of a segment: its length less the mean of its kernel matrix's row sums.

    No kernel matrix is held: for every start that is still in the race the sum over its square is kept, and a new value
    adds one row to each, by sums from the end. Memory grows with the length; work with the length times the reach of the
    starts in the race, which is a few segments once there are breaks.
    """
    n = len(x)
    if n < 4:
        return []
    middle = _scale(x)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    best[0] = -penalty
    alive, held = np.zeros(1, dtype=np.int64), np.zeros(1)
    for end in range(1, n + 1):
        low = int(alive[0])
        d2 = (x[low:end] - x[end - 1]) ** 2
        row = np.exp(-np.clip(d2 / middle if middle > 0 else d2, 1e-2, 1e2))
        from_end = row[::-1].cumsum()[::-1]
        held += 2 * from_end[alive - low] - row[-1]
        if end < least:
            continue
        there = alive <= end - least
        length = end - alive[there]
        values = best[alive[there]] + (length - held[there] / length) + penalty
        at = int(values.argmin())
        best[end], back[end] = values[at], alive[there][at]
        stays = np.ones(len(alive), dtype=bool)
        stays[there] = values - penalty <= best[end]
        alive, held = np.append(alive[stays], end), np.append(held[stays], 0.0)
    out, end = [], n
    while back[end] > 0:
        end = int(back[end])
        out.append(end)
    return out[::-1]


def break_counts(panel: DataFrame, entity: str, order: list[str], value: str, penalty: float = 3.0) -> DataFrame:
    """entity, breaks: change points of its standardised series. A series is one group: an entity's own length."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(order)[value].to_numpy(dtype=float)
        x = x[~np.isnan(x)]
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        z = (x - x.mean()) / sd if sd > 0 else x * 0
        return pd.DataFrame({entity: [group[entity].iloc[0]], "breaks": [len(change_points(z, penalty))]})

    return panel.select(entity, *order, value).groupBy(entity).applyInPandas(count, f"`{entity}` {dict(panel.dtypes)[entity]}, breaks int")
