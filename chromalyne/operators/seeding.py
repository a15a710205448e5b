"""First prototypes: random colours, random points, farthest points, given ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.functions.distances import euclidean, squared_int
from chromalyne.operators.points import channel_names, channels, dimensions, is_array, literal

Prototypes = list[list[int]]


class Rand:
    """The additive-feedback generator of the GNU C library's rand(), for replaying its draws."""

    def __init__(self, seed: int = 0):
        state = [seed or 1]
        for _ in range(30):
            high, low = divmod(state[-1], 127773)
            value = 16807 * low - 2836 * high
            state.append(value + 2147483647 if value < 0 else value)
        state += state[:3]
        for i in range(34, 344):
            state.append((state[i - 31] + state[i - 3]) & 0xFFFFFFFF)
        self.state = [x & 0xFFFFFFFF for x in state[-31:]]

    def __call__(self) -> int:
        value = (self.state[0] + self.state[28]) & 0xFFFFFFFF
        self.state = [*self.state[1:], value]
        return value >> 1


def random_colours(k: int, d: int, draw: Callable[[], int]) -> Prototypes:
    """k * d draws modulo 256, prototype after prototype."""
    return [[draw() % 256 for _ in range(d)] for _ in range(k)]


def point_indices(k: int, total: int, draw: Callable[[], int]) -> list[int]:
    """k places drawn with replacement."""
    return [draw() % total for _ in range(k)]


def points_at(points: DataFrame, indices: Sequence[int]) -> Prototypes:
    """The colours at some places, in the given order, repeats included."""
    own = channels(points)
    wanted = points.where(F.col("idx").isin([int(i) for i in set(indices)]))
    found = {r["idx"]: list(r["c"]) for r in wanted.select("idx", own.alias("c") if is_array(points) else F.array(*own).alias("c")).collect()}
    missing = sorted(set(indices) - set(found))
    if missing:
        raise ValueError(f"no point at {missing[:5]}")
    return [found[i] for i in indices]


#: A histogram of at most so many cells (colours times channels) is searched on the driver: 8 MB, whatever the input's size.
LOCAL_CELLS = 1_000_000


def farthest_points(hist: DataFrame, k: int, first: Sequence[int], most_cells: int = LOCAL_CELLS) -> Prototypes:
    """first, then again and again the colour whose distance to the nearest one chosen is largest; of equally far ones
    the colour that comes first in the image.

    A histogram of at most most_cells cells (a bounded read) is searched on the driver, where the distance to the nearest
    one chosen is kept; a larger one with one grouped maximum per prototype, no window and no sort.
    """
    array = is_array(hist)
    d = dimensions(hist)
    if array and not d:
        raise ValueError("no points")
    own, chosen = channels(hist), [[int(x) for x in first]]
    table = hist.select("c" if array else F.array(*channel_names(hist)).alias("c"), "first_idx").limit(most_cells // d + 1).toArrow()
    if table.num_rows <= most_cells // d:
        if not table.num_rows:
            raise ValueError("no points")
        return farthest_points_array(np.array(table.column("c").to_pylist(), np.int64), table.column("first_idx").to_numpy(), k, first)
    # up to 64 channels squares order and tie like the single-precision roots
    exact = d <= 64
    cell = F.col("c") if array else F.array(*channel_names(hist))
    while len(chosen) < k:
        measures = [(squared_int if exact else euclidean)(own, literal(p, array)) for p in chosen]
        nearest = F.least(*measures) if len(measures) > 1 else measures[0]
        best = hist.agg(F.max(F.struct(nearest.alias("far"), (-F.col("first_idx")).alias("early"), cell.alias("c"))).alias("best")).first()["best"]
        chosen.append([int(x) for x in best["c"]])
    return chosen


def farthest_points_array(colours: np.ndarray, first_idx: np.ndarray, k: int, first: Sequence[int]) -> Prototypes:
    """The same on arrays."""
    chosen = [[int(x) for x in first]]
    order = np.argsort(first_idx, kind="stable")
    colours = colours[order].astype(np.int64)
    nearest = np.full(len(colours), np.inf)
    while len(chosen) < k:
        d = ((colours - np.array(chosen[-1])) ** 2).sum(1)
        d = d if colours.shape[1] <= 64 else np.sqrt(d).astype(np.float32)
        nearest = np.minimum(nearest, d)
        chosen.append(colours[int(nearest.argmax())].tolist())
    return chosen
