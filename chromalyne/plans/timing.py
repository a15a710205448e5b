"""Timing runs: warm-up rounds, then measured ones, a column per variant."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.operators import seeding
from chromalyne.operators.lloyd import VIDEO_VARIANTS, KMeansModel, KMeansParams, kmeans
from chromalyne.operators.points import histogram
from chromalyne.streaming.video import Tracker

#: The metrics of an image run, in the order of its columns.
IMAGE_METRICS = ("squared_euclidean", "manhattan", "chebyshev", "minkowski", "cosine")
IMAGE_WARM_UP, IMAGE_RUNS = 3, 30


def timed(call: Callable[[], object]) -> tuple[float, object]:
    start = time.perf_counter()
    result = call()
    return time.perf_counter() - start, result


def image_runs(points: DataFrame, params: KMeansParams, warm_up: int = IMAGE_WARM_UP, runs: int = IMAGE_RUNS) -> tuple[list[list[float]], list[KMeansModel]]:
    """Seconds (runs x metrics) of k-means under each metric, and each metric's last model. Draws go on from run to run."""
    draw, columns, models = seeding.Rand(0), [], []
    points = points.persist()
    for name in IMAGE_METRICS:
        own = KMeansParams(params.k, params.stab_error, params.max_iterations, name, params.minkowski_p)
        results = [timed(lambda own=own: kmeans(points, own, "k-means (any distance)", draw)) for _ in range(warm_up + runs)]
        columns.append([s for s, _ in results[warm_up:]])
        models.append(results[-1][1])
    points.unpersist()
    return [list(r) for r in zip(*columns)], models


def video_runs(points: DataFrame, params: KMeansParams, frames: Sequence[int], warm_up: int, runs: int, variants: Sequence[str] = VIDEO_VARIANTS) -> list[list[float]]:
    """Seconds (frames x variants) of every variant on each frame by itself, after warm_up frames; as many rows as there are frames."""
    draw, columns = seeding.Rand(0), []
    points = points.persist()
    for variant in variants:
        times = [timed(lambda f=f, v=variant: kmeans(points.where(F.col("frame_id") == f).drop("frame_id"), params, v, draw))[0] for f in frames[: warm_up + runs]]
        columns.append(times[warm_up:])
    points.unpersist()
    return [list(r) for r in zip(*columns)]


def calibration_runs(points: DataFrame, params: KMeansParams, frames: Sequence[int], calibration: int, warm_up: int, runs: int) -> list[list[float]]:
    """Seconds of each warm-started frame after calibration and warm_up."""
    tracker, times = Tracker(params, calibration), []
    points = points.persist()
    for i, f in enumerate(frames[: calibration + warm_up + runs]):
        seconds, _ = timed(lambda f=f: tracker.step(histogram(points.where(F.col("frame_id") == f).drop("frame_id"))))
        if i >= calibration + warm_up:
            times.append([seconds])
    points.unpersist()
    return times


def column_means(rows: list[list[float]]) -> list[float]:
    """The mean of each column over the rows there really are."""
    return [sum(c) / len(c) for c in zip(*rows)]
