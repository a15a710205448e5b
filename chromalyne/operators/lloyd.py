"""Lloyd iterations with whole-number centroids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from chromalyne.functions.distances import ARRAYS, MINKOWSKI_P, order_key, single_mean, single_mean_array
from chromalyne.operators import seeding
from chromalyne.operators.points import channel_names, channels, dimensions, histogram, is_array, literal
from chromalyne.operators.seeding import Prototypes

#: A histogram of at most so many cells (colours times channels) is iterated on the driver: 8 MB, whatever the input's size.
LOCAL_CELLS = 1_000_000
#: Up to so many literals the assignment is written out; beyond, prototypes are one array literal.
WRITTEN_OUT = 256


@dataclass(frozen=True)
class KMeansParams:
    """k clusters; converged once no prototype moved by more than stab_error (squared Euclidean); iterations at most;
    metric of the assignment; how often convergence is tested (every check_every iterations)."""

    k: int
    stab_error: float = 1.0
    max_iterations: int = 100
    metric: str = "euclidean"
    minkowski_p: float = MINKOWSKI_P
    check_every: int = 1

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("the number of clusters must be positive")
        if self.stab_error < 0:
            raise ValueError("the stability error must not be negative")
        if self.max_iterations < 1:
            raise ValueError("the number of iterations must be positive")
        if self.check_every < 1:
            raise ValueError("convergence must be tested every 1 or more iterations")


@dataclass(frozen=True)
class KMeansModel:
    """prototypes after the last update; label_prototypes before it, which gave the last labels."""

    prototypes: Prototypes
    label_prototypes: Prototypes
    iterations: int
    converged: bool
    params: KMeansParams = field(repr=False)


def nearest(own: Sequence[Column] | Column, prototypes: Prototypes, metric: str, p: float) -> Column:
    """The index of the nearest prototype; of equally near ones the lowest."""
    array = isinstance(own, Column)
    d = len(prototypes[0])
    if len(prototypes) == 1:
        return F.lit(0)
    if array or len(prototypes) * d > WRITTEN_OUT:
        cell = own if array else F.array(*own)
        table = F.array(*[F.array(*[F.lit(int(v)) for v in row]) for row in prototypes])
        return F.array_min(F.transform(table, lambda q, i: F.struct(order_key(metric, cell, q, p, d).alias("d"), i.alias("cid"))))["cid"]
    options = [F.struct(order_key(metric, own, literal(q, False), p, d).alias("d"), F.lit(i).alias("cid")) for i, q in enumerate(prototypes)]
    return F.least(*options)["cid"]


def assign(points: DataFrame, prototypes: Prototypes, metric: str = "euclidean", p: float = MINKOWSKI_P) -> DataFrame:
    """points with cid: a projection, no join and no shuffle."""
    return points.withColumn("cid", nearest(channels(points), prototypes, metric, p))


def cluster_sums(assigned: DataFrame) -> DataFrame:
    """(cid, n, s0..): counts and channel sums of a histogram (or of points, which count once); combined before the shuffle of k rows."""
    weight = F.col("n") if "n" in assigned.columns else F.lit(1).cast("bigint")
    if is_array(assigned):
        # sums of each place of the array: as a row per place, at most k * d rows leave a task
        spread = assigned.select("cid", weight.alias("w"), F.posexplode("c").alias("i", "v"))
        per = spread.groupBy("cid", "i").agg(F.sum("w").alias("n"), F.sum(F.col("v") * F.col("w")).alias("s"))
        packed = per.groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
        return packed
    return assigned.groupBy("cid").agg(F.sum(weight).alias("n"), *[F.sum(F.col(c) * weight).alias(f"s{i}") for i, c in enumerate(channel_names(assigned))])


def conditional_sums(assigned: DataFrame, k: int) -> DataFrame:
    """The same numbers as one row of conditional aggregates (n_0, s_0_0, ...): no key, no shuffle of keys."""
    weight = F.col("n") if "n" in assigned.columns else F.lit(1).cast("bigint")
    out = []
    for cid in range(k):
        mine = F.col("cid") == cid
        out.append(F.coalesce(F.sum(F.when(mine, weight)), F.lit(0)).alias(f"n_{cid}"))
        out += [F.coalesce(F.sum(F.when(mine, F.col(c) * weight)), F.lit(0)).alias(f"s_{cid}_{i}") for i, c in enumerate(channel_names(assigned))]
    return assigned.agg(*out)


def updated(hist: DataFrame, prototypes: Prototypes, metric: str = "euclidean", p: float = MINKOWSKI_P) -> DataFrame:
    """One update as a table (cid, n, c0..): single-precision truncated means, empty clusters keep their prototype."""
    sums = cluster_sums(assign(hist, prototypes, metric, p))
    names = channel_names(hist)
    spark = hist.sparkSession
    old = spark.createDataFrame([(i, *map(int, q)) for i, q in enumerate(prototypes)], "cid int, " + ", ".join(f"old{i} int" for i in range(len(names))))
    joined = F.broadcast(old).join(sums, "cid", "left")  # k rows
    means = [F.coalesce(single_mean(F.col(f"s{i}"), F.col("n")), F.col(f"old{i}")).alias(c) for i, c in enumerate(names)]
    return joined.select("cid", F.coalesce("n", F.lit(0)).alias("n"), *means)


def _moved(new: Prototypes, old: Prototypes) -> int:
    return max(sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(new, old))


def iterate(step: Callable[[Prototypes], tuple[np.ndarray, np.ndarray]], init: Prototypes, params: KMeansParams) -> KMeansModel:
    """The loop. step gives counts (k) and channel sums (k x d) of the labels under some prototypes."""
    if len(init) != params.k:
        raise ValueError(f"{params.k} prototypes are needed, {len(init)} are given")
    now = [[int(x) for x in q] for q in init]
    for i in range(1, params.max_iterations + 1):
        old = now
        counts, sums = step(old)
        full = counts > 0
        means = np.array(old, np.int64)
        means[full] = single_mean_array(sums[full], counts[full])
        now = means.tolist()
        if i % params.check_every == 0 and _moved(now, old) <= params.stab_error:
            return KMeansModel(now, old, i, True, params)
    return KMeansModel(now, old, params.max_iterations, False, params)


def labels_array(colours: np.ndarray, prototypes: Prototypes, metric: str, p: float) -> np.ndarray:
    out, measure = np.empty(len(colours), np.int64), ARRAYS[metric]
    q = np.array(prototypes, np.int64)
    for a in range(0, len(colours), 1 << 16):
        part = colours[a : a + (1 << 16)]
        out[a : a + len(part)] = np.column_stack([measure(part, row, p) for row in q]).argmin(1)  # first of equals
    return out


def fit_arrays(colours: np.ndarray, weights: np.ndarray, init: Prototypes, params: KMeansParams) -> KMeansModel:
    """The loop over a weighted histogram in memory."""
    colours, weights = np.asarray(colours, np.int64), np.asarray(weights, np.int64)
    weighted = colours * weights[:, None]

    def step(prototypes: Prototypes) -> tuple[np.ndarray, np.ndarray]:
        cid = labels_array(colours, prototypes, params.metric, params.minkowski_p)
        counts = np.zeros(params.k, np.int64)
        np.add.at(counts, cid, weights)
        sums = np.zeros((params.k, colours.shape[1]), np.int64)
        np.add.at(sums, cid, weighted)
        return counts, sums

    return iterate(step, init, params)


def arrays_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Colours, weights and first places of a histogram."""
    if "c" in table.column_names:
        colours = np.array(table.column("c").to_pylist(), np.int64)
    else:
        names = [c for c in table.column_names if c[0] == "c" and c[1:].isdigit()]
        colours = np.column_stack([table.column(c).to_numpy() for c in names]).astype(np.int64)
    return colours, table.column("n").to_numpy().astype(np.int64), table.column("first_idx").to_numpy().astype(np.int64)


def fit_histogram(hist: DataFrame, init: Prototypes, params: KMeansParams, strategy: str = "auto") -> KMeansModel:
    """The loop over a histogram.

    strategy: `groupby` (a grouped aggregate per iteration), `conditional` (one row of conditional aggregates), `local`
    (histogram of at most LOCAL_CELLS cells on the driver) or `auto` (local if it is that small and the metric has a numpy
    form, else groupby). All give the same result: sums are whole numbers. Each iteration starts from the cached histogram, so plans don't grow.
    """
    d = len(init[0])
    if strategy not in ("auto", "local", "groupby", "conditional"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "local" and params.metric not in ARRAYS:
        raise ValueError(f"metric {params.metric!r} has no numpy form")
    if strategy == "auto" and params.metric not in ARRAYS:
        strategy = "groupby"
    if strategy in ("auto", "local"):
        most = LOCAL_CELLS // d
        table = hist.limit(most + 1).toArrow()
        if table.num_rows <= most:
            colours, weights, _ = arrays_of(table)
            if not len(colours):
                raise ValueError("no points")
            return fit_arrays(colours, weights, init, params)
        if strategy == "local":
            raise ValueError("the histogram is too large for the driver")
    own = not hist.is_cached
    hist = hist.persist(StorageLevel.MEMORY_AND_DISK) if own else hist
    try:

        def step(prototypes: Prototypes) -> tuple[np.ndarray, np.ndarray]:
            counts, sums = np.zeros(params.k, np.int64), np.zeros((params.k, d), np.int64)
            assigned = assign(hist, prototypes, params.metric, params.minkowski_p)
            if strategy == "conditional":
                row = conditional_sums(assigned, params.k).first()
                for cid in range(params.k):
                    counts[cid], sums[cid] = row[f"n_{cid}"], [row[f"s_{cid}_{i}"] for i in range(d)]
            else:
                for row in cluster_sums(assigned).collect():  # k rows
                    counts[row["cid"]], sums[row["cid"]] = row["n"], row["s"] if "s" in row.asDict() else [row[f"s{i}"] for i in range(d)]
            if not counts.any():
                raise ValueError("no points")
            return counts, sums

        return iterate(step, init, params)
    finally:
        if own:
            hist.unpersist()


@dataclass(frozen=True)
class Variant:
    """How one of the named algorithms seeds and sums. All sums agree, so variants with the same seeds agree too."""

    init: str
    strategy: str
    metric: str | None = "euclidean"
    check_every: int = 1


#: The public algorithms by name. metric None: the caller's.
VARIANTS: dict[str, Variant] = {
    "k-means (any distance)": Variant("random_colours", "auto", None),
    "k-means old": Variant("random_colours", "groupby"),
    "k-means": Variant("random_colours", "auto"),
    "k-means++": Variant("farthest", "auto"),
    "k-means pixel centroids": Variant("points", "auto"),
    "k-means tiled": Variant("random_colours", "groupby"),
    "k-means++ reduce": Variant("farthest", "conditional"),
    "k-means skip convergence check": Variant("random_colours", "auto", check_every=3),
    "k-means custom centroids": Variant("given", "conditional"),
}
#: The seven variants that a video run times, in the order of its columns.
VIDEO_VARIANTS = ("k-means old", "k-means", "k-means++", "k-means pixel centroids", "k-means tiled", "k-means++ reduce", "k-means skip convergence check")


def seeds(points: DataFrame, hist: DataFrame, k: int, init: str, draw: Callable[[], int], given: Prototypes | None = None) -> Prototypes:
    """First prototypes under one of the four ways; draws come from `draw` in a fixed order."""
    if init == "given":
        if given is None:
            raise ValueError("prototypes must be given")
        return given
    d = dimensions(points)
    if init == "random_colours":
        return seeding.random_colours(k, d, draw)
    if init == "farthest":
        return seeding.farthest_points(hist, k, seeding.random_colours(1, d, draw)[0])
    if init == "points":
        return seeding.points_at(points, seeding.point_indices(k, points.count(), draw))
    raise ValueError(f"unknown seeding {init!r}")


def kmeans(points: DataFrame, params: KMeansParams, variant: str = "k-means", draw: Callable[[], int] | None = None, init_prototypes: Prototypes | None = None) -> KMeansModel:
    """Cluster points with one of VARIANTS. Given prototypes override the variant's seeding (a warm start)."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; known: {', '.join(VARIANTS)}")
    v = VARIANTS[variant]
    hist = histogram(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = seeds(points, hist, params.k, "given" if init_prototypes else v.init, draw or seeding.Rand(0), init_prototypes)
        own = KMeansParams(params.k, params.stab_error, params.max_iterations, v.metric or params.metric, params.minkowski_p, params.check_every if params.check_every > 1 else v.check_every)
        strategy = "groupby" if is_array(points) and v.strategy == "conditional" else v.strategy
        return fit_histogram(hist, first, own, strategy)
    finally:
        hist.unpersist()
