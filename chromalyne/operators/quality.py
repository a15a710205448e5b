"""How good a clustering is: elbow error, labels read off a painted image, silhouette, and a sweep over k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from chromalyne.functions.distances import MINKOWSKI_P, metric
from chromalyne.operators import seeding
from chromalyne.operators.lloyd import KMeansParams, Prototypes, fit_histogram, nearest
from chromalyne.operators.paint import paint
from chromalyne.operators.points import channel_names, channels, histogram

#: Rows of a table that is broadcast against all others at most.
BROADCAST_ROWS = 200_000
#: Points that are ranked for a sample, as a multiple of its size.
RANKED = 8


def elbow_error(painted: DataFrame, name: str = "euclidean", p: float = MINKOWSKI_P) -> DataFrame:
    """One row `elbow`: the sum of squared distances from each point to its painted colour, each distance cut to a whole
    number before it is squared. A projection and one aggregate; `n` weights rows of a histogram."""
    names = channel_names(painted)
    d = metric(name)([F.col(c) for c in names], [F.col(f"r{i}") for i in range(len(names))], p).cast("int").cast("bigint")
    weight = F.col("n") if "n" in painted.columns else F.lit(1)
    return painted.agg(F.coalesce(F.sum(d * d * weight), F.lit(0)).cast("double").alias("elbow"))


def painted_centroids(painted: DataFrame, k: int) -> Prototypes:
    """The first k distinct painted colours in scan order: their rank is the new cluster. Fewer if prototypes were equal."""
    names = [f"r{i}" for i in range(len(channel_names(painted)))]
    place = "first_idx" if "first_idx" in painted.columns else "idx"
    found = painted.groupBy(*names).agg(F.min(place).alias("first")).orderBy("first").limit(k).collect()
    return [[r[c] for c in names] for r in found]


def extract_assignments(painted: DataFrame, k: int, name: str = "euclidean", p: float = MINKOWSKI_P) -> tuple[DataFrame, Prototypes]:
    """Source rows with `cid`, the nearest of the painted colours. Equal prototypes merge, and labels can differ from the
    fit's, which lag one update."""
    centroids = painted_centroids(painted, k)
    if not centroids:
        raise ValueError("no points")
    kept = [c for c in painted.columns if c != "cid" and not (c.startswith("r") and c[1:].isdigit())]
    return painted.select(*kept, nearest(channels(painted), centroids, name, p).alias("cid")), centroids


def _silhouette(anchors: DataFrame, everyone: DataFrame, names: list[str], name: str, p: float) -> DataFrame:
    """One row `silhouette` from anchors (cid, channels, weight; each colour of a cluster once) and all colours (cid, channels, n).

    Distances to equal colours are counted once per pair of colours, times n; from an anchor's own colour one point is
    the anchor itself. A cluster of one point has no silhouette, nor has a point where both means are 0. An anchor is
    named by its cluster and colour, so recomputed tasks name it alike.
    """
    sizes = everyone.groupBy("cid").agg(F.sum("n").alias("size"))
    cells = [f"a{i}" for i in range(len(names))]
    a = anchors.select(F.col("cid").alias("own"), "weight", *[F.col(c).alias(x) for x, c in zip(cells, names)])
    a = a.join(F.broadcast(sizes.withColumnRenamed("cid", "own")), "own").where("size > 1").drop("size")  # k rows
    same = None
    for x, c in zip(cells, names):
        same = (F.col(x) == F.col(c)) if same is None else same & (F.col(x) == F.col(c))
    d = metric(name)([F.col(x) for x in cells], [F.col(c) for c in names], p).cast("double")
    times = F.col("n") - F.when(same & (F.col("cid") == F.col("own")), 1).otherwise(0)
    few = a.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # few colours are in one partition, yet their pairs with the anchors are the work
    pairs = F.broadcast(a).crossJoin(everyone.repartition(everyone.sparkSession.sparkContext.defaultParallelism, *names)) if few else a.crossJoin(everyone)
    per = pairs.groupBy("own", *cells, "weight", "cid").agg(F.sum(d * times).alias("total"), F.sum(times).alias("count"))
    mean = F.when(F.col("count") > 0, F.col("total") / F.col("count")).otherwise(0.0)
    both = per.groupBy("own", *cells, "weight").agg(
        F.max(F.when(F.col("cid") == F.col("own"), mean)).alias("inner"),
        F.min(F.when(F.col("cid") != F.col("own"), mean)).alias("outer"),
    )
    valid = both.where("outer is not null and (inner > 0 or outer > 0)")
    s = (F.col("outer") - F.col("inner")) / F.greatest("outer", "inner")
    return valid.agg(F.coalesce(F.sum(s * F.col("weight")) / F.sum("weight"), F.lit(0.0)).alias("silhouette"))


def silhouette(labelled: DataFrame, name: str = "euclidean", p: float = MINKOWSKI_P) -> DataFrame:
    """The mean silhouette of all points, from a labelled histogram (channels, n, cid). Quadratic in distinct colours by definition."""
    return _silhouette(labelled.withColumn("weight", F.col("n")), labelled, channel_names(labelled), name, p)


def sample_order(place: Column) -> Column:
    """A fixed pseudo-random order of places."""
    return F.md5(place.cast("string"))


def foremost(points: DataFrame, max_samples: int, total: int) -> DataFrame:
    """Of total points those that sample_order puts first, about RANKED * max_samples: the order is uniform, so a bound on
    it takes them in one scan without a sort. They do not depend on labels, so samples of many labellings draw from them."""
    share = RANKED * max_samples / max(total, 1)
    if share >= 1:
        return points
    return points.where(F.coalesce(sample_order(F.col("idx")) < f"{int(share * 16**15):015x}", F.lit(True)))  # no place comes first


def stratified_sample(points: DataFrame, max_samples: int, sizes: dict[int, int] | None = None, first: DataFrame | None = None) -> DataFrame:
    """Of each cluster max(1, floor(max_samples * size / total)) points, the first by sample_order.

    Only the foremost points are ranked; of a cluster that has fewer of them than its quota (a very small one) all
    points are. Quotas are whole numbers of any size. sizes: the clusters' points, where they are known; first: the
    foremost points with their labels, where they are there.
    """
    if sizes is None:
        sizes = {r["cid"]: r["count"] for r in points.groupBy("cid").count().collect()}  # k rows
    total = sum(sizes.values())
    quotas = {cid: max(1, max_samples * size // total) for cid, size in sizes.items() if cid is not None}
    first = foremost(points, max_samples, total) if first is None else first
    there = {r["cid"]: r["count"] for r in first.groupBy("cid").count().collect()}  # k rows
    short = [cid for cid, quota in quotas.items() if there.get(cid, 0) < min(quota, sizes[cid])]
    if short:
        first = first.where(~F.col("cid").isin(short)).unionByName(points.where(F.col("cid").isin(short)))
    order = Window.partitionBy("cid").orderBy(sample_order(F.col("idx")), "idx")
    ranked = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, max_samples))
    quota = points.sparkSession.createDataFrame(list(quotas.items()), f"cid {points.schema['cid'].dataType.simpleString()}, quota bigint")
    return ranked.join(F.broadcast(quota), "cid").where("place <= quota").drop("place", "quota")


def silhouette_sampled(points: DataFrame, max_samples: int, name: str = "euclidean", p: float = MINKOWSKI_P, everyone: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """The mean silhouette of a stratified sample of labelled points (idx, channels, cid); distances still go to all points.

    With at most max_samples points, all of them are anchors. Anchors of one colour and cluster are one, with their
    number as weight; their rows are bounded by max_samples and the number of clusters. everyone: the labelled histogram
    (channels, cid, n) where there is one; points are then scanned for the sample alone. first: the foremost points with
    their labels, where they are there; points are then scanned for very small clusters alone.
    """
    names = channel_names(points)
    everyone = points.groupBy("cid", *names).agg(F.count("*").alias("n")) if everyone is None else everyone.select("cid", *names, "n")
    sizes = {r["cid"]: r["size"] for r in everyone.groupBy("cid").agg(F.sum("n").alias("size")).collect()}  # k rows
    if sum(sizes.values()) <= max_samples:
        return _silhouette(everyone.withColumn("weight", F.col("n")), everyone, names, name, p)
    sample = stratified_sample(points, max_samples, sizes, first).groupBy("cid", *names).agg(F.count("*").alias("weight"))
    return _silhouette(sample, everyone, names, name, p)


def k_sweep(points: DataFrame, ks: range = range(2, 11), params: KMeansParams | None = None, max_samples: int = 5000, draw: Callable[[], Callable[[], int]] = lambda: seeding.Rand(0), with_silhouette: bool = True) -> DataFrame:
    """A row (k, elbow, silhouette) for every k: random colours from a fresh stream, Euclidean distance. The histogram and
    the foremost points, from which every k draws its sample, are built once, each in a scan of the points, and shared by
    all k; a k gives one row, so the rows are gathered as they come."""
    base = params or KMeansParams(2)
    d = len(channel_names(points))
    hist = histogram(points).persist(StorageLevel.MEMORY_AND_DISK)
    first = None
    out = []
    try:
        if with_silhouette:
            total = hist.agg(F.sum("n").alias("n")).first()["n"] or 0
            first = foremost(points, max_samples, total).persist(StorageLevel.MEMORY_AND_DISK)
        for k in ks:
            model = fit_histogram(hist, seeding.random_colours(k, d, draw()), KMeansParams(k, base.stab_error, base.max_iterations))
            painted = paint(hist, model)
            row = (k, elbow_error(painted).first()["elbow"])
            if with_silhouette:
                label = nearest(channels(points), painted_centroids(painted, k), "euclidean", MINKOWSKI_P)
                labelled, everyone, drawn = (x.withColumn("cid", label) for x in (points, hist, first))
                row = (*row, silhouette_sampled(labelled, max_samples, everyone=everyone, first=drawn).first()["silhouette"])
            out.append(row)
    finally:
        hist.unpersist()
        if first is not None:
            first.unpersist()
    return hist.sparkSession.createDataFrame(out, "k int, elbow double" + ", silhouette double" * with_silhouette)
