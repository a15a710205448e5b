"""CSV tables of timings and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalyne.sources.storage import exists

#: The columns of the result files.
BASELINE = ("Squared euclidean distance", "Manhattan distance", "Chebyshev distance", "Minkowski distance", "Cosine distance")
VIDEO = ("k-means old", "k-means", "k-means++", "k-means pixel centroids", "k-means tiled", "k-means++ reduce", "k-means skip convergence check")
CALIBRATION = ("k-means with calibration",)
METRICS = ("Elbow method total squared error", "Silhouette method average score")


def stripped(df: DataFrame) -> DataFrame:
    """Column names without blanks around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """A result file with a header; all columns are doubles, so no pass is spent on inferring types."""
    raw = stripped(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path))
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns])


def read_present(spark: SparkSession, paths: dict[str, str], warn=print) -> DataFrame | None:
    """Those of the named result files that exist, stacked long with their name as `resolution`; missing ones are warned of."""
    out = None
    for name, path in paths.items():
        if not exists(spark, path):
            warn(f"Warning: {path} not found, skipping")
            continue
        long = long_timings(read_timings(spark, path), name)
        out = long if out is None else out.unionByName(long)
    return out


def long_timings(wide: DataFrame, resolution: str) -> DataFrame:
    """(resolution, variant, position, seconds): position is the column's place."""
    names = wide.columns
    places = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    long = wide.unpivot([], names, "variant", "seconds")
    return long.select(F.lit(resolution).alias("resolution"), "variant", places[F.col("variant")].alias("position"), "seconds")


def write_timings(spark: SparkSession, rows: Sequence[Sequence[float]], columns: Sequence[str], path: str) -> None:
    """One file with a header and a row per run."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    spark.createDataFrame([tuple(float(x) for x in r) for r in rows], schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(sweep: DataFrame, path: str) -> None:
    """The sweep as a file, k first, ordered by k."""
    named = sweep.select("k", F.col("elbow").alias(METRICS[0]), F.col("silhouette").alias(METRICS[1]))
    named.coalesce(1).orderBy("k").write.mode("overwrite").option("header", True).csv(path)
