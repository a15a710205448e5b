"""Questions to timing tables (resolution, variant, position, seconds): means, best variants, frame rates, speed-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_curves(sweep: DataFrame) -> DataFrame:
    """(k, curve, value) from a sweep."""
    return sweep.unpivot(["k"], ["elbow", "silhouette"], "curve", "value")


def metric_curves_from_file(metrics: DataFrame) -> DataFrame:
    """The same from a file of metrics without k, whose rows are k = 2, 3, ... in order. It has a handful of rows."""
    rows = metrics.toLocalIterator()
    numbered = [(2 + i, *map(float, r)) for i, r in enumerate(rows)]
    return metric_curves(metrics.sparkSession.createDataFrame(numbered, "k int, elbow double, silhouette double"))


def means(timings: DataFrame) -> DataFrame:
    """The mean of each variant over the runs it really has."""
    return timings.groupBy("resolution", "variant", "position").agg(F.avg("seconds").alias("mean_seconds"))


def frames_a_second(seconds: Column) -> Column:
    return F.when(seconds > 0, 1.0 / seconds).otherwise(F.lit(float("inf")))


def best(timings: DataFrame) -> DataFrame:
    """The fastest variant of each resolution (of equal ones the first column) and its frames a second."""
    least = means(timings).groupBy("resolution").agg(F.min(F.struct("mean_seconds", "position", "variant")).alias("b"))
    return least.select("resolution", F.col("b.variant").alias("variant"), F.col("b.mean_seconds").alias("mean_seconds"), frames_a_second(F.col("b.mean_seconds")).alias("fps"))


def column_mean(timings: DataFrame, position: int, name: str) -> DataFrame:
    return means(timings).where(F.col("position") == position).select("resolution", F.col("mean_seconds").alias(name))


def against_baseline(timings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each resolution's best variant, and how many times faster it is than the baseline's first column."""
    cpu = column_mean(baseline, 0, "baseline_seconds")
    return best(timings).join(cpu, "resolution").withColumn("speedup", F.col("baseline_seconds") / F.col("mean_seconds"))


def three_ways(baseline: DataFrame, video: DataFrame, calibration: DataFrame) -> DataFrame:
    """Baseline (first column), reduce (sixth) and calibration (first) side by side, the best of them and its speed-up."""
    joined = column_mean(baseline, 0, "cpu").join(column_mean(video, 5, "gpu"), "resolution").join(column_mean(calibration, 0, "calibrated"), "resolution")
    options = [F.struct(F.col(c).alias("seconds"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (c, n) in enumerate((("cpu", "CPU baseline"), ("gpu", "GPU reduce"), ("calibrated", "GPU calibration")))]
    out = joined.withColumn("b", F.least(*options))
    return out.select("resolution", "cpu", "gpu", "calibrated", F.col("b.name").alias("best"), frames_a_second(F.col("b.seconds")).alias("fps"), (F.col("cpu") / F.col("b.seconds")).alias("speedup"))
