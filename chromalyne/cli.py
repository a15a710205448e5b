"""Commands: image, metrics, video, video-calibration, video-showcase, profile.

A video is a folder of frame images whose names end in their numbers, or a file of raw frames (-shape HxWxD).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalyne.functions import naming
from chromalyne.operators.lloyd import KMeansParams, kmeans
from chromalyne.operators.paint import as_image, paint
from chromalyne.operators.quality import k_sweep
from chromalyne.plans import timing
from chromalyne.sources import images, tables
from chromalyne.streaming import video

#: What profile's names stand for.
PROFILE = {"old": "k-means old", "new": "k-means", "reduce": "k-means++ reduce"}
K = 3


def _number(kind: type, least: float, strict: bool):
    def check(text: str):
        value = kind(text)
        if value < least or strict and value == least:
            raise argparse.ArgumentTypeError(f"{text} is not {'over' if strict else 'at least'} {least}")
        return value

    return check


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chromalyne", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, source: str, k: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument(f"-{source}", dest="path", required=True, help="input image" if source == "i" else "input frames")
        if k:
            c.add_argument("-k", type=_number(int, 0, True), required=True, help="number of clusters")
        c.add_argument("-e", type=_number(float, 0, False), default=1.0, help="stability error")
        c.add_argument("-mi", type=_number(int, 0, True), default=100, help="iterations at most")
        return c

    command("image", "i").add_argument("-out", help="timing table")
    command("metrics", "i", k=False).add_argument("-out", default="results/metrics.csv", help="table of metrics")
    command("profile", "i").add_argument("-alg", choices=PROFILE, default="old")
    for name in ("video", "video-calibration", "video-showcase"):
        c = command(name, "v")
        c.add_argument("-shape", help="HxWxD of raw frames")
        if name != "video-showcase":
            c.add_argument("-out", help="timing table")
        if name != "video":
            c.add_argument("-cf", type=_number(int, 0, True), default=video.CALIBRATION_FRAMES, help="calibration frames")
    return out


def _frames(spark: SparkSession, path: str, shape: str | None) -> DataFrame:
    if shape:
        images.register(spark)
        height, width, depth = shape.lower().split("x")
        return images.as_images(spark.read.format("raw_video").option("height", height).option("width", width).option("depth", depth).load(path))
    return images.read_images(spark, path)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("chromalyne").getOrCreate()
    found = _frames(spark, a.path, getattr(a, "shape", None))
    height, width, depth = images.shape_of(found)
    points = images.pixels(found, depth)
    params = KMeansParams(getattr(a, "k", K) or K, a.e, a.mi)
    still = points.drop("frame_id")
    if a.command == "image":
        rows, models = timing.image_runs(still, params)
        for name, seconds in zip(timing.IMAGE_METRICS, timing.column_means(rows)):
            print(f"{name}: {seconds:.6f} s")
        for i, model in enumerate(models):
            target = naming.image_output(a.path, i)
            folder, _, file = target.rpartition("/")
            images.write_png(as_image(paint(still, model)).withColumn("frame_id", F.lit(0).cast("bigint")), height, width, folder, file.removesuffix(".png") + "_")
        tables.write_timings(spark, rows, tables.BASELINE, a.out or naming.timing_output("baseline", height, width))
    elif a.command == "metrics":
        sweep = k_sweep(still, params=params)
        sweep.orderBy("k").show(truncate=False)
        tables.write_metrics(sweep, a.out)
    elif a.command == "profile":
        model = kmeans(still, params, PROFILE[a.alg])
        print(model.prototypes, model.iterations)
    else:
        numbers = [r["frame_id"] for r in found.select("frame_id").distinct().orderBy("frame_id").toLocalIterator()]
        if a.command == "video":
            rows = timing.video_runs(points, params, numbers, video.WARM_UP_FRAMES, video.MEASURED_FRAMES)
            tables.write_timings(spark, rows, tables.VIDEO, a.out or naming.timing_output("video", height, width))
        elif a.command == "video-calibration":
            rows = timing.calibration_runs(points, params, numbers, a.cf, video.WARM_UP_FRAMES, video.MEASURED_FRAMES)
            tables.write_timings(spark, rows, tables.CALIBRATION, a.out or naming.timing_output("calibration", height, width))
        else:
            target = naming.video_output(a.path.rstrip("/"), "")
            tracked = video.showcase_batch(points, params, height, width, target, a.cf)
            last = tracked.agg(F.max("frame_id").alias("f")).first()["f"]
            for r in tracked.where(F.col("frame_id") == last).orderBy("cid").collect():  # k rows
                print([r[f"c{i}"] for i in range(depth)])
            print(target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
