import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from chromalyne import cli
from chromalyne.operators import lloyd, seeding
from chromalyne.operators.lloyd import KMeansParams
from chromalyne.plans import analytics
from chromalyne.sources import images, storage, tables
from chromalyne.streaming import video


def movie(n=6, height=4, width=5):
    rng = np.random.default_rng(8)
    return rng.integers(0, 256, (n, height, width, 3)).astype(np.uint8)


def as_points(spark, clip):
    rows = [(f, i, *map(int, px)) for f, one in enumerate(clip) for i, px in enumerate(one.reshape(-1, 3))]
    return spark.createDataFrame(rows, "frame_id long, idx long, c0 int, c1 int, c2 int")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("movie"))
    images.write_png(as_points(spark, movie()), 4, 5, path)
    return path


def test_png_round_trip(spark, folder):
    found = images.read_images(spark, folder)
    assert images.shape_of(found) == (4, 5, 3)
    want = as_points(spark, movie())
    for read in (images.pixels, images.pixels_expr):
        assert read(found).exceptAll(want).count() == 0 and read(found).count() == want.count()
    assert images.frame_count(images.pixels(found)).first()["frames"] == 6


def test_bgr_order_and_a_known_file(spark, tmp_path):
    cells = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0]], [[3, 2, 1], [6, 5, 4], [9, 8, 7]]], np.uint8)
    images.write_png(as_points(spark, cells[None]), 2, 3, str(tmp_path / "one"))
    data = images.read_images(spark, str(tmp_path / "one")).first()["image"]["data"]
    assert list(data) == [0, 0, 255, 0, 255, 0, 255, 0, 0, 3, 2, 1, 6, 5, 4, 9, 8, 7]


def test_frames_of_unequal_shape_or_size_are_errors(spark, folder, tmp_path):
    images.write_png(as_points(spark, movie(1, 2, 2)), 2, 2, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        images.shape_of(images.read_images(spark, folder).union(images.read_images(spark, str(tmp_path / "x"))))
    with pytest.raises(Exception, match="pixels"):
        images.images_from_pixels(as_points(spark, movie(1)), 9, 9).collect()


def test_raw_video(spark, tmp_path):
    clip = movie(5)
    (tmp_path / "clip.raw").write_bytes(clip.tobytes())
    images.register(spark)
    found = images.as_images(spark.read.format("raw_video").option("height", 4).option("width", 5).option("framesPerTask", 2).load(str(tmp_path / "clip.raw")))
    assert images.pixels(found).exceptAll(as_points(spark, clip)).count() == 0 and found.count() == 5


def test_per_frame_equals_single_fits(spark):
    clip = movie()
    draw = {f: seeding.random_colours(3, 3, seeding.Rand(f + 1)) for f in range(6)}
    got = {(r["frame_id"], r["cid"]): [r["c0"], r["c1"], r["c2"]] for r in video.per_frame(as_points(spark, clip), KMeansParams(3), lambda f, d: draw[f]).collect()}
    for f, one in enumerate(clip):
        want, _, _ = oracle.lloyd(one.reshape(-1, 3).tolist(), draw[f])
        assert [got[f, c] for c in range(3)] == want


def tracked(clip, calibration, k=3):
    draw, best, now, out = seeding.Rand(0), None, None, []
    for f, one in enumerate(clip):
        cells = one.reshape(-1, 3).tolist()
        first = seeding.random_colours(k, 3, draw) if f < calibration else now
        new, old, _ = oracle.lloyd(cells, first)
        if f < calibration:
            error = sum(int(oracle.distance("euclidean", c, new[oracle.label(c, old, "euclidean")])) ** 2 for c in cells)
            if best is None or error < best:
                best, now = error, new
        else:
            now = new
        out.append(new)
    return out


def rows_of(df):
    got = {(r["frame_id"], r["cid"]): [r["c0"], r["c1"], r["c2"]] for r in df.collect()}
    return [[got[f, c] for c in range(3)] for f in range(len(got) // 3)]


def test_calibration_and_warm_start(spark):
    clip = movie(8)
    want = tracked(clip, 3)
    df = as_points(spark, clip)
    assert rows_of(video.track(df, KMeansParams(3), 3)) == want
    many = df.withColumn("video_id", F.lit(1).cast("long")).unionByName(df.withColumn("video_id", F.lit(2).cast("long")))
    both = video.track_many(many, KMeansParams(3), 3)
    assert rows_of(both.where("video_id = 1")) == rows_of(both.where("video_id = 2")) == want
    with pytest.raises(ValueError):
        video.track(df, KMeansParams(3), 0)


def test_stream_equals_batch_and_writes_every_frame(spark, folder, tmp_path):
    rows, out = [], str(tmp_path / "painted")
    stream = images.pixels(images.stream_images(spark, folder, 2))
    video.showcase(stream, KMeansParams(3), 4, 5, out, lambda df: rows.extend(df.collect()), str(tmp_path / "progress"), 2).trigger(availableNow=True).start().awaitTermination()
    want = tracked(movie(), 2)
    got = {(r["frame_id"], r["cid"]): [r["c0"], r["c1"], r["c2"]] for r in rows}
    assert [[got[f, c] for c in range(3)] for f in range(6)] == want
    painted = images.pixels(images.read_images(spark, out))
    assert painted.count() == 120
    colours = {(r["frame_id"], r["c0"], r["c1"], r["c2"]) for r in painted.distinct().collect()}
    assert all(list(c[1:]) in want[c[0]] for c in colours)


def test_scratch_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "_given", [])
    df = storage.written(spark.range(5), "five")
    path = storage._given[0]
    assert df.count() == 5 and storage.exists(spark, path)
    storage.clear(spark)
    assert not storage.exists(spark, path) and not storage._given
    storage.put_text(spark, str(tmp_path / "a.json"), "{1}")
    storage.put_text(spark, str(tmp_path / "a.json"), "{2}")
    assert storage.get_text(spark, str(tmp_path / "a.json")) == "{2}"


def test_a_stream_goes_on_after_a_restart_and_over_gaps(spark, tmp_path):
    """Stopped after a few batches and started again from its checkpoint, with a frame number missing, it gives what `track` gives."""
    clip = movie(9)
    df = as_points(spark, clip).where("frame_id != 4")
    source, rows = str(tmp_path / "in"), []

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        video.track_stream(stream, KMeansParams(3), lambda r: rows.extend(r.collect()), str(tmp_path / "p"), 3).trigger(availableNow=True).start().awaitTermination()

    for first, last in ((0, 2), (2, 5), (5, 9)):  # one stops while it calibrates
        for f in range(first, last):
            video.frames_between(df, f, f + 1).coalesce(1).write.mode("append").parquet(source)
        run()
    want = video.track(df, KMeansParams(3), 3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and len(want) == 24
    slow = video.track(df, KMeansParams(3), 3, seeding.Rand(0)).collect()  # given draws: a fit per frame
    assert sorted(map(tuple, slow)) == sorted(map(tuple, want))


def test_a_repeated_batch_gives_the_same_rows(spark, tmp_path):
    """A batch that failed after its rows were written is run again from the state before it."""
    df = as_points(spark, movie(5))
    source, rows, fail = str(tmp_path / "in"), [], [3]

    def sink(r):
        found = r.collect()
        rows.append(found)
        if found[0]["frame_id"] in fail:
            fail.clear()
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        video.track_stream(stream, KMeansParams(3), sink, str(tmp_path / "p"), 2).trigger(availableNow=True).start().awaitTermination()

    for f in range(5):
        df.where(F.col("frame_id") == f).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert [r[0]["frame_id"] for r in rows] == [0, 1, 2, 3, 3, 4] and rows[3] == rows[4]
    assert sorted(tuple(x) for r in rows[:3] + rows[4:] for x in r) == sorted(map(tuple, video.track(df, KMeansParams(3), 2).collect()))


def test_a_late_frame_is_an_error(spark, tmp_path):
    df = as_points(spark, movie(3))
    for f in (1, 0):
        df.where(F.col("frame_id") == f).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="came after"):
        video.track_stream(stream, KMeansParams(3), lambda r: None, str(tmp_path / "p"), 2).trigger(availableNow=True).start().awaitTermination()


def test_showcase_of_a_table_equals_the_stream(spark, folder, tmp_path):
    points = images.pixels(images.read_images(spark, folder))
    tables = {}
    for kind in ("stream", "batch"):
        out = str(tmp_path / kind)
        if kind == "batch":
            video.showcase_batch(points, KMeansParams(3), 4, 5, out, 2)
        else:
            stream = images.pixels(images.stream_images(spark, folder, 6))
            video.showcase(stream, KMeansParams(3), 4, 5, out, lambda r: None, str(tmp_path / "progress"), 2).trigger(availableNow=True).start().awaitTermination()
        tables[kind] = sorted(map(tuple, images.pixels(images.read_images(spark, out)).collect()))
    assert tables["stream"] == tables["batch"] and len(tables["batch"]) == 120


def test_showcase_command_reads_raw_frames(spark, tmp_path, capsys):
    from chromalyne import cli

    df = as_points(spark, movie(4))
    images.write_raw(df, 4, 5, str(tmp_path / "clip.raw"))
    assert cli.main(["video-showcase", "-v", str(tmp_path / "clip.raw"), "-shape", "4x5x3", "-k", "3", "-cf", "2"], spark) == 0
    printed = capsys.readouterr().out.splitlines()
    assert len(printed) == 4 and images.pixels(images.read_images(spark, printed[-1])).count() == 80


def test_stateful_streams(spark, tmp_path):
    clip = movie(7)
    want = tracked(clip, 3)
    df = as_points(spark, clip).withColumn("video_id", F.lit(5).cast("long"))
    both = df.unionByName(df.withColumn("video_id", F.lit(6).cast("long")))
    for f in range(7):
        both.where(F.col("frame_id") == f).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = video.track_many_stream(stream, KMeansParams(3), 3).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    run.awaitTermination()
    for v in (5, 6):
        assert rows_of(spark.table("tracked").where(F.col("video_id") == v)) == want
    out, first = [], [[1, 2, 3], [200, 100, 50]]
    one = video.per_frame_stream(stream.where("video_id = 5"), KMeansParams(2), lambda f, d: first, lambda x: out.extend(x.collect()))
    one.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "q")).start().awaitTermination()
    batch = video.per_frame(df, KMeansParams(2), lambda f, d: first).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch))


def test_frame_ranges(spark):
    df = spark.range(60).select(F.col("id").alias("frame_id"))
    assert video.measured(df).count() == 30 and video.measured(df, 10).agg(F.min("frame_id")).first()[0] == 15
    assert video.frames_between(df, 55).count() == 5


def test_timing_tables(spark, tmp_path):
    path = str(tmp_path / "video_240.csv")
    tables.write_timings(spark, [[1, 2, 3, 4, 5, 6, 7], [3, 2, 1, 4, 5, 6, 7]], [tables.VIDEO[0], *[f" {c}" for c in tables.VIDEO[1:]]], path)
    wide = tables.read_timings(spark, path)
    assert wide.columns == list(tables.VIDEO)
    warned = []
    long = tables.read_present(spark, {"240p": path, "480p": str(tmp_path / "none.csv")}, warned.append)
    assert len(warned) == 1 and long.count() == 14
    best = analytics.best(long).first()
    assert (best["variant"], best["mean_seconds"], best["fps"]) == ("k-means old", 2.0, 0.5)
    three = analytics.three_ways(long, long, long).first()
    assert (three["best"], three["speedup"]) == ("CPU baseline", 1.0)
    assert analytics.against_baseline(long, long).first()["speedup"] == 1.0
    zero = long.withColumn("seconds", F.lit(0.0))
    assert analytics.best(zero).first()["fps"] == float("inf")


def test_metric_curves_rebuild_k(spark):
    df = spark.createDataFrame([(9.0, 0.5), (4.0, 0.7)], "`Elbow` double, `Silhouette` double").coalesce(1)
    got = {(r["k"], r["curve"]): r["value"] for r in analytics.metric_curves_from_file(df).collect()}
    assert got == {(2, "elbow"): 9.0, (3, "elbow"): 4.0, (2, "silhouette"): 0.5, (3, "silhouette"): 0.7}


def test_commands(spark, folder, tmp_path, capsys, monkeypatch):
    still = str(tmp_path / "still")
    images.write_png(as_points(spark, movie(1)), 4, 5, still, "pic_")
    one = f"{still}/pic_00000000.png"
    monkeypatch.setattr(cli.timing.image_runs, "__defaults__", (0, 2))
    assert cli.main(["image", "-i", one, "-k", "2", "-out", str(tmp_path / "b.csv")], spark) == 0
    assert tables.read_timings(spark, str(tmp_path / "b.csv")).count() == 2
    assert len(list((tmp_path / "still").glob("output_*.png"))) == 5
    assert cli.main(["metrics", "-i", one, "-out", str(tmp_path / "m.csv")], spark) == 0
    assert tables.read_timings(spark, str(tmp_path / "m.csv")).count() == 9
    for name in cli.PROFILE:
        assert cli.main(["profile", "-i", one, "-k", "2", "-alg", name], spark) == 0
    monkeypatch.setattr(cli.video, "WARM_UP_FRAMES", 1)
    monkeypatch.setattr(cli.video, "MEASURED_FRAMES", 2)
    assert cli.main(["video", "-v", folder, "-k", "2", "-out", str(tmp_path / "v.csv")], spark) == 0
    assert tables.read_timings(spark, str(tmp_path / "v.csv")).columns == list(lloyd.VIDEO_VARIANTS)
    assert cli.main(["video-calibration", "-v", folder, "-k", "2", "-cf", "2", "-out", str(tmp_path / "c.csv")], spark) == 0
    assert tables.read_timings(spark, str(tmp_path / "c.csv")).count() == 2
    for bad in (["image", "-i", one, "-k", "0"], ["image", "-i", one, "-k", "2", "-e", "-1"], ["image", "-k", "2"], ["nope"], ["video-calibration", "-v", folder, "-k", "2", "-cf", "0"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
