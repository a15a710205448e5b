"""Frame sequences: each frame by itself, calibration on the first frames, warm starts from frame to frame, as batch and as stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from chromalyne.functions.distances import ARRAYS, order_key
from chromalyne.operators import seeding
from chromalyne.operators.lloyd import LOCAL_CELLS, KMeansModel, KMeansParams, fit_arrays, fit_histogram, labels_array
from chromalyne.operators.paint import paint
from chromalyne.operators.points import channel_names, histogram
from chromalyne.operators.quality import elbow_error
from chromalyne.operators.seeding import Prototypes
from chromalyne.sources.storage import delete_path, get_text, put_text, written

WARM_UP_FRAMES, MEASURED_FRAMES, CALIBRATION_FRAMES = 5, 30, 10


def frames_between(points: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Frames first to last - 1: what warm-up, calibration and frame limits select."""
    out = points.where(F.col("frame_id") >= first)
    return out if last is None else out.where(F.col("frame_id") < last)


def measured(points: DataFrame, calibration: int = 0) -> DataFrame:
    return frames_between(points, calibration + WARM_UP_FRAMES, calibration + WARM_UP_FRAMES + MEASURED_FRAMES)


def per_frame(points: DataFrame, params: KMeansParams, seeds: Callable[[int, int], Prototypes]) -> DataFrame:
    """(frame_id, cid, iterations, c0..): every frame clustered by itself from seeds(frame_id, channels).

    Colours are counted per frame first; a task then gets a frame's histogram, which the colour cube and the frame's
    pixels bound, and frames run in parallel.
    """
    names = channel_names(points)

    def fit(table: pa.Table) -> pa.Table:
        frame = table.column("frame_id")[0].as_py()
        colours = np.column_stack([table.column(c).to_numpy() for c in names])
        model = fit_arrays(colours, table.column("n").to_numpy(), seeds(frame, len(names)), params)
        out = {"frame_id": [frame] * params.k, "cid": list(range(params.k)), "iterations": [model.iterations] * params.k}
        out |= {c: [q[i] for q in model.prototypes] for i, c in enumerate(names)}
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int32()] * len(names)]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    schema = "frame_id long, cid int, iterations int, " + ", ".join(f"{c} int" for c in names)
    return histogram(points, ["frame_id"]).groupBy("frame_id").applyInArrow(fit, schema)


@dataclass
class Tracker:
    """The state of a calibrated video: the first `calibration` frames are clustered from fresh random colours and the
    prototypes with the smallest elbow error are kept (of equal ones the earlier frame's); each later frame starts from
    the frame before. `seen` frames were clustered, the last one was `last`, and `draws` numbers were drawn for them."""

    params: KMeansParams
    calibration: int = CALIBRATION_FRAMES
    draw: Callable[[], int] = field(default_factory=lambda: seeding.Rand(0))
    best_error: float | None = None
    prototypes: Prototypes | None = None
    seen: int = 0
    last: int | None = None
    draws: int = 0

    def drawn(self) -> int:
        self.draws += 1
        return self.draw()

    def step(self, hist: DataFrame, frame: int | None = None) -> tuple[KMeansModel, float | None]:
        """Cluster the next frame's histogram; the error is given while calibrating."""
        d = len(channel_names(hist))
        calibrating = self.seen < self.calibration
        first = seeding.random_colours(self.params.k, d, self.drawn) if calibrating or self.prototypes is None else self.prototypes
        model = fit_histogram(hist, first, self.params)
        error = None
        if calibrating:
            error = elbow_error(paint(hist, model)).first()["elbow"]
            if self.best_error is None or error < self.best_error:
                self.best_error, self.prototypes = error, model.prototypes
        else:
            self.prototypes = model.prototypes
        self.seen, self.last = self.seen + 1, frame
        return model, error

    def saved(self) -> str:
        return json.dumps({x: getattr(self, x) for x in ("best_error", "prototypes", "seen", "last", "draws")})

    def restored(self, text: str, draw: Callable[[], int]) -> Tracker:
        """The tracker as it was saved; draw starts anew and skips what was drawn."""
        state = json.loads(text)
        for _ in range(state["draws"]):
            draw()
        return Tracker(self.params, self.calibration, draw, **state)


def _rows(frame: int, phase: str, model: KMeansModel, error: float | None) -> list[tuple]:
    return [(frame, phase, cid, model.iterations, error, *q) for cid, q in enumerate(model.prototypes)]


def _schema(names: list[str]) -> str:
    return "frame_id long, phase string, cid int, iterations int, error double, " + ", ".join(f"{c} int" for c in names)


def track(points: DataFrame, params: KMeansParams, calibration: int = CALIBRATION_FRAMES, draw: Callable[[], int] | None = None) -> DataFrame:
    """(frame_id, phase, cid, iterations, error, c0..) of a video, frame after frame.

    Frames depend on each other, so the loop is sequential. Points are counted per frame once. Where every frame's
    histogram is at most LOCAL_CELLS cells and draws and metric are the library's own, one task runs the loop over the
    sorted histograms, a frame at a time, as track_many does; otherwise each frame is a distributed fit that reads only
    that frame.
    """
    if calibration < 1:
        raise ValueError("the number of calibration frames must be positive")
    names = channel_names(points)
    hist = written(histogram(points, ["frame_id"]).repartition("frame_id"), "frame-histograms")
    largest = hist.groupBy("frame_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if draw is None and params.metric in ARRAYS and largest * len(names) <= LOCAL_CELLS:
        one = hist.drop("first_idx").withColumn("video_id", F.lit(0).cast("bigint"))
        return _tracked(one, names, params, calibration).select("frame_id", "phase", "cid", "iterations", "error", *names)
    tracker, out = Tracker(params, calibration, draw or seeding.Rand(0)), []
    for row in hist.select("frame_id").distinct().orderBy("frame_id").toLocalIterator():
        frame = row["frame_id"]
        phase = "calibration" if tracker.seen < calibration else "tracking"
        model, error = tracker.step(hist.where(F.col("frame_id") == frame).drop("frame_id"), frame)
        out += _rows(frame, phase, model, error)
    return points.sparkSession.createDataFrame(out, _schema(names))


def track_stream(frames: DataFrame, params: KMeansParams, sink: Callable[[DataFrame], None], checkpoint: str, calibration: int = CALIBRATION_FRAMES, draws: Callable[[], Callable[[], int]] = seeding.Rand, painted: Callable[[int, DataFrame], None] | None = None):
    """The same over a stream of points (frame_id, idx, c0..); returns the writer to start.

    A micro-batch must hold whole frames, and frames must come in order; inside a batch they are sorted. Missing numbers
    are skipped, as `track` does. A frame that comes after a later one is an error, never a silent loss. sink gets each
    clustered frame's rows; painted, if given, each frame's number and painted points (calibration frames too), as a
    showcase of the whole video needs.

    State is k x d numbers and what was drawn. It is written beside the checkpoint's own files for every batch, so that a
    restart goes on where the checkpoint does; a batch that is repeated starts from the state before it and gives the
    same rows. For fault tolerance the sink should therefore be idempotent per frame_id. draws gives a fresh generator.
    """
    names = channel_names(frames)
    place = lambda n: f"{checkpoint.rstrip('/')}/tracker/{n}.json"
    kept: dict[int, str] = {}

    def batch(points: DataFrame, number: int) -> None:
        spark = points.sparkSession
        tracker = Tracker(params, calibration, draws())
        if number:
            before = kept.get(number - 1)
            tracker = tracker.restored(get_text(spark, place(number - 1)) if before is None else before, draws())
        points = points.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for row in points.select("frame_id").distinct().orderBy("frame_id").toLocalIterator():
                frame = row["frame_id"]
                if tracker.last is not None and frame <= tracker.last:
                    raise ValueError(f"frame {frame} came after frame {tracker.last}")
                own = points.where(F.col("frame_id") == frame).drop("frame_id")
                phase = "calibration" if tracker.seen < calibration else "tracking"
                model, error = tracker.step(histogram(own), frame)
                sink(spark.createDataFrame(_rows(frame, phase, model, error), _schema(names)))
                if painted:
                    painted(frame, paint(own, model))
        finally:
            points.unpersist()
        kept.clear()
        kept[number] = tracker.saved()
        put_text(spark, place(number), kept[number])
        if number > 1:
            delete_path(spark, place(number - 2))

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def showcase(frames: DataFrame, params: KMeansParams, height: int, width: int, path: str, sink: Callable[[DataFrame], None], checkpoint: str, calibration: int = CALIBRATION_FRAMES, draws: Callable[[], Callable[[], int]] = seeding.Rand):
    """A stream that tracks a video and writes every painted frame as a PNG."""
    from chromalyne.operators.paint import as_image
    from chromalyne.sources.images import write_png

    def painted(frame: int, points: DataFrame) -> None:
        write_png(as_image(points).withColumn("frame_id", F.lit(frame).cast("bigint")), height, width, path)

    return track_stream(frames, params, sink, checkpoint, calibration, draws, painted)


def showcase_batch(points: DataFrame, params: KMeansParams, height: int, width: int, path: str, calibration: int = CALIBRATION_FRAMES) -> DataFrame:
    """The same over a table, as of raw frames: the video is tracked, then all frames are painted at once and written as PNG.
    Returns what `track` does.

    A frame's labels come from the prototypes it was clustered with before its last update, which the tracked rows don't
    hold, so they are tracked here along with the rest: 2 k x d numbers a frame.
    """
    from chromalyne.sources.images import write_png

    names = channel_names(points)
    hist = histogram(points, ["frame_id"]).drop("first_idx").withColumn("video_id", F.lit(0).cast("bigint"))
    tracked = written(_tracked(hist, names, params, calibration), "showcase")
    cells = lambda prefix: F.array(*[F.col(f"{prefix}{c}") for c in names])
    per = tracked.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("cid", cells("").alias("now"), cells("old_").alias("old")))).alias("m"))
    joined = points.join(per, "frame_id")
    own = F.array(*names)
    nearest = F.array_min(F.transform("m", lambda x: F.struct(order_key(params.metric, own, x["old"], params.minkowski_p, len(names)).alias("d"), x["cid"].alias("cid"))))["cid"]
    shade = F.element_at("m", nearest + 1)["now"]
    painted = joined.select("frame_id", "idx", shade.alias("r")).select("frame_id", "idx", *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(names)])
    write_png(painted, height, width, path)
    return tracked.select("frame_id", "phase", "cid", "iterations", "error", *names)


@dataclass
class FrameState:
    """The state of one video on arrays: frames seen, the smallest calibration error, the prototypes to go on from."""

    seen: int = 0
    best: float = float("inf")
    now: Prototypes | None = None

    def advance(self, colours: np.ndarray, weights: np.ndarray, params: KMeansParams, calibration: int) -> tuple[KMeansModel, float | None]:
        """Cluster the next frame; the error is given while calibrating. Each video draws from a stream of its own, k * d
        numbers per calibration frame."""
        calibrating, d = self.seen < calibration, colours.shape[1]
        first, error = self.now, None
        if calibrating or first is None:
            draw = seeding.Rand(0)
            for _ in range(self.seen * params.k * d):
                draw()
            first = seeding.random_colours(params.k, d, draw)
        model = fit_arrays(colours, weights, first, params)
        if calibrating:
            label = labels_array(colours, model.label_prototypes, params.metric, params.minkowski_p)
            cut = np.sqrt(((colours - np.array(model.prototypes)[label]) ** 2).sum(1).astype(float)).astype(np.float32).astype(np.int64)
            error = float((cut * cut * weights).sum())
            if error < self.best:
                self.best, self.now = error, model.prototypes
        else:
            self.now = model.prototypes
        self.seen += 1
        return model, error


def _tracked_schema(names: list[str]) -> str:
    return "video_id long, frame_id long, cid int, iterations int, " + ", ".join(f"{c} int" for c in names)


def _tracked(hist: DataFrame, names: list[str], params: KMeansParams, calibration: int) -> DataFrame:
    """(video_id, frame_id, phase, cid, iterations, error, c0.., old_c0..) from the histograms (video_id, frame_id, c0.., n) of videos."""
    if params.metric not in ARRAYS:
        raise ValueError(f"metric {params.metric!r} has no numpy form")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), *[pa.int32()] * (2 * len(names))]
    labels = ["video_id", "frame_id", "phase", "cid", "iterations", "error", *names, *[f"old_{c}" for c in names]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells, state = None, [], FrameState()

        def close() -> list[tuple]:
            block = np.concatenate(cells)
            phase = "calibration" if state.seen < calibration else "tracking"
            model, error = state.advance(block[:, :-1], block[:, -1], params, calibration)
            return [(*key, phase, cid, model.iterations, error, *q, *old) for cid, (q, old) in enumerate(zip(model.prototypes, model.label_prototypes))]

        for batch in batches:
            ids = np.column_stack([batch.column(c).to_numpy() for c in ("video_id", "frame_id")])
            block = np.column_stack([batch.column(c).to_numpy() for c in (*names, "n")]).astype(np.int64)
            edges = [0, *(np.flatnonzero((np.diff(ids, axis=0) != 0).any(1)) + 1).tolist(), len(ids)]
            out = []
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                now = tuple(ids[a].tolist())
                if key is not None and key != now:
                    out += close()
                    cells = []
                    if key[0] != now[0]:
                        state = FrameState()
                key = now
                cells.append(block[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], labels)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*close()), kinds)], labels)

    rows = hist.select("video_id", "frame_id", *names, "n").repartition("video_id").sortWithinPartitions("video_id", "frame_id")
    schema = "video_id long, frame_id long, phase string, cid int, iterations int, error double, " + ", ".join(f"{c} int" for c in labels[6:])
    return rows.mapInArrow(run, schema)


def track_many(points: DataFrame, params: KMeansParams, calibration: int = CALIBRATION_FRAMES) -> DataFrame:
    """(video_id, frame_id, cid, iterations, c0..) of many videos at once: a video is sequential, videos are not.

    Colours are counted per video and frame first. A task streams its videos' histograms frame by frame, sorted by the
    shuffle, and holds one frame at a time.
    """
    names = channel_names(points)
    found = _tracked(histogram(points, ["video_id", "frame_id"]), names, params, calibration)
    return found.select("video_id", "frame_id", "cid", "iterations", *names)


def track_many_stream(points: DataFrame, params: KMeansParams, calibration: int = CALIBRATION_FRAMES) -> DataFrame:
    """The same over a stream, as a streaming DataFrame: a video's state lives in the state store and survives restarts.

    A micro-batch must hold whole frames, and frames of a video must come in order; inside a batch they are sorted.
    """
    names = channel_names(points)

    def step(key: tuple, parts: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = FrameState()
        if store.exists:
            seen, best, flat = store.get
            state = FrameState(seen, best, np.array(flat).reshape(params.k, len(names)).tolist() if len(flat) else None)
        rows = []
        for frame, own in pd.concat(parts).groupby("frame_id", sort=True):
            colours, weights = np.unique(own[names].to_numpy(np.int64), axis=0, return_counts=True)
            model, _ = state.advance(colours, weights, params, calibration)
            rows += [(key[0], frame, cid, model.iterations, *q) for cid, q in enumerate(model.prototypes)]
        store.update((state.seen, state.best, [x for q in state.now or [] for x in q]))
        yield pd.DataFrame(rows, columns=["video_id", "frame_id", "cid", "iterations", *names])

    return points.groupBy("video_id").applyInPandasWithState(step, _tracked_schema(names), "seen int, best double, prototypes array<int>", "append", "NoTimeout")


def per_frame_stream(frames: DataFrame, params: KMeansParams, seeds: Callable[[int, int], Prototypes], sink: Callable[[DataFrame], None]):
    """The writer of a stream whose frames are clustered each by itself; a micro-batch must hold whole frames."""
    return frames.writeStream.foreachBatch(lambda points, _: sink(per_frame(points, params, seeds)))
