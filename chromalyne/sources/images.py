"""Images, frame directories and raw video as points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from chromalyne.sources import png

IMAGE_SCHEMA = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
PIXELS_A_BATCH = 1 << 18


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A row per image: image (Spark's image struct, BGR) and frame_id, the last number in the file's name (0 without one)."""
    return with_frame_id(spark.read.format("image").option("dropInvalid", True).load(path))


def with_frame_id(images: DataFrame) -> DataFrame:
    number = F.regexp_extract("image.origin", r"(\d+)[^/\d]*$", 1)
    return images.select("image", F.when(number == "", 0).otherwise(number.cast("bigint")).alias("frame_id"))


def stream_images(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A stream of the images that appear in a folder."""
    schema = T.StructType([T.StructField("image", T._parse_datatype_string(IMAGE_SCHEMA))])
    return with_frame_id(spark.readStream.format("image").schema(schema).option("maxFilesPerTrigger", files_a_trigger).load(path))


def pixels(images: DataFrame, d: int = 3) -> DataFrame:
    """Points (frame_id, idx, c0..) of images with d channels; idx = y * width + x.

    Pixels leave in batches of PIXELS_A_BATCH, so a large image never becomes one Arrow batch.
    """
    schema = pa.schema([("frame_id", pa.int64()), ("idx", pa.int64()), *[(f"c{i}", pa.int32()) for i in range(d)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, depth, data in zip(batch.column("frame_id").to_pylist(), batch.column("depth").to_pylist(), batch.column("data")):
                if depth != d:
                    raise ValueError(f"an image has {depth} channels, not {d}")
                cells = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, d)
                for a in range(0, len(cells), PIXELS_A_BATCH):
                    part = cells[a : a + PIXELS_A_BATCH]
                    own = [pa.array(np.full(len(part), frame, np.int64)), pa.array(np.arange(a, a + len(part)))]
                    yield pa.RecordBatch.from_arrays(own + [pa.array(part[:, i].astype(np.int32)) for i in range(d)], schema=schema)

    small = images.select("frame_id", F.col("image.nChannels").alias("depth"), F.col("image.data").alias("data"))
    return small.mapInArrow(run, "frame_id long, idx long, " + ", ".join(f"c{i} int" for i in range(d)))


def pixels_expr(images: DataFrame, d: int = 3) -> DataFrame:
    """The same with Column functions only; slower, for small images."""
    at = F.col("idx") * d
    value = lambda i: F.conv(F.hex(F.substring(F.col("data"), (at + i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    places = images.select("frame_id", F.col("image.data").alias("data"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("image.width") * F.col("image.height") - 1).cast("bigint"))).alias("idx"))
    return places.select("frame_id", "idx", *[value(i).alias(f"c{i}") for i in range(d)])


def shape_of(images: DataFrame) -> tuple[int, int, int]:
    """Height, width and channels, the same for all frames of a video, or an error."""
    found = images.select("image.height", "image.width", "image.nChannels").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("no images" if not found else "the frames differ in shape")
    return tuple(found[0])


def frame_count(points: DataFrame) -> DataFrame:
    return points.agg(F.count_distinct("frame_id").alias("frames"))


def images_from_pixels(points: DataFrame, height: int | None, width: int) -> DataFrame:
    """(frame_id, height, width, depth, data) rebuilt from points; a frame's pixels meet in one task, as its file must.
    Without a height, each frame is as high as its pixels need."""
    names = [c for c in points.columns if c.startswith("c") and c[1:].isdigit()]

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        rows = len(order) // width if height is None else height
        if len(order) != rows * width:
            raise ValueError(f"a frame has {len(order)} pixels, not {rows * width}")
        cells = np.column_stack([table.column(c).to_numpy()[order] for c in names]).astype(np.uint8)
        return pa.table({"frame_id": table.column("frame_id").slice(0, 1), "height": pa.array([rows], pa.int32()), "width": pa.array([width], pa.int32()), "depth": pa.array([len(names)], pa.int32()), "data": pa.array([cells.tobytes()], pa.binary())})

    return points.groupBy("frame_id").applyInArrow(build, "frame_id long, height int, width int, depth int, data binary")


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _PngWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.prefix = options["path"], options.get("prefix", "frame_")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        for row in rows:
            cells = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["depth"])
            with files.open_output_stream(f"{root}/{self.prefix}{row['frame_id']:08d}.png") as out:
                out.write(png.encode(cells))
        return WriterCommitMessage()


class PngFrames(DataSource):
    """Sink `png_frames`: rows (frame_id, height, width, depth, data) as path/<prefix><frame_id>.png. A retried task writes the same files again."""

    @classmethod
    def name(cls) -> str:
        return "png_frames"

    def schema(self) -> str:
        return "frame_id long, height int, width int, depth int, data binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _PngWriter(self.options)


def write_raw(points: DataFrame, height: int, width: int, path: str) -> None:
    """A video of frames 0, 1, ... as one file of raw frames; they stream through the driver one by one, as a file has one writer."""
    files, root = _filesystem(path)
    files.create_dir(root.rpartition("/")[0], recursive=True)
    with files.open_output_stream(root) as out:
        for i, frame in enumerate(images_from_pixels(points, height, width).orderBy("frame_id").toLocalIterator()):
            if frame["frame_id"] != i:
                raise ValueError(f"frame {i} is missing")
            out.write(bytes(frame["data"]))


class _FrameRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.height, self.width, self.depth = int(options["height"]), int(options["width"]), int(options.get("depth", 3))
        self.most = int(options.get("framespertask", 16))

    @property
    def size(self) -> int:
        return self.height * self.width * self.depth

    def partitions(self) -> list[InputPartition]:
        files, root = _filesystem(self.path)
        frames = files.get_file_info(root).size // self.size
        return [_FrameRange(a, min(a + self.most, frames)) for a in range(0, frames, self.most)] or [_FrameRange(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, root = _filesystem(self.path)
        first, last = partition.value
        with files.open_input_file(root) as f:
            f.seek(first * self.size)
            for frame in range(first, last):
                yield frame, self.height, self.width, self.depth, f.read(self.size)


class RawVideo(DataSource):
    """Source `raw_video`: a file of uncompressed frames (options height, width, depth) as rows (frame_id, height, width, depth, data), a range of frames per task."""

    @classmethod
    def name(cls) -> str:
        return "raw_video"

    def schema(self) -> str:
        return "frame_id long, height int, width int, depth int, data binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RawReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PngFrames)
    spark.dataSource.register(RawVideo)


def as_images(frames: DataFrame) -> DataFrame:
    """Rows of raw_video in the shape of the image source."""
    image = F.struct(F.lit("").alias("origin"), "height", "width", F.col("depth").alias("nChannels"), F.when(F.col("depth") == 3, 16).otherwise(0).alias("mode"), "data")
    return frames.select(image.alias("image"), "frame_id")


def write_png(points: DataFrame, height: int | None, width: int, path: str, prefix: str = "frame_") -> None:
    register(points.sparkSession)
    images_from_pixels(points, height, width).write.format("png_frames").mode("append").option("prefix", prefix).save(path)
