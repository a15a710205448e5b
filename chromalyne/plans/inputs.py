"""Points derived from the driver tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalyne.sources.storage import scratch

#: Bits of a row's place inside its partition in Spark's increasing ids.
PLACE_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem_channels(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("l_quantity").cast("int").alias("c0"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("c1"),
        F.round(F.col("l_tax") * 1000).cast("int").alias("c2"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
    )


def px3_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-channel points from the line items, without places: three columns are read and nothing is sorted."""
    return _lineitem_channels(table(spark, sf_dir, "lineitem")).select("c0", "c1", "c2", F.lit(0).cast("bigint").alias("idx"))


def px3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with idx, the rank under the keys. A global rank needs a total order: rows are range-partitioned, sorted
    inside partitions and written with their place there, so they are shuffled once, no task sees all rows and a lost
    executor can't change which row is in which partition; the counts of earlier partitions are added on reading."""
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select(*order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "ranged")
    ranged = _lineitem_channels(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    ranged.select("c0", "c1", "c2", F.monotonically_increasing_id().alias("place")).write.parquet(path)  # the partition above PLACE_BITS
    ranged = spark.read.parquet(path).withColumn("part", F.shiftright("place", PLACE_BITS))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per partition
    before = accumulate((r["n"] for r in counts), initial=0)
    firsts = spark.createDataFrame([(r["part"], n) for r, n in zip(counts, before)], "part bigint, first bigint")
    return ranged.join(F.broadcast(firsts), "part").select((F.col("place").bitwiseAND((1 << PLACE_BITS) - 1) + F.col("first")).alias("idx"), "c0", "c1", "c2")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 frames from the events of 30 days. The event's number is the point's place: places only order a frame's points."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("bigint").alias("frame_id"), F.col("event_id").alias("idx"),
        F.least(F.lit(255), F.floor(F.col("value") / 2)).cast("int").alias("c0"),
        (F.hour("ts") * 11).cast("int").alias("c1"), (F.minute("ts") * 4).cast("int").alias("c2"),
    )


def vec64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-channel points from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("c"))


PX3 = """px as (select cast(l_quantity as int) c0, cast(round(l_discount*1000) as int) c1, cast(round(l_tax*1000) as int) c2,
  row_number() over (order by l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_discount,l_tax) - 1 idx from lineitem)"""
HIST = "h as (select c0, c1, c2, count(*) n, min(idx) first_idx from px group by all)"
FRAMES = """fr as (select cast(datediff('day', date '2024-01-01', cast(ts as date)) as bigint) frame_id, event_id,
  cast(least(255, floor(value/2)) as int) c0, cast(extract(hour from ts)*11 as int) c1, cast(extract(minute from ts)*4 as int) c2 from events),
fh as (select frame_id, c0, c1, c2, count(*) n, min(event_id) first_idx from fr group by all)"""
VEC64 = "v as (select vec_id idx, [cast(floor((cast(x as double)+1)*127.5) as int) for x in embedding] c from embeddings)"
