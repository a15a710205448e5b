"""Points: rows (frame_id, idx, c0 .. c{d-1}) of whole-number channels, and their weighted histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalyne.functions.distances import UNROLLED, Channels


def channel_names(df: DataFrame) -> list[str]:
    """c0, c1, ... as far as the table has them."""
    out = []
    while f"c{len(out)}" in df.columns:
        out.append(f"c{len(out)}")
    if not out:
        raise ValueError("points need channel columns c0, c1, ...")
    return out


def is_array(df: DataFrame) -> bool:
    """Whether the channels are one array column `c`, as for many channels, rather than columns."""
    return "c" in df.columns


def channels(df: DataFrame) -> Channels:
    return F.col("c") if is_array(df) else [F.col(c) for c in channel_names(df)]


def dimensions(df: DataFrame) -> int:
    if is_array(df):
        first = df.select(F.size("c").alias("n")).first()
        return first["n"] if first else 0
    return len(channel_names(df))


def literal(values: Sequence[int], array: bool) -> Channels:
    """Channels of a constant."""
    return F.array(*[F.lit(int(v)) for v in values]) if array else [F.lit(int(v)) for v in values]


def unrolled(df: DataFrame, d: int) -> DataFrame:
    """Array channels as columns."""
    if d > UNROLLED:
        raise ValueError(f"at most {UNROLLED} channels become columns")
    return df.select(*[c for c in df.columns if c != "c"], *[F.get("c", F.lit(i)).alias(f"c{i}") for i in range(d)])


def histogram(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., c0.., n, first_idx): every distinct colour once.

    Only colours enter distances and sums of whole numbers are exact, so clustering the histogram with weights n gives
    the very same centroids as clustering the points. Colours of three bytes are at most 16.8 million rows at any
    input size, and the aggregate combines before its shuffle.
    """
    keys: list[str | Column] = [*by, "c"] if is_array(points) else [*by, *channel_names(points)]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
