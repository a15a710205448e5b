"""Painting: every point in the colour of its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.operators.lloyd import KMeansModel, nearest
from chromalyne.operators.points import channel_names, channels, is_array


def paint(points: DataFrame, model: KMeansModel, prefix: str = "r") -> DataFrame:
    """points with cid and painted channels r0.. (or an array r).

    Labels come from the prototypes before the last update, colours from those after it: no point is assigned again.
    A projection over literals, so it runs in the scan's stage.
    """
    p = model.params
    out = points.withColumn("cid", nearest(channels(points), model.label_prototypes, p.metric, p.minkowski_p))
    d = len(model.prototypes[0])
    if is_array(points):
        table = F.array(*[F.array(*[F.lit(int(v)) for v in q]) for q in model.prototypes])
        return out.withColumn(prefix, F.element_at(table, F.col("cid") + 1))
    picks = {f"{prefix}{i}": F.element_at(F.array(*[F.lit(int(q[i])) for q in model.prototypes]), F.col("cid") + 1) for i in range(d)}
    return out.withColumns(picks)


def as_image(painted: DataFrame, prefix: str = "r") -> DataFrame:
    """Only idx, frame_id where there is one, and the painted channels under their plain names."""
    keys = [c for c in ("frame_id", "idx") if c in painted.columns]
    if is_array(painted):
        return painted.select(*keys, F.col(prefix).alias("c"))
    return painted.select(*keys, *[F.col(f"{prefix}{i}").alias(c) for i, c in enumerate(channel_names(painted))])
