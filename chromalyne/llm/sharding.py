"""Sharding by jump consistent hashing.

A stable key decides its shard from the number of shards alone: no ring table is kept, and when a shard is appended
only the keys that land in the new one move (about 1/(n + 1) of them).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import gapless_rank, written

#: Fixed values of the published jump consistent hash.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 to shards - 1 of 64-bit keys, whole arrays at a time; each round moves only the keys that jump again."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = np.asarray(keys).astype(np.uint64)
    shard, target = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = target[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        target[live] = np.floor((shard[live] + 1) * step).astype(np.int64)
        live = live[target[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a bigint key as an int column."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(key)


def stable_key(*columns: str) -> Column:
    """A 64-bit hash of the key columns; null has one of its own, so null keys share a shard."""
    return F.xxhash64(*columns)


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Place every row of docs into one of `shards` shards by its key alone.

    Returns one row per input row: the key, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, law
    (always "key"), shard, slot (0-based gapless place in its shard) and grown_shard (with one shard more; it is
    `shard` or the new shard). Null keys share one shard. Repeated rows each get a slot; of rows alike in key, size
    and checksum any may have the smaller one. Long texts are measured whole. An empty table gives an empty result. Other columns of docs are neither read nor returned, so their names can't clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    small = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        stable_key(key).alias("k"),
    )
    placed = small.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), shard_of(F.col("k"), shards).alias("shard"), shard_of(F.col("k"), shards + 1).alias("grown_shard"))
    ranked = gapless_rank(written(placed, "shards"), ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 16, files_a_shard: int = 8) -> None:
    """Write docs as Parquet under path/shard=N. Each shard is spread over files_a_shard tasks, so a shard never meets in one."""
    placed = docs.withColumn("shard", shard_of(stable_key(key), shards))
    salt = F.pmod(F.xxhash64(F.struct(*[F.col(c) for c in docs.columns])), F.lit(files_a_shard))
    placed.repartition(shards * files_a_shard, "shard", salt).write.mode("errorifexists").partitionBy("shard").parquet(path)
