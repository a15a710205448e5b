import zlib

import numpy as np
from pyspark.sql import functions as F

from chromalyne.llm import sharding
from helpers import awkward, none, prose


def one(key, shards):
    """The published loop, key by key."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_loop():
    keys = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [one(int(k), n) for k in keys]


def test_few_keys_move_and_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    old, new = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(new[new != old]) == {16} and abs((new != old).mean() - 1 / 17) < 0.01
    assert np.bincount(old).min() > 1000


def test_every_row_gets_a_slot(spark):
    table = awkward(spark)
    rows = sharding.shard_documents(table, shards=4).collect()
    assert len(rows) == table.count()
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    texts = {r["doc_id"]: r["text"] for r in table.where("doc_id is not null").collect()}
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 4) and r["law"] == "key"
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    again = sharding.shard_documents(table.repartition(5), shards=4)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["slot"])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_sub_buckets_give_gapless_ranks(spark):
    from chromalyne.llm.common import gapless_rank

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 2).alias("x"))
    rows = gapless_rank(df, ["g"], ["x"], "rank", rows_a_task=50).collect()
    for g in range(3):
        own = sorted(r["rank"] for r in rows if r["g"] == g)
        assert own == list(range(len(own)))


def test_empty_table(spark):
    assert sharding.shard_documents(none(spark)).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, prose(i, 3)) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "x"), shards=4, files_a_shard=2)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.select("doc_id", "text").exceptAll(df).count() == 0
    placed = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, shards=4).collect()}
    assert all(placed[r["doc_id"]] == r["shard"] for r in back.collect())
