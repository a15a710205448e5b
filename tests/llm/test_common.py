import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chromalyne.llm import common
from chromalyne.llm.common import Tokens, hashed_words, split_words
from helpers import awkward, prose


def test_tokens_are_the_words():
    texts = ["  a b\x0bc\x1cd\n", None, "", "É A\u00a0z\t\r\n É", prose(1, 50)]
    words = Tokens(pa.array(texts, pa.string()), lower=True)
    found = np.array(words.words.to_pylist(), object)[words.ids]
    for i, t in enumerate(texts):
        assert [w.encode() for w in found[words.first[i] : words.first[i + 1]]] == split_words(t, True)
    own = split_words(" ".join(t or "" for t in texts), True)
    assert words.hashes().tolist() == hashed_words(np.array(own, object)).tolist()
    sliced = Tokens(pa.array(texts, pa.string()).slice(3, 2))
    assert sliced.counts.tolist() == [3, 50]


def test_the_sample_is_the_first_by_hash_and_bounded(spark):
    """Of a class of a million rows, a small one and one key repeated often, a window ranks little more than is taken."""
    big = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("big").alias("by"))
    few = spark.range(5).select((F.col("id") + 2_000_000).alias("doc_id"), F.concat(F.lit("s"), "id").alias("text"), F.lit("few").alias("by"))
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("u"), "id").alias("text"), F.lit("same").alias("by"))
    rows = big.unionByName(few).unionByName(same)
    found = common.training_rows(rows, "by", 50, 100)
    got = {}
    for r in found.collect():
        got.setdefault(r["by"], []).append((r["place"], r["key"], r["text"]))
    want = [r["doc_id"] for r in big.orderBy(F.xxhash64("doc_id")).limit(50).collect()]
    assert [k for _, k, _ in sorted(got["big"])] == want and len(got["few"]) == 5 and [x[1:] for x in got["same"]] == [(7, "u0")]
    assert common.training_rows(rows, "by", 50, 100, most_classes=1).select("by").distinct().count() == 1
    assert common.training_rows(rows.where("false"), "by", 50, 100) is None
    limit = int(-(1 << 63) + (50 + 6 * 50**0.5 + 16) / 1_000_000 * 2.0**64)
    assert 50 <= big.where(F.xxhash64("doc_id") <= limit).count() < 200  # what the window of the largest class sees


def test_settings_are_as_before(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(x, None) for x in names]
    common.written(common.map_arrow(awkward(spark).select("doc_id"), lambda b: b, "doc_id long"), "x").count()
    assert [spark.conf.get(x, None) for x in names] == before
