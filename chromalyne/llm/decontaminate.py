"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import written

#: The masks. A 1 is a word that the seed hashes, a 0 a word it ignores.
MASKS = ("11011011", "1110100101")
MIN_WORDS = 13
#: Of every IDENTITY_OF words of a stretch at least IDENTITY_EQUAL are equal.
IDENTITY_EQUAL, IDENTITY_OF = 4, 5
IDENTITY = IDENTITY_EQUAL / IDENTITY_OF
#: What a mismatch costs the best-scoring segment that tests compare with; `overlaps` goes by IDENTITY alone.
PENALTY = 3
#: Bytes of benchmark seeds that are broadcast at most; a seed row has SEED_BYTES and its item's key.
BROADCAST_BYTES, SEED_BYTES = 32 << 20, 40


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; null has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed(hashes: Column, place: Column, mask: str) -> Column:
    """The seed of a mask at a place, null where the mask doesn't fit."""
    taken = [i for i, bit in enumerate(mask) if bit == "1"]
    return F.when(place + len(mask) <= F.size(hashes), F.xxhash64(F.lit(mask), *[F.get(hashes, place + i) for i in taken]))


def seeded(rows: DataFrame, keep: list[str], masks: list[str], fits: list[Column] | None = None) -> DataFrame:
    """rows with an array column `h` to (keep..., place, seed): a row for each place and mask, those of `fits` alone.

    Places are exploded first, so that seeds are computed in generated code rather than in a lambda.
    """
    spread = rows.where(F.size("h") > 0).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("place"))
    found = [seed(F.col("h"), F.col("place"), m) for m in masks]
    found = [F.when(f, x) for f, x in zip(fits, found)] if fits else found
    return spread.select(*keep, "place", F.explode(F.array(*found)).alias("seed")).where("seed is not null")


def _longest_stretch(at: Column) -> Column:
    """Of the ascending places of equal words the stretch from one to another with most of them, IDENTITY or more of its words equal: matches, first place and length.

    A stretch from the a-th to the b-th equal word is similar enough if u[b] >= u[a] - (IDENTITY_OF - IDENTITY_EQUAL),
    where u[i] = IDENTITY_OF * i - IDENTITY_EQUAL * at[i]. In the order of u, the best partner of an end is the smallest a so far.
    """
    u = lambda x, i: IDENTITY_OF * i - IDENTITY_EQUAL * x
    firsts = F.transform(at, lambda x, i: F.struct((u(x, i) - (IDENTITY_OF - IDENTITY_EQUAL)).alias("u"), F.lit(0).alias("end"), i.alias("i")))
    lasts = F.transform(at, lambda x, i: F.struct(u(x, i).alias("u"), F.lit(1).alias("end"), i.alias("i")))
    start = F.expr("named_struct('from', 2147483647, 'matches', 0, 'first', 0)")

    def step(s: Column, e: Column) -> Column:
        matches = e["i"] - s["from"] + 1
        better = (e["end"] == 1) & (matches > s["matches"])
        return F.struct(
            F.when(e["end"] == 0, F.least(s["from"], e["i"])).otherwise(s["from"]).alias("from"),
            F.when(better, matches).otherwise(s["matches"]).alias("matches"),
            F.when(better, s["from"]).otherwise(s["first"]).alias("first"),
        )

    def places(s: Column) -> Column:
        first = F.get(at, s["first"])
        return F.struct(s["matches"].alias("matches"), first.alias("first"), (F.get(at, s["first"] + s["matches"] - 1) - first + 1).alias("length"))

    return F.aggregate(F.sort_array(F.concat(firsts, lasts)), start, step, places)


def _verified(rows: DataFrame) -> DataFrame:
    """rows (doc_id, h, item_id, items_h, shift): the overlaps along the shift that hold enough equal words."""
    from_doc, from_item = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("h") - from_doc, F.size("items_h") - from_item)
    equal = F.filter(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda i: F.get("h", from_doc + i) == F.get("items_h", from_item + i))
    needed = F.least(F.lit(MIN_WORDS), F.ceil(F.size("items_h") * F.lit(IDENTITY)))
    found = rows.select("doc_id", "item_id", "shift", needed.alias("needed"), equal.alias("at")).where(F.size("at") >= F.col("needed"))
    return found.withColumn("s", _longest_stretch(F.col("at"))).where(F.col("s.matches") >= F.col("needed")).select(
        "doc_id", "item_id",
        F.struct(
            F.col("s.matches").cast("long").alias("matches"), F.col("s.length").cast("long").alias("length"),
            (-(from_doc + F.col("s.first"))).cast("long").alias("minus_doc"), (-(from_item + F.col("s.first"))).cast("long").alias("minus_item"),
        ).alias("overlap"),
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that share a passage with a benchmark item, up to substituted words.

    Words are lower-cased runs of letters and digits, compared by 64-bit hashes. Seeds under MASKS of every place of the
    documents and the items are joined; along each hit's shift, once, the words of both are compared, and the longest
    stretch of which IDENTITY or more are equal counts if it has at least MIN_WORDS equal words (of items with fewer than
    17 words, IDENTITY of the item's words). An item shorter than a mask has one seed of all its words, so it is found
    where they stand unchanged. Returns a row per document and item that overlap: doc_id, item_id, matches, length (of
    the stretch, from its first to its last equal word), doc_start and item_start (words).

    Seeds of the items (without their words) are broadcast only where they are counted to be at most BROADCAST_BYTES;
    beyond that, seeds of both sides are shuffled. Hits are made distinct by (document, item, shift) and written; words of
    both sides are joined to them, so only documents with a hit are split again. Long texts are seeded whole. Null and
    empty texts have no seeds. Rows that repeat a key give one row per item, their best overlap: of most equal words,
    then the longest, the earliest in the document, the earliest in the item. Rows with a null key or null item are
    left out. Other columns are not read, so names can't clash. Empty tables give no rows.
    """
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), word_hashes(F.col(text)).alias("h"))
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), word_hashes(F.col(item_text)).alias("h"))
    shortest = min(map(len, MASKS))
    sizes = items.select(F.size("h").alias("n"), (SEED_BYTES + F.octet_length(F.col("item_id").cast("string"))).alias("b")).groupBy(F.least("n", F.lit(shortest)).alias("n")).agg(F.sum(F.col("n") * F.col("b")).alias("b")).collect()
    short = sorted(r["n"] for r in sizes if 0 < r["n"] < shortest)
    masks = [*MASKS, *["1" * n for n in short]]
    fits = [F.lit(True)] * len(MASKS) + [F.size("h") == n for n in short]
    bench = seeded(items, ["item_id", "h"], masks, fits) if short else seeded(items, ["item_id", "h"], masks)
    bench = bench.select("seed", "item_id", F.col("place").alias("item_place"))
    # seeds of different masks differ, as a mask is part of what is hashed
    if len(MASKS) * sum(r["b"] for r in sizes) <= BROADCAST_BYTES:
        bench = F.broadcast(bench)
    found = seeded(own, ["doc_id"], masks).join(bench, "seed").select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift"))
    hits = written(found.distinct(), "seed-hits")
    again = hits.join(own, "doc_id").join(items.withColumnRenamed("h", "items_h"), "item_id").where(F.col("shift") < F.size("h"))
    best = _verified(again).groupBy("doc_id", "item_id").agg(F.max("overlap").alias("o"))
    return best.select("doc_id", "item_id", "o.matches", "o.length", (-F.col("o.minus_doc")).alias("doc_start"), (-F.col("o.minus_item")).alias("item_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that overlap a benchmark item (see `overlaps`); all columns and clean rows stay, null keys too,
    and of rows that repeat a key all go or none."""
    leaked = overlaps(docs, benchmark, key, text).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, docs[key] == F.col("__leaked"), "left_anti")
