"""MinHash near-deduplication with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import Temporary, Tokens, hashed_words, map_arrow, mix, release_memory, shingle_hashes, slices, split_words, written
from chromalyne.llm.components import components

SLICE_BYTES = 2 << 20
#: Buckets that are called hot at most: those with more than a HOT-th of all rows. They are broadcast, the rest is shuffled.
HOT = 50_000
LEAST_HOT = 256
#: How often a large mixed bucket is dealt again.
LEVELS = 3


@dataclass(frozen=True)
class NearParams:
    """words in a shingle; the least similarity as a ratio of whole numbers; hashes in a band; the chance that a pair at
    the threshold shares no band, and the posterior below which each look prunes (over the eight looks of `compared` hashes, 8e-5
    of pairs at the threshold go; about 9e-5 are missed in all); hashes that candidates are compared on; further hashes in
    a band inside a large mixed bucket, and from how many members on it is dealt again so (each time with a chance of
    `miss` for a pair that shares no other bucket); members that are compared as one block."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    rows: int = 8
    miss: float = 1e-5
    compared: int = 128
    inner_rows: int = 4
    large: int = 2048
    block: int = 128

    @property
    def threshold(self) -> float:
        return self.numerator / self.denominator

    def bands_of(self, rows: int) -> int:
        return math.ceil(math.log(self.miss) / math.log(1.0 - self.threshold**rows))

    @property
    def bands(self) -> int:
        return self.bands_of(self.rows)

    @property
    def hashes(self) -> int:
        return max(self.bands * self.rows, self.compared, self.bands_of(self.inner_rows) * self.inner_rows)


@functools.lru_cache(8)
def least_matches(params: NearParams) -> dict[int, int]:
    """For each number n of compared hashes (a multiple of a batch): the fewest matches m for which the posterior chance
    that the similarity reaches the threshold, Beta(m + 1, n - m + 1) from a flat prior, is at least `miss`."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= params.threshold
    out = {}
    for n in sorted({*range(16, params.compared, 16), params.compared}):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[above].sum() / weight.sum() >= params.miss:
                break
        out[n] = m
    return out


def shingles(words: Tokens, n: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted; of a row with fewer words, one hash of them all; of an empty row, none."""
    h = words.hashes()
    grams = shingle_hashes(h, n)
    out = []
    for first, count in zip(words.first.tolist(), words.counts.tolist()):
        if count >= n:
            out.append(np.unique(grams[first : first + count - n + 1]))
        elif count:
            out.append(shingle_hashes(h[first : first + count], count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles_of(words: list[bytes], n: int) -> np.ndarray:
    """The same of one text's words."""
    return np.unique(shingle_hashes(hashed_words(np.array(words, object)), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def word_shingles(words: list[bytes], n: int) -> set[tuple]:
    """The shingles themselves."""
    return set(zip(*(words[i:] for i in range(min(n, len(words)))))) if words else set()


@functools.lru_cache(4)
def _permutations(n: int) -> np.ndarray:
    """Three 32-bit numbers for each of n permutations; the last two are odd."""
    seeds = mix(np.arange(1, 3 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32).reshape(n, 3)
    seeds[:, 1:] |= np.uint32(1)
    return seeds


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n min-hashes (16 mixed bits of 32) of each non-empty set, in blocks that stay in the processor's cache."""
    out = np.empty((len(sets), n), np.uint16)
    numbers = _permutations(n)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 1 << 15):
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end]).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        x, y = np.empty_like(flat), np.empty_like(flat)
        for k in range(n):
            twist, one, two = numbers[k]
            np.bitwise_xor(flat, twist, out=x)
            np.multiply(x, one, out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, two, out=x)
            out[at:end, k] = (np.minimum.reduceat(x, starts) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        at = end
    return out


def _sketch(params: NearParams):
    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text", SLICE_BYTES):
            sets = shingles(Tokens(part.column("text"), lower=True), params.words)
            found = signatures([s for s in sets if len(s)], params.hashes)
            blobs = iter(found.astype("<u2"))
            sig = [next(blobs).tobytes() if len(s) else None for s in sets]
            digest = [hashlib.sha256(b" ".join(split_words(t, True))).digest() if len(s) else None for s, t in zip(sets, part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def _hashes_of(column: pa.Array) -> np.ndarray:
    """Signatures of a column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _keys(sig: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's bands: sig is rows x bands x hashes, seed rows x bands."""
    key = seed
    with np.errstate(over="ignore"):
        for r in range(sig.shape[2]):
            key = mix((key ^ sig[:, :, r]) + np.uint64(0x9E3779B97F4A7C15))
    return key


def _band_keys(params: NearParams):
    def run(batch: pa.RecordBatch):
        sig = _hashes_of(batch.column("sig"))[:, : params.bands * params.rows].astype(np.uint64).reshape(-1, params.bands, params.rows)
        key = _keys(sig, np.broadcast_to(mix(np.arange(1, params.bands + 1, dtype=np.uint64)), sig.shape[:2]))
        reps = np.repeat(batch.column("rep").to_numpy(), params.bands)
        return pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(reps)], ["bucket", "rep"])

    return run


def _inner_keys(params: NearParams, level: int):
    """Bands of further hashes inside a bucket; which hashes they take is drawn by the bucket, alike for all its members."""

    def run(batch: pa.RecordBatch):
        sig, buckets = _hashes_of(batch.column("sig")), batch.column("bucket").to_numpy().view(np.uint64)
        bands = params.bands_of(params.inner_rows)
        out = np.empty((len(sig), bands), np.uint64)
        for bucket in np.unique(buckets):
            own = np.flatnonzero(buckets == bucket)
            drawn = np.random.default_rng([int(bucket), level]).permutation(params.hashes)[: bands * params.inner_rows].reshape(bands, params.inner_rows)
            seed = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ bucket)
            out[own] = _keys(sig[own][:, drawn].astype(np.uint64), np.broadcast_to(seed, (len(own), bands)))
        reps = np.repeat(batch.column("rep").to_numpy(), bands)
        return pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(reps)], ["bucket", "rep"])

    return run


def surviving(a: np.ndarray, b: np.ndarray, params: NearParams) -> np.ndarray:
    """Which pairs of signature rows are not pruned: hashes are compared a batch at a time, and a pair goes as soon as its posterior is too low."""
    live, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(params).items():
        matches[live] += (a[live, done:n] == b[live, done:n]).sum(1)
        live, done = live[matches[live] >= least], n
    return live


def _prune(params: NearParams):
    def run(batch: pa.RecordBatch):
        live = pa.array(surviving(_hashes_of(batch.column("sig_a")), _hashes_of(batch.column("sig_b")), params))
        return pa.RecordBatch.from_arrays([batch.column("a").take(live), batch.column("b").take(live)], ["a", "b"])

    return run


CONFIRMED = "a long, b long, linked boolean, size_a long, minus binary, plus binary"


def _confirm(params: NearParams, differences: bool):
    """Pairs on full sets: linked, and with `differences` also the hashes that b's set lacks and has beyond a's.

    Sets of hashes are counted first; a pair that they link is linked if the sets of the words themselves are. Rows come
    sorted by (a, salt, kind): the text of `a` first, then those it is held against; one text's sets are kept at a time.
    """

    def exactly(x: set[tuple], y: set[tuple]) -> bool:
        common = len(x & y)
        return params.denominator * common >= params.numerator * (len(x) + len(y) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, own_words = None, np.zeros(0, np.uint64), set()
        for batch in batches:
            out = []
            for a, kind, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "kind", "b", "text"))):
                words = split_words(text, True)
                s = shingles_of(words, params.words)
                if kind == 0:
                    head, own, own_words = a, s, word_shingles(words, params.words)
                    continue
                if a != head:
                    raise ValueError("a pair came without its first text")
                at = np.searchsorted(own, s)
                at[at == len(own)] = 0
                shared = own[at] == s
                common = int(shared.sum())
                linked = params.denominator * common >= params.numerator * (len(s) + len(own) - common) and exactly(own_words, word_shingles(words, params.words))
                minus = plus = None
                if differences:
                    lacks = np.ones(len(own), bool)
                    lacks[at[shared]] = False
                    minus, plus = own[lacks].tobytes(), s[~shared].tobytes()
                out.append((head, b, linked, len(own), minus, plus))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["a", "b", "linked", "size_a", "minus", "plus"])
        release_memory()

    return run


def _far_blocks(params: NearParams):
    """Blocks of a bucket's far members against blocks of all: the pairs that their signatures don't rule out."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def part(cell: pa.StructArray):
            return cell.field("rep").to_numpy(), _hashes_of(cell.field("sig"))

        for i in range(batch.num_rows):
            (x, sx), (y, sy) = (part(batch.column(c)[i].values) for c in ("far", "all"))
            p, q = np.nonzero(x[:, None] != y[None, :])
            live = surviving(sx[p], sy[q], params)
            a, b = np.minimum(x[p[live]], y[q[live]]), np.maximum(x[p[live]], y[q[live]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _star_blocks(params: NearParams, every: bool = False):
    """Blocks of a pivot's outsiders against blocks of all its members, exactly: sets are the pivot's less `minus` plus
    `plus`, so the common part of two is known from their small differences. One link for each two components, or `every` one."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def part(cell: pa.StructArray):
            lists = [[np.frombuffer(v.as_buffer(), np.uint64) for v in cell.field(c)] for c in ("minus", "plus")]
            return cell.field("rep").to_numpy(), cell.field("component").to_numpy(), lists

        for i in range(batch.num_rows):
            size = batch.column("size_a")[i].as_py()
            sides = [part(batch.column(c)[i].values) for c in ("out", "all")]
            flat = [np.concatenate([np.concatenate(x) for x in zip(*lists)]) for _, _, lists in sides]
            kinds, ids = np.unique(np.concatenate(flat), return_inverse=True)
            matrices, counts = [], []
            at = 0
            for reps, _, (minus, plus) in sides:
                n = [len(m) + len(p) for m, p in zip(minus, plus)]
                matrix = np.zeros((len(reps), max(1, len(kinds))), np.float32)
                matrix[np.repeat(np.arange(len(reps)), n), ids[at : at + sum(n)]] = 1.0
                at += sum(n)
                matrices.append(matrix)
                counts.append((np.array([len(m) for m in minus]), np.array([len(p) for p in plus])))
            (mx, px), (my, py) = counts
            both = (matrices[0] @ matrices[1].T).astype(np.int64)
            common = size - mx[:, None] - my[None, :] + both
            union = (2 * size - mx + px)[:, None] - (my - py)[None, :] - common
            (x, cx, _), (y, cy, _) = sides
            p, q = np.nonzero((params.denominator * common >= params.numerator * union) & (cx[:, None] != cy[None, :]))
            if len(p):
                one = slice(None) if every else np.unique(np.column_stack([cx[p], cy[q]]), axis=0, return_index=True)[1]
                u, v = x[p[one]], y[q[one]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    return run


class _Search:
    """Links between representatives (rep, sig) of the documents' texts.

    1. Every member of a band bucket is paired with the bucket's pivot, the member that has most bucket mates over all
       bands: as many pairs as members. Signatures rule out the far ones; the near ones are confirmed on full sets.
    2. Near members that are in another component than the pivot are compared with all near members of that pivot,
       from their differences to the pivot's set; the links found are confirmed on full sets.
    3. Far members of a bucket are compared with all its members by signatures, survivors on full sets. A bucket of more
       than `large` members that has far ones is dealt to smaller buckets on further hashes first, up to LEVELS times.
    Steps 2 and 3 work on blocks of members inside one call, so rows are blocks and links, never a group's pairs.
    """

    def __init__(self, docs: DataFrame, reps: DataFrame, params: NearParams):
        self.docs, self.reps, self.params = docs, reps, params
        self.short = reps.select("rep", F.substring("sig", 1, 2 * params.compared).alias("sig"))
        self.tmp = Temporary(docs.sparkSession)

    def texts(self, pairs: DataFrame) -> DataFrame:
        """Texts of the documents of pairs; the hint keeps the list of ids, which grows with the input, from being broadcast."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        found = self.docs.select(F.col("doc_id").alias("id"), "text").join(ids.hint("shuffle_hash"), "id", "left_semi")
        return self.tmp.written(found.dropDuplicates(["id"]), "texts")

    def confirmed(self, pairs: DataFrame, texts: DataFrame, differences: bool = False) -> DataFrame:
        counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
        fan = counts.where(F.col("n") > max(LEAST_HOT, pairs.count() // HOT)).select("a", F.ceil(F.col("n") / 64).alias("fan"))  # HOT rows at most
        salted = pairs.join(F.broadcast(fan), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "fan"), F.lit(0)).alias("salt"))
        heads = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "text")
        tails = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", F.lit(1).alias("kind"), "b", "text")
        rows = heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
        return self.tmp.written(rows.mapInArrow(_confirm(self.params, differences), CONFIRMED), "confirmed")

    def with_buckets(self, rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
        """rows joined with a table of buckets that has their members n. As members add up to `total` at most, no more than
        HOT buckets have over a HOT-th of them: those are broadcast, so that the rows of one bucket needn't meet."""
        most = max(LEAST_HOT, total // HOT)
        hot = F.broadcast(table.where(F.col("n") > most))
        rest = rows.join(F.broadcast(table.where(F.col("n") > most).select("bucket")), "bucket", "left_anti")
        return rows.join(hot, "bucket").unionByName(rest.join(table.where(F.col("n") <= most), "bucket"))

    def buckets(self, rows: DataFrame, total: int) -> DataFrame:
        """(bucket, rep, pivot, members) of buckets with at least two members, from rows (bucket, rep)."""
        shared = self.tmp.written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        rows = self.tmp.written(self.with_buckets(rows, shared, total), "mates")
        weights = rows.groupBy("rep").agg(F.sum("n").alias("weight"))
        best = rows.join(weights, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best"), F.max("n").alias("n"))
        best = self.tmp.written(best.select("bucket", (-F.col("best.minus")).alias("pivot"), "n"), "pivots")
        return self.tmp.written(self.with_buckets(rows.select("bucket", "rep"), best, total).withColumnRenamed("n", "members"), "buckets")

    def near(self, buckets: DataFrame) -> DataFrame:
        """(a, b): pivots and members that signatures don't rule out."""
        pairs = buckets.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        a, b = (self.short.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        return self.tmp.written(map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b"), _prune(self.params), "a long, b long"), "near")

    def mixed(self, buckets: DataFrame, near: DataFrame, total: int) -> DataFrame:
        """(bucket, rep, members, near) of the members but the pivot of buckets that have far ones."""
        known = near.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), F.lit(True).alias("near"))
        rows = self.tmp.written(buckets.where("members > 2 and rep != pivot").join(known, ["pivot", "rep"], "left").select("bucket", "rep", "members", "near"), "members")
        found = rows.groupBy("bucket").agg(F.max("members").alias("n"), F.count(F.when(F.col("near").isNull(), 1)).alias("far")).where("far > 0")
        return self.tmp.written(self.with_buckets(rows, self.tmp.written(found.select("bucket", "n"), "mixed"), total).drop("n"), "mixed")

    def far(self, rows: DataFrame) -> DataFrame:
        """(a, b): survivors among the pairs of a far member and any other member of a bucket."""
        signed = rows.join(self.short, "rep").select("bucket", "rep", "members", "near", "sig")
        blocked = self.tmp.written(signed.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / self.params.block))), "far")
        pack = F.collect_list(F.struct("rep", "sig"))
        everyone = blocked.groupBy("bucket", "block").agg(pack.alias("all"))
        outside = blocked.where("near is null").groupBy("bucket", F.col("block").alias("far_block")).agg(pack.alias("far"))
        blocks = outside.join(everyone, "bucket").repartition("bucket", "far_block", "block").select("far", "all")
        return self.tmp.written(map_arrow(blocks, _far_blocks(self.params), "a long, b long").distinct(), "survivors")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Near pairs (pivot, member) and far pairs, of all levels."""
        rows = self.tmp.written(map_arrow(self.reps.select("rep", "sig"), _band_keys(self.params), "bucket long, rep long"), "bands")
        near, far = [], []
        for level in range(LEVELS):
            total = rows.count()
            buckets = self.buckets(rows, total)
            close = self.near(buckets)
            mixed = self.mixed(buckets, close, total)
            large = (F.col("members") > self.params.large) & F.lit(level < LEVELS - 1)
            apart = self.far(mixed.where(~large))
            near, far = [*near, close], [*far, apart]
            again = mixed.where(large)
            if again.isEmpty():
                break
            # the pivot was compared with every member; the others meet in buckets of further hashes
            signed = again.select("bucket", "rep").join(self.reps.select("rep", "sig"), "rep")
            rows = self.tmp.written(map_arrow(signed.repartition("bucket", F.pmod(F.xxhash64("rep"), F.lit(64))), _inner_keys(self.params, level), "bucket long, rep long"), "bands")
        return tuple(x[0] if len(x) == 1 else self.tmp.written(functools.reduce(DataFrame.union, x).distinct(), "candidates") for x in (near, far))

    def across(self, stars: DataFrame, groups: DataFrame, every: bool = False) -> DataFrame:
        """(a, b): links between near members of one pivot whose components differ, as their hashes tell."""
        named = groups.withColumnRenamed("component", "own")
        rows = stars.join(named.withColumnsRenamed({"node": "b", "own": "component"}), "b", "left").join(named.withColumnsRenamed({"node": "a", "own": "pivot_component"}), "a", "left")
        rows = rows.select("a", "size_a", "minus", "plus", F.col("b").alias("rep"), F.coalesce("component", "b").alias("component"), F.coalesce("pivot_component", "a").alias("pivot_component"))
        mixed = rows.groupBy("a").agg(F.count("*").alias("members"), F.count(F.when(F.col("component") != F.col("pivot_component"), 1)).alias("outside")).where("outside > 0 and members > 1")
        rows = self.tmp.written(rows.join(mixed, "a"), "stars")
        blocked = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / self.params.block)))
        pack = F.collect_list(F.struct("rep", "component", "minus", "plus"))
        everyone = blocked.groupBy("a", "block").agg(pack.alias("all"))
        outside = blocked.where("component != pivot_component").groupBy("a", F.col("block").alias("out_block"), "size_a").agg(pack.alias("out"))
        blocks = outside.join(everyone, "a").repartition("a", "out_block", "block").select("size_a", "out", "all")
        return self.tmp.written(map_arrow(blocks, _star_blocks(self.params, every), "a long, b long").distinct(), "across")

    def links(self) -> DataFrame:
        near, far = self.candidates()
        texts = self.texts(near.union(far))
        stars = self.confirmed(near, texts, differences=True)
        found = stars.unionByName(self.confirmed(far, texts)).where("linked").select("a", "b")
        groups = self.tmp.written(components(found.toDF("u", "v")), "groups")
        more = self.confirmed(self.across(stars.drop("linked"), groups), texts)
        if not more.where("not linked").isEmpty():  # hashes linked what words don't: another pair of those components may do
            more = self.confirmed(self.across(stars.drop("linked"), groups, every=True), texts)
        return found.unionByName(more.where("linked").select("a", "b")).toDF("u", "v")


def near_duplicates(docs: DataFrame, params: NearParams = NearParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose word shingle sets reach the similarity threshold.

    Returns a row per input row: doc_id, n_shingles (size of the set), component_id (the smallest doc_id reachable over
    links, itself included) and kept (whether they are equal).

    Texts of equal words are one representative first (by the SHA-256 of their words, a grouped minimum), so any number of
    copies costs one signature. Links between representatives are found as _Search tells; every link is confirmed on the
    sets of the words themselves. A pair at the threshold is missed with a chance of about 9e-5 (see NearParams), more
    similar ones more rarely.

    The key is a whole number (cast to long). Null or empty texts have no shingles and link with nothing; so do rows with
    a null key (component_id null, kept true). Rows that repeat a key are one node and should repeat its text. Long
    texts are taken whole. Only the key and text are read, so names of other columns can't clash. An empty table gives no rows.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = written(map_arrow(own, _sketch(params), "doc_id long, n_shingles long, digest binary, sig binary"), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    reps = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "reps")
    search = _Search(own.where("doc_id is not null"), reps.select("rep", "sig"), params)
    links = written(search.links(), "links")
    search.tmp.drop()
    groups = components(links)
    joined = sketched.drop("sig").join(reps.select("digest", "rep"), "digest", "left")
    joined = joined.join(groups, joined["rep"] == groups["node"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
