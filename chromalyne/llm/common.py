"""Helpers the training-data operators share: shared storage, Arrow mapping, ranks, words."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from chromalyne.sources.storage import delete_path, scratch


#: Rows of texts in an Arrow batch of a written step at most; elsewhere Spark's own bound of 64 MB a batch holds.
TEXT_ROWS = 256


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what is planned and run inside; afterwards it is as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_released(spark: SparkSession):
    """Spark drops the shuffle files of what runs inside as soon as it has ended, not when the driver next collects garbage.

    For writes of tables whose inputs are not read again; a later reader of such a shuffle would compute it again.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_of(spark: SparkSession, rows: int = TEXT_ROWS):
    """Arrow batches of at most so many rows for what is planned and run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, None) or 10_000)
    return setting(spark, name, str(min(rows, now) if now > 0 else rows))


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and a lost executor costs no recomputation of what came before."""
    path = scratch(df.sparkSession, tag)
    with shuffles_released(df.sparkSession), batches_of(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Temporary:
    """Written tables that go once what was made from them is written too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        out = written(df, tag)
        self.paths += [p.rpartition("/")[0] for p in out.inputFiles()[:1]]
        return out

    def drop(self, last: int = 0) -> None:
        """Delete the tables, but for the last few."""
        gone, self.paths = self.paths[: len(self.paths) - last], self.paths[len(self.paths) - last :]
        for path in gone:
            delete_path(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and several may wait idle on an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, least_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of small batches in larger ones, each with about least_bytes of the column's data."""
    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column(column).nbytes
        if size >= least_bytes:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str | T.StructType, gather: tuple[str, int] | None = None) -> DataFrame:
    """fn over every Arrow batch of df; it may answer with one batch or several. gather: a column and how many of its bytes fn should get at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, *gather) if gather else batches:
            if batch.num_rows:
                out = fn(batch)
                yield from ([out] if isinstance(out, pa.RecordBatch) else out)
        release_memory()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about most_bytes of the column's data; a single longer row stands alone."""
    _, ends = utf8(batch.column(column))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = int(np.searchsorted(ends, ends[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield batch.slice(first, last - first)
        first = last


def carried_row(docs: DataFrame, carry: bool = True) -> list[Column]:
    """All columns of docs as one struct `row`, to go through an operator unseen."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []


def with_row(schema: str, own: DataFrame) -> T.StructType:
    """A schema with own's `row`, if it has one."""
    return T.StructType([*T._parse_datatype_string(schema), *[f for f in own.schema if f.name == "row"]])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copies, and rows + 1 offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    block = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    block = block[ends[0] : ends[-1]]
    return block, ends - ends[0]


#: The bytes that part words, space and 0x09 to 0x0D.
_PARTS = np.zeros(256, bool)
_PARTS[[32, 9, 10, 11, 12, 13]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out) if n else out


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a column: where each begins and ends, which rows they are of, a 64-bit hash of each.

    The hash is a polynomial of the word's bytes modulo 2**64, taken from running sums, then mixed; words with equal bytes have equal hashes.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        block, ends = utf8(column)
        if lower:
            block = np.where((block >= 65) & (block <= 90), block + 32, block).astype(np.uint8)
        self.block, self.ends = block, ends
        inside = np.empty(len(block) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_PARTS[block], out=inside[1:-1])
        starts = inside[1:-1] & ~inside[:-2]
        stops = inside[1:-1] & ~inside[2:]
        borders = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(block))]
        starts[borders] |= inside[1:-1][borders]
        stops[borders - 1] |= inside[1:-1][borders - 1]
        self.starts = np.flatnonzero(starts)
        self.stops = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, ends)  # of each row, rows + 1 of them
        self.counts = np.diff(self.first)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Of whole words, or of their first `prefix` bytes (of shorter words the whole)."""
        out = np.empty(len(self.starts), np.uint64)
        ends = self.stops if prefix is None else np.minimum(self.stops, self.starts + prefix)
        lengths = ends - self.starts
        step = 1 << 17
        for a in range(0, len(out), step):
            b = min(a + step, len(out))
            lo, hi = self.starts[a], self.stops[b - 1]
            terms = _BYTE_VALUES[self.block[lo:hi]]
            with np.errstate(over="ignore"):
                terms *= _powers(_MULTIPLIER, len(terms))
                sums = np.zeros(len(terms) + 1, np.uint64)
                np.cumsum(terms, out=sums[1:])
                h = sums[ends[a:b] - lo] - sums[self.starts[a:b] - lo]
                h *= _powers(_INVERSE, len(terms))[self.starts[a:b] - lo]
                out[a:b] = mix(h + lengths[a:b].astype(np.uint64))
        return out

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


#: The key of the words' hash.
_WORD_KEY = "chromalyne words"


def hashed_words(words: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash (SipHash) of the bytes of every word, strings or bytes."""
    return pd.util.hash_array(words, hash_key=_WORD_KEY, categorize=False)


class Tokens:
    """The words `[^\\x20\\x09-\\x0D]+` of a column, told apart by their bytes: `words` are the distinct ones, `ids` says which
    follow each other, `first` where each row's begin."""

    def __init__(self, column: pa.Array, lower: bool = False):
        text = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
        sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(sizes)) if len(flat) else np.zeros(len(sizes), np.int64)
        coded = flat.filter(full).dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy(), coded.dictionary
        self.counts, self.first = counts, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return hashed_words(self.words.to_numpy(zero_copy_only=False))[self.ids] if len(self.words) else np.zeros(0, np.uint64)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The same words of one text."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words of the whole array, mixed word by word; callers leave out those that cross rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix((out ^ words[i : len(words) - n + 1 + i]) + np.uint64(0x9E3779B97F4A7C15))
        return out


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows_a_task: int = 200_000) -> DataFrame:
    """df with a 0-based gapless long rank inside each group.

    No task holds a whole group: rows are dealt to sub-buckets by a hash of the order columns, the counts of earlier
    sub-buckets give each its first rank, and a window numbers the rows of one sub-bucket. The join and the window use
    the same partitioning. Ties under `order` may be numbered either way, so callers name enough columns. df is read
    twice and should be a written table.
    """
    n = max(1, -(-df.count() // rows_a_task))
    sub, skip = "__sub", "__skip"
    dealt = df.withColumn(sub, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    running = Window.partitionBy(*group).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(*group, sub).agg(F.count("*").alias("__n")).withColumn(skip, F.coalesce(F.sum("__n").over(running), F.lit(0))).drop("__n")
    firsts = firsts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(sub).alias("__s"), skip)
    same = F.col(sub) == F.col("__s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*group, sub).orderBy(*order)
    joined = dealt.join(firsts, same).withColumn(out, F.row_number().over(within) - 1 + F.col(skip))
    return joined.select(*df.columns, F.col(out).cast("long").alias(out))


def training_rows(rows: DataFrame, by: str, most: int, most_bytes: int, key: str = "doc_id", text: str = "text", most_classes: int = 100, texts: DataFrame | None = None) -> DataFrame | None:
    """At most `most` rows for each of the most_classes most frequent values of `by` (ties: the smaller value), the first by a
    hash of the key: (key, text, by, place), or None without any. So it has most * most_classes rows at most.

    The bounds are the caller's documented parameters; texts over most_bytes (UTF-8) are not used for training, and of rows
    that repeat a key the smallest text is. `place` orders a class. Hashes under a limit set from the counts, little more
    than `most` of a class of any size, come to the driver without keys or texts; it finds the last hash to take. The keys
    taken are broadcast to the texts, which come from `texts` (key and text, and `by` if rows of a key differ in it) or rows.
    """
    spark = rows.sparkSession
    short = F.col(by).isNotNull() & (F.octet_length(F.col(text)) <= most_bytes)
    tmp = Temporary(spark)
    keyed = tmp.written(rows.where(short).select(F.col(by).alias("by"), F.col(key).alias("key"), F.xxhash64(key).alias("place")), "labelled")
    counts = {r["by"]: r["n"] for r in keyed.groupBy("by").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "by").limit(most_classes).collect()}
    kind = T.StructType([T.StructField("by", keyed.schema["by"].dataType), T.StructField("last", T.LongType())])
    share = {c: min(1.0, (most + 6 * most**0.5 + 16) / n) for c, n in counts.items()}
    lasts: list[tuple] = []
    while share:
        limits = spark.createDataFrame([(c, int(min((1 << 63) - 1, -(1 << 63) + x * 2.0**64))) for c, x in share.items()], kind)
        under = keyed.join(F.broadcast(limits), "by").where(F.col("place") <= F.col("last")).select("by", "place").distinct()
        found: dict = {c: [] for c in share}
        for r in under.collect():
            found[r["by"]].append(r["place"])
        done = {c for c, x in share.items() if x >= 1 or len(found[c]) >= most}
        lasts += [(c, sorted(found[c])[:most][-1]) for c in done]
        share = {c: min(1.0, 4 * x) for c, x in share.items() if c not in done}  # classes of few keys that are repeated often
    if not lasts:
        tmp.drop()
        return None
    taken = keyed.join(F.broadcast(spark.createDataFrame(lasts, kind)), "by").where(F.col("place") <= F.col("last")).select("by", "key", "place").distinct()
    taken = written(taken.withColumnsRenamed({"key": "__k", "by": "__b"}), "taken")
    tmp.drop()
    own = (rows if texts is None else texts).where(F.octet_length(F.col(text)) <= most_bytes)
    same = F.col(key).eqNullSafe(F.col("__k"))
    joined = own.join(F.broadcast(taken), same & (F.col(by) == F.col("__b")) if by in own.columns else same)
    joined = joined.select(F.col(key).alias("key"), F.col("__b").alias("by"), "place", F.col(text).alias("text"))
    return joined.groupBy("key", "by", "place").agg(F.min("text").alias("text")).select("key", "text", "by", "place")


def fitted(sample: DataFrame, columns: list[str], fit: Callable[[list[tuple]], object]) -> object:
    """fit of the sorted rows of a bounded sample, run in one task; the driver gets the pickled result alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns)))
        out = pickle.dumps(fit(held))
        del held
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["model"])

    with batches_of(sample.sparkSession):
        return pickle.loads(sample.select(*columns).repartition(1).mapInArrow(run, "model binary").first()["model"])


def crc_rest(column: str, n: int) -> Column:
    """CRC-32 of a column as text, modulo n; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
