"""Substring deduplication with a log-structured index of window fingerprints, verified on words.

Documents come in batches. Every window of `window` words has a 64-bit fingerprint. The index is one table, bucketed by the
fingerprints' leading bits, that holds immutable runs: each sorted by fingerprint, with the document and the place (its
owner) that had it first. A batch is dealt to the same buckets and merge-joined there with the runs, which are read in
place and never shuffled; it becomes a run itself, and once there are `fanout` runs, the same pass writes their merged
run and the old ones go. A window that the index knows is a claim: "these words stand there in that document". Claims are
verified on the words of both texts; a claim that fails is settled from the words of all its windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalyne.llm.common import Temporary, Tokens, batches_of, carried_row, gathered, map_arrow, mix, release_memory, shuffles_released, slices, split_words, with_row
from chromalyne.sources.storage import delete_path, scratch

WINDOW = 13
SLICE_BYTES = 2 << 20
#: Windows of the whole input that one part of a bucket or one hit group should have; their numbers grow with the input.
PART_WINDOWS = 1_000_000
#: Parts at least; parts that share a bucket (a file of a run) where there are more buckets than MANY; buckets at most.
LEAST_PARTS, PARTS_A_BUCKET, MANY_BUCKETS, MOST_BUCKETS = 8, 8, 64, 50_000
#: Common fingerprints that a task remembers, so that it sends each of them on once rather than once a slice.
REMEMBERED = 1 << 16
#: Claims of one owner that are verified against one copy of its text.
CLAIMS_A_TEXT = 4096
#: Fingerprints whose windows are settled by their words in one pass over the documents.
SETTLED_AT_ONCE = 1_000_000

PARTS = "part int, grp int, kind int, n long, docs binary, data binary"
HITS, NEW, RUN = 0, 1, 2


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length as byte planes, so that the zero bytes of small values lie together and compress."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    with np.errstate(over="ignore"):
        out[1:] -= x[:-1]
    return out


def sums(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(x, dtype=x.dtype)


def fingerprints(words: Tokens, window: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word in the row and hash (its leading `bits` bits) of every window that lies in one row."""
    h = words.hashes()
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows = words.row_of()
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += h[i : i + n]
    whole = np.flatnonzero(rows[:n] == rows[window - 1 :])
    row = rows[whole]
    return row, whole - words.first[row], mix(out[whole]) & np.uint64((1 << 64) - (1 << (64 - bits)))


PARTS_ARROW = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("data", pa.binary())])
BATCH_BYTES = 1 << 20
#: Entries of a run in a row: Parquet looks at the size of a page only after 100 rows.
RUN_ROW = 1 << 12


def _batches(rows: list[tuple]) -> list[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH_BYTES."""
    out, first, size = [], 0, 0
    for i, row in enumerate(rows):
        size += len(row[4]) + len(row[5])
        if size >= BATCH_BYTES or i == len(rows) - 1:
            out.append(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[first : i + 1]), PARTS_ARROW)], schema=PARTS_ARROW))
            first, size = i + 1, 0
    return out


def _hit_rows(part: int | None, ids: np.ndarray, crcs: np.ndarray, positions: np.ndarray, owners: np.ndarray, places: np.ndarray, groups: int) -> list[tuple]:
    """Hits and their owners as packed rows by hit group: a document's hits all meet in one group."""
    if not len(ids):
        return []
    group = (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
    order = np.lexsort((positions, crcs, ids, group))
    group, ids, crcs, positions, owners, places = (x[order] for x in (group, ids, crcs, positions, owners, places))
    out = []
    for own in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
        s, g = slice(own[0], own[-1] + 1), int(group[own[0]])
        data = pack(deltas(ids[s]), deltas(crcs[s]), deltas(positions[s].astype(np.uint32)), deltas(owners[s]), deltas((places[s] - positions[s]).astype(np.int64)))
        out.append((g if part is None else part, g, HITS, len(own), b"", data))
    return out


def _scatter(window: int, hash_bits: int, bits: int, groups: int):
    """Windows of a slice by part. A fingerprint goes on only for the smallest document that has it here; larger documents
    of the slice are hits already. What several documents of a slice have is remembered, so a passage in a third of all
    documents sends an entry per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))  # sorted fingerprints, their documents and places
        for batch in gathered(batches, "text", SLICE_BYTES):
            for part in slices(batch, "text", SLICE_BYTES):
                part = part.take(pa.array(np.argsort(part.column("doc_id").to_numpy(), kind="stable")))
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                crcs = part.column("crc").to_numpy().astype(np.uint32)
                row, position, h = fingerprints(Tokens(part.column("text")), window, hash_bits)
                if not len(h):
                    continue
                doc = ids[row]
                order = np.argsort(h, kind="stable")  # windows come by document and place
                fresh = np.ones(len(order), bool)
                fresh[1:] = h[order][1:] != h[order][:-1]
                heads = order[np.flatnonzero(fresh)]
                which = np.empty(len(order), np.int64)
                which[order] = np.cumsum(fresh) - 1
                owner, place = doc[heads], position[heads]
                if len(known[0]):
                    at = np.minimum(np.searchsorted(known[0], h[heads]), len(known[0]) - 1)
                    earlier = (known[0][at] == h[heads]) & (known[1][at] < owner)
                    owner, place = np.where(earlier, known[1][at], owner), np.where(earlier, known[2][at], place)
                hit = doc > owner[which]
                several = np.zeros(len(heads), bool)
                several[which[hit]] = True
                if several.any():
                    new = (np.concatenate([x, y[several]]) for x, y in zip(known, (h[heads], owner, place)))
                    kh, kd, kp = (x[-2 * REMEMBERED :] for x in new)
                    keep = np.lexsort((np.arange(len(kh)), kd, kh))
                    first = np.ones(len(keep), bool)
                    first[1:] = kh[keep][1:] != kh[keep][:-1]
                    keep = keep[first]
                    if len(keep) > REMEMBERED:
                        keep = np.sort(keep)[-REMEMBERED:]
                        keep = keep[np.argsort(kh[keep])]
                    known = kh[keep], kd[keep], kp[keep]
                out = _hit_rows(None, doc[hit], crcs[row[hit]], position[hit], owner[which[hit]], place[which[hit]], groups)
                send = np.flatnonzero(~hit)
                target = (h[send] >> np.uint64(64 - bits)).astype(np.int32)
                by = np.argsort(target, kind="stable")  # keeps rows and positions in order
                send, target = send[by], target[by]
                for own in np.split(np.arange(len(send)), np.flatnonzero(np.diff(target)) + 1) if len(send) else []:
                    s = send[own]
                    used, local = np.unique(row[s], return_inverse=True)
                    data = pack(h[s], deltas(local.astype(np.uint32)), deltas(position[s].astype(np.uint32)))
                    out.append((int(target[own[0]]), -1, NEW, len(s), len(used).to_bytes(8, "little") + pack(deltas(ids[used]), crcs[used]), data))
                yield from _batches(out)
        release_memory()

    return run


def _merge(groups: int, compact: bool, keep: bool):
    """One part: the batch's entries against each other and the runs; gives hits and the new run (with compact: the merged
    one; without keep: none)."""

    def merged(table: pa.Table, part: int) -> list[tuple]:
        old, hs, docs, crcs, positions, out = [], [], [], [], [], []
        for kind, grp, n, own, data in zip(*(table.column(c).to_pylist() for c in ("kind", "grp", "n", "docs", "data"))):
            if kind == HITS:
                out.append((part, grp, HITS, n, own, data))
            elif kind == RUN:
                h, doc, place = unpack(data, n, np.uint64, np.int64, np.uint32)
                old.append((sums(h), doc, place))
            else:
                h, local, step = unpack(data, n, np.uint64, np.uint32, np.uint32)
                ids, crc = unpack(own[8:], int.from_bytes(own[:8], "little"), np.int64, np.uint32)
                local = sums(local)
                hs.append(h), docs.append(sums(ids)[local]), crcs.append(crc[local]), positions.append(sums(step))
        run_h, run_doc, run_place = (np.concatenate([x[i] for x in old]) if old else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.uint32)))
        order = np.argsort(run_h, kind="stable")  # rows of sorted runs: a merge
        run_h, run_doc, run_place = run_h[order], run_doc[order], run_place[order]
        h, doc, place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if hs:
            h, doc, crc, position = (np.concatenate(x) for x in (hs, docs, crcs, positions))
            order = np.lexsort((position, doc, h))
            h, doc, crc, position = h[order], doc[order], crc[order], position[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[1:] != h[:-1]
            heads, which = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            owner, spot, known = doc[heads], position[heads], np.zeros(len(heads), bool)
            if len(run_h):
                at = np.minimum(np.searchsorted(run_h, h[heads]), len(run_h) - 1)
                known = run_h[at] == h[heads]
                owner, spot = np.where(known, run_doc[at], owner), np.where(known, run_place[at], spot)
            hit = known[which] | (doc > owner[which])
            out += _hit_rows(part, doc[hit], crc[hit], position[hit].astype(np.int64), owner[which[hit]], spot[which[hit]].astype(np.int64), groups)
            h, doc, place = h[heads[~known]], doc[heads[~known]], position[heads[~known]]
        if compact and len(run_h):
            h, doc, place = np.concatenate([h, run_h]), np.concatenate([doc, run_doc]), np.concatenate([place, run_place])
            order = np.argsort(h, kind="stable")
            h, doc, place = h[order], doc[order], place[order]
        for a in range(0, len(h) if keep else 0, RUN_ROW):
            s = slice(a, a + RUN_ROW)
            out.append((part, -1, RUN, len(h[s]), b"", pack(deltas(h[s]), doc[s], place[s])))
        return out

    def run(batch: pa.Table, history: pa.Table) -> pa.Table:
        table = pa.concat_tables([t.select(PARTS_ARROW.names).cast(PARTS_ARROW) for t in (batch, history)])
        out = merged(table, table.column("part")[0].as_py())
        release_memory()
        return pa.Table.from_batches(_batches(out), schema=PARTS_ARROW)

    return run


#: A span: first word, number of windows, owner and the owner's first word.
SPAN = (np.uint32, np.uint32, np.int64, np.uint32)


def _spans(table: pa.Table) -> pa.Table:
    """One hit group: each document's hits as spans of consecutive windows that one owner has consecutively."""
    kinds = (np.int64, np.uint32, np.uint32, np.int64, np.int64)
    parts = [[sums(x) for x in unpack(data, n, *kinds)] for n, data in zip(table.column("n").to_pylist(), table.column("data").to_pylist())]
    ids, crcs, positions, owners, shifts = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((positions, crcs, ids))
    ids, crcs, positions, owners, shifts = (x[order] for x in (ids, crcs, positions, owners, shifts))
    other = np.ones(len(ids), bool)
    other[1:] = (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])
    once = other.copy()
    once[1:] |= positions[1:] != positions[:-1]  # repeated rows hit at the same places
    ids, crcs, positions, owners, shifts, other = (x[once] for x in (ids, crcs, positions, owners, shifts, other))
    begins = other.copy()
    begins[1:] |= (positions[1:] != positions[:-1] + np.uint32(1)) | (owners[1:] != owners[:-1]) | (shifts[1:] != shifts[:-1])
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(ids)))
    heads = np.flatnonzero(other[starts])
    columns = [positions[starts], sizes.astype(np.uint32), owners[starts], (positions[starts] + shifts[starts]).astype(np.uint32)]
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(heads, np.append(heads[1:], len(starts)))]
    first = starts[heads]
    return pa.table({"hit_id": pa.array(ids[first], pa.int64()), "hit_crc": pa.array(crcs[first].astype(np.int64), pa.int64()), "n_spans": pa.array(np.diff(np.append(heads, len(starts))), pa.int64()), "spans": pa.array(blobs, pa.binary())})


def spans_of(blob: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 0
    for kind in SPAN:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class FingerprintIndex:
    """Runs of historical window fingerprints in one table of the shared folder.

    `expected_windows` sets the number of parts (a power of two), hit groups and buckets, so that one part or group fits a
    task at any input size; give the windows the index should hold in the end. hash_bits: leading bits of a fingerprint
    that are used; fewer than 64 only make more claims to verify.
    """

    def __init__(self, spark: SparkSession, expected_windows: int, window: int = WINDOW, fanout: int = 4, hash_bits: int = 64):
        wanted = max(LEAST_PARTS, -(-expected_windows // PART_WINDOWS))
        self.spark, self.window, self.fanout, self.hash_bits = spark, window, fanout, hash_bits
        self.bits = (wanted - 1).bit_length()
        self.groups = 1 << self.bits
        self.buckets = min(self.groups, max(MANY_BUCKETS, self.groups // PARTS_A_BUCKET), MOST_BUCKETS)
        self.path, self.table = scratch(spark, "fingerprints"), f"chromalyne_fingerprints_{uuid.uuid4().hex}"
        self.runs: list[int] = []
        self.batches = 0

    def _read(self, kind: int) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], PARTS)
        rows = self.spark.table(self.table).where(F.col("kind") == kind)
        rows = rows.where(F.col("run").isin(self.runs)) if kind == RUN else rows
        return rows.select("part", "grp", F.lit(kind).alias("kind"), "n", "docs", "data")

    def ingest(self, docs: DataFrame, last: bool = False) -> None:
        """Add a batch (doc_id, crc, text). With `last` no run is written, as no batch follows that would read it.

        A hit is a window of the batch that the index holds already, or that a document of the batch with a smaller
        doc_id has too.
        """
        compact = len(self.runs) + 1 >= self.fanout
        scattered = docs.select("doc_id", "crc", "text").mapInArrow(_scatter(self.window, self.hash_bits, self.bits, self.groups), PARTS)
        # hits of the slices pass through the merge untouched, in the part of their group's number
        merged = scattered.groupBy("part").cogroup(self._read(RUN).groupBy("part")).applyInArrow(_merge(self.groups, compact, not last), PARTS)
        with shuffles_released(self.spark), batches_of(self.spark, 32):  # a row has the windows of a slice and part
            out = merged.withColumn("run", F.lit(self.batches)).write.format("parquet").mode("append").partitionBy("kind", "run").bucketBy(self.buckets, "part")
            out.option("path", self.path).saveAsTable(self.table)
        old, self.runs = (self.runs, []) if compact or last else ([], self.runs)
        for run in old:
            self._delete(run)
        if not last:
            self.runs.append(self.batches)
        self.batches += 1

    def _delete(self, run: int) -> None:
        delete_path(self.spark, f"{self.path}/kind={RUN}/run={run}")
        self.spark.catalog.refreshTable(self.table)

    def spans(self) -> DataFrame:
        """hit_id, hit_crc, n_spans and spans (SPAN arrays behind one another), one row per document with a hit."""
        return self._read(HITS).groupBy("grp").applyInArrow(_spans, "hit_id long, hit_crc long, n_spans long, spans binary")

    def drop(self) -> None:
        """Delete the table and its files."""
        if self.batches:
            self.spark.sql(f"drop table if exists {self.table}")
            delete_path(self.spark, self.path)
        self.runs, self.batches = [], 0


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


CLAIM = "owner long, place long, words long, digest binary"


def _claims(window: int, named: bool):
    """What each span says: the owner has, from that place on, words of that SHA-256. With `named`, also whose span it is."""

    def run(batch: pa.RecordBatch):
        out = []
        for doc, crc, text, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "crc", "text", "n_spans", "spans"))):
            words = split_words(text)
            for start, size, owner, place in zip(*(x.tolist() for x in spans_of(blob, n))):
                size += window - 1
                out.append((owner, place, size, _digest(words[start : start + size]), *((doc, crc, start) if named else ())))
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["owner", "place", "words", "digest"]
        if named:
            kinds, names = kinds + [pa.int64()] * 3, [*names, "doc_id", "crc", "start"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return run


def _checked(batch: pa.RecordBatch):
    """Claims against one of their owner's texts."""
    out = []
    for owner, text, claims in zip(*(batch.column(c).to_pylist() for c in ("owner", "text", "claims"))):
        words = split_words(text)
        for c in claims:
            out.append((owner, c["place"], c["words"], c["digest"], _digest(words[c["place"] : c["place"] + c["words"]]) == c["digest"]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["owner", "place", "words", "digest", "holds"])


def failed_claims(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Claims that no text of their owner bears out.

    Equal claims (as of the copies of one text) are one row before they meet their owner's text, and an owner of many
    claims gets several tasks, so neither a hot group nor a hot owner gathers anywhere.
    """
    mine = texts.join(spans, (F.col("doc_id") == F.col("hit_id")) & (F.col("crc") == F.col("hit_crc")))
    claims = map_arrow(mine.select("doc_id", "crc", "text", "n_spans", "spans"), _claims(window, False), CLAIM).distinct()
    salted = claims.withColumn("salt", F.pmod(F.xxhash64("place", "words", "digest"), F.lit(1 << 20)))
    fans = claims.groupBy("owner").agg(F.ceil(F.count("*") / CLAIMS_A_TEXT).alias("fan"))
    packed = salted.join(fans, "owner").groupBy("owner", F.pmod("salt", "fan").alias("salt")).agg(F.collect_list(F.struct("place", "words", "digest")).alias("claims"))
    rows = packed.join(texts.select(F.col("doc_id").alias("owner"), "text"), "owner").select("owner", "text", "claims")
    checked = map_arrow(rows, _checked, CLAIM + ", holds boolean")
    return checked.groupBy("owner", "place", "words", "digest").agg(F.max("holds").alias("holds")).where("not holds").drop("holds")


def settled(texts: DataFrame, spans: DataFrame, failed: DataFrame, window: int, hash_bits: int, tmp: Temporary) -> DataFrame:
    """The windows whose fingerprint a failed claim has, judged by their words: hit_id, hit_crc, doubtful (first words) and
    hits (those of them whose words start in a smaller document), both as little-endian u32.

    Fingerprints go in blocks of SETTLED_AT_ONCE, each a pass over the documents.
    """
    same = ["owner", "place", "words", "digest"]
    mine = texts.join(spans, (F.col("doc_id") == F.col("hit_id")) & (F.col("crc") == F.col("hit_crc")))
    named = map_arrow(mine.select("doc_id", "crc", "text", "n_spans", "spans"), _claims(window, True), CLAIM + ", doc_id long, crc long, start long")
    bad = named.join(failed, same, "left_semi").select(F.col("doc_id").alias("d"), F.col("crc").alias("c"), "start", "words").distinct()

    def suspects(batch: pa.RecordBatch):
        for part in slices(batch, "text", SLICE_BYTES):
            row, position, h = fingerprints(Tokens(part.column("text")), window, hash_bits)
            start, size = (part.column(c).to_numpy()[row] for c in ("start", "words"))
            inside = (position >= start) & (position <= start + size - window)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[inside]).view(np.int64))], ["h"])

    doubt = texts.join(bad, (F.col("doc_id") == F.col("d")) & (F.col("crc") == F.col("c"))).select("text", "start", "words")
    doubt = tmp.written(map_arrow(doubt, suspects, "h long").distinct(), "doubtful")
    blocks = max(1, -(-doubt.count() // SETTLED_AT_ONCE))
    found = None
    for block in range(blocks):
        some = doubt.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block).toArrow().column("h").to_numpy().view(np.uint64)
        shared = texts.sparkSession.sparkContext.broadcast(np.sort(some))

        def windows(batch: pa.RecordBatch, shared=shared):
            known = shared.value
            for part in slices(batch, "text", SLICE_BYTES):
                row, position, h = fingerprints(Tokens(part.column("text")), window, hash_bits)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                own = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
                texts_of = {int(r): split_words(part.column("text")[int(r)].as_py()) for r in np.unique(row[own])}
                digests = [_digest(texts_of[r][p : p + window]) for r, p in zip(row[own].tolist(), position[own].tolist())]
                ids = [part.column(c).take(pa.array(row[own])) for c in ("doc_id", "crc")]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *ids, pa.array(position[own])], ["digest", "hit_id", "hit_crc", "position"])

        rows = map_arrow(texts.select("doc_id", "crc", "text"), windows, "digest binary, hit_id long, hit_crc long, position long")
        found = rows if found is None else found.unionByName(rows)
    found = tmp.written(found, "windows")
    least = found.groupBy("digest").agg(F.min("hit_id").alias("least"))
    judged = found.join(least, "digest").select("hit_id", "hit_crc", "position", (F.col("least") < F.col("hit_id")).alias("hit"))
    listed = judged.groupBy("hit_id", "hit_crc").agg(F.array_sort(F.collect_set("position")).alias("doubtful"), F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("position")))).alias("hits"))
    return tmp.written(listed, "settled")


def _trim(window: int, carried: bool):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text", SLICE_BYTES):
            out = []
            for doc, text, n, blob, doubtful, hits in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "n_spans", "spans", "doubtful", "hits"))):
                words = split_words(text)
                kept, stays = text, words
                if blob or hits:
                    hit = np.zeros(len(words) + 1, bool)
                    for start, size in zip(*(x.tolist() for x in spans_of(blob, n)[:2])) if blob else ():
                        hit[start : start + size] = True
                    if doubtful:
                        hit[doubtful] = False
                        hit[hits] = True
                    edge = np.zeros(len(words) + window + 1, np.int64)
                    first = np.flatnonzero(hit)
                    edge[first] += 1
                    edge[first + window] -= 1
                    covered = np.cumsum(edge)[: len(words)] > 0
                    if covered.any():
                        stays = [w for w, gone in zip(words, covered.tolist()) if not gone]
                        kept = b" ".join(stays).decode()
                out.append((doc, len(words), len(words) - len(stays), kept, hashlib.sha256(b" ".join(stays)).hexdigest()))
            columns = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns + ([part.column("row")] if carried else []), ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"] + ["row"] * carried)

    return run


TRIMMED = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 6, fanout: int = 4, carry: bool = False, hash_bits: int = 64) -> DataFrame:
    """Remove every word that a window of `window` words covers whose words also start in a document with a smaller key.

    docs go through a FingerprintIndex in `batches` batches of ascending keys. What the index finds is verified on the
    words of both documents (SHA-256 of the passage's words); where words differ under equal fingerprints, all windows
    with such a fingerprint are compared by their words, so the result is that of comparing words whatever hash_bits is.
    Windows are judged on the input. Returns a row per input row: doc_id, n_words, n_removed, kept_text (untouched where
    nothing was removed, else the kept words joined by one space) and kept_sha256 (of the kept words joined by one space).

    The key is a whole number (cast to long; what can't be cast is an error). Null and empty texts have no words; texts
    shorter than the window have no windows. Rows that repeat a key are not smaller than each other, so they don't
    remove each other's words; each is trimmed by its own windows. Rows with a null key are neither indexed nor
    trimmed. Long texts are windowed whole. Only the key and text are read; with `carry`, all input columns come back as
    a struct column `row`, where names can't clash. An empty table gives no rows.
    """
    spark, tmp = docs.sparkSession, Temporary(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"), F.col(text).alias("text"), *carried_row(docs, carry))
    keyed = own.where("doc_id is not null").select("doc_id", "crc", "text")
    size = keyed.agg(F.sum(F.octet_length("text")).alias("size"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first()
    index = FingerprintIndex(spark, (size["size"] or 0) // 6, window, fanout, hash_bits)
    cuts = sorted(set(size["cuts"] or []))
    bounds = list(zip([None, *cuts], [*cuts, None]))
    for i, (low, high) in enumerate(bounds):
        part = keyed if low is None else keyed.where(F.col("doc_id") > low)
        index.ingest(part if high is None else part.where(F.col("doc_id") <= high), last=i == len(bounds) - 1)
    spans = tmp.written(index.spans(), "spans")
    index.drop()
    failed = tmp.written(failed_claims(keyed, spans, window), "failed-claims")
    found = spans.withColumns({c: F.lit(None).cast("array<long>") for c in ("doubtful", "hits")})
    if not failed.isEmpty():
        found = spans.join(settled(keyed, spans, failed, window, hash_bits, tmp), ["hit_id", "hit_crc"], "full")
    joined = own.join(found, (own["doc_id"] == found["hit_id"]) & (own["crc"] == found["hit_crc"]), "left")
    return map_arrow(joined.select("doc_id", "text", "n_spans", "spans", "doubtful", "hits", *["row"] * carry), _trim(window, carry), with_row(TRIMMED, own))
