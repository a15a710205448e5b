"""Sequence packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import gapless_rank, map_arrow, slices, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins byte-level BPE files use for bytes: printable bytes stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The settings under which tiktoken's engine gives the ids of tokenizers, and its split pattern for them.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BYTE_LEVEL_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a file that both engines must cut alike, joined in a fixed random order, before the faster one is used.
PROBE = 20_000


def _fast_engine(spec: dict, slow):
    """tiktoken's engine for a file of plain byte-level BPE, or None for any other file.

    The engine joins neighbours by the rank of what they form. That is what tokenizers does if merges are in the order of
    the ids they form; a probe of the file's tokens must agree as well.
    """
    import tiktoken

    model = dict(spec["model"])
    vocab, merges = model.pop("vocab", {}), [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.pop("merges", [])]
    plain = not any(spec.get(x) for x in ("normalizer", "truncation", "padding")) and spec.get("pre_tokenizer") == BYTE_LEVEL
    if not plain or model != BYTE_LEVEL_MODEL or any(x.get("lstrip") or x.get("rstrip") or x.get("normalized") or x.get("single_word") for x in spec.get("added_tokens", [])):
        return None
    special, byte = {x["content"] for x in spec.get("added_tokens", [])}, _unicode_bytes()
    formed = [vocab.get(a + b, -1) for a, b in merges]
    own = [t for t in vocab if t not in special]
    if any(x >= y for x, y in zip(formed, formed[1:])) or len(formed) + 256 != len(own) or any(c not in byte for t in own for c in t):
        return None
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): vocab[t] for t in own}, special_tokens={})
    some = np.random.default_rng(0).permutation(len(own))[:PROBE]
    probe = b"".join(bytes(byte[c] for c in own[i]) for i in some).decode(errors="ignore")
    return fast if fast.encode_ordinary(probe) == slow.encode(probe, add_special_tokens=False).ids else None


@functools.lru_cache(2)
def encoder(path: str):
    """A function from texts to lists of ids, the ids of tokenizers' Tokenizer.from_file(path) with add_special_tokens=False.

    For plain byte-level BPE the vocabulary and merges of the file are run by tiktoken's engine (about four times as fast
    per CPU second, ids equal; tests hold them against each other), any other file by tokenizers. Texts that hold a
    special token's string always go to tokenizers, which reads that string as the special id.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec.get("added_tokens", [])]
    slow = Tokenizer.from_file(path)
    fast = _fast_engine(spec, slow)

    def encode(text: str) -> list[int]:
        if fast is None or any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    encode.engine = "tokenizers" if fast is None else "tiktoken"
    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids and end_id, cut every `capacity` ids from its start: one row per piece, without the ids.

    A null text is empty (just end_id). Cuts depend on the document's own length alone.
    """

    def cut(batch: pa.RecordBatch):
        encode = encoder(tokenizer)
        for part in slices(batch, "text", 4 << 20):
            rows = []
            for doc, body in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.array([*encode(body or ""), end_id], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc, start, len(piece), zlib.crc32(piece), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths of a sequence, in order) and how many sequences follow each.

    Lengths go longest first, each into the open patterns with the most room; where a pattern has more sequences than
    there are pieces left, it is divided. State is the number of distinct patterns, not of documents.
    """
    open_by_room: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        left = int(histogram[length])
        while left:
            room = max((r for r, packs in open_by_room.items() if packs and r >= length), default=None)
            if room is None:
                open_by_room[capacity - length].append([(length,), left])
                break
            lengths, count = open_by_room[room].pop()
            taken = min(count, left)
            if count > taken:
                open_by_room[room].append([lengths, count - taken])
            open_by_room[room - length].append([(*lengths, length), taken])
            left -= taken
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in open_by_room.values():
        for lengths, count in packs:
            merged[lengths] += count
    return sorted(merged.items(), reverse=True)


def placement(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, and each run's first sequence and offset. A run is one slot of one pattern."""
    runs, used, base = defaultdict(list), defaultdict(int), 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            runs[length].append((used[length], base, offset))
            used[length] += count
            offset += length
        base += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. Whole-capacity
    pieces are sequences of their own; the rest are packed by the histogram of their lengths, at most `capacity`
    rows on the driver at any input size. Pieces of equal length are told apart by their rank, so no piece is looked
    at on the driver. The key is a whole number (cast to long) and may be null. Null or empty texts are one piece of the
    end id; long texts are cut whole; repeated rows are packed each, and equal pieces of one key may take each other's
    places; an empty table gives no rows. Only the key and the text are read, so other columns can't clash.
    """
    found = written(pieces(docs, tokenizer, capacity, end_id, key, text), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = placement(shortest_pack_first(histogram, capacity))
    ranked = gapless_rank(found, ["length"], ["doc_id", "start", "ids_crc32"], "rank")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(lengths), 2), np.int64)
        order = np.argsort(lengths, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            firsts, bases, offsets = where[int(lengths[own[0]])]
            run = np.searchsorted(firsts, ranks[own], side="right") - 1
            out[own, 0] = bases[run] + ranks[own] - firsts[run]
            out[own, 1] = offsets[run]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    spot = ranked.withColumn("spot", place("length", "rank"))
    return spot.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "spot.sequence_id", "spot.offset")
