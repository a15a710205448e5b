import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromalyne.llm import packing
from helpers import awkward, none, prose

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    t = test_ids_are_the_tokenizers.__dict__.setdefault("t", tokenizers.Tokenizer.from_file(PATH))
    assert packing.encoder(PATH)(text) == t.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts(reference):
    for text in ("", "a<|endoftext|>b", "  two  spaces\n\n\tand", "it's I'LL 'tis", "日本語 текст ١٢٣ 😀👩‍👩‍👧", "\u00a0\u2003x\u200b", "\x00\x01", "x" * 5000, prose(1, 500), "!!!???...  ", "Ⅷ²½"):
        assert packing.encoder(PATH)(text) == reference(text), text[:20]


def test_other_files_go_to_tokenizers(tmp_path):
    import json

    assert packing.encoder(PATH).engine == "tiktoken"
    spec = json.load(open(PATH, encoding="utf-8"))
    paths = [P.path("word_bpe_49k.json")]
    first, second, *rest = spec["model"]["merges"]
    for i, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"model": spec["model"] | {"merges": [second, first, *rest]}})):
        paths.append(str(tmp_path / f"{i}.json"))
        json.dump(spec | change, open(paths[-1], "w", encoding="utf-8"))
    for path in paths:
        slow = tokenizers.Tokenizer.from_file(path)
        assert packing.encoder(path).engine == "tokenizers"
        for text in ("The  Quick\tbrown the a at", "<|endoftext|> x", "ÉTÉ 12 a't"):
            assert packing.encoder(path)(text) == slow.encode(text, add_special_tokens=False).ids


def check(rows, texts, reference, capacity):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    want, got = Counter(), Counter()
    for doc, text in texts:
        ids = np.array([*reference(text or ""), 1], "<u4")
        for a in range(0, len(ids), capacity):
            part = ids[a : a + capacity]
            want[doc, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    assert got == want
    return sequences


def test_every_id_lies_in_one_piece(spark, reference):
    table = awkward(spark)
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    for capacity in (64, 2048):
        check(packing.pack_documents(table, PATH, capacity).collect(), texts, reference, capacity)
    assert packing.pack_documents(none(spark), PATH).count() == 0


def test_little_padding(spark, reference):
    rows = [(i, prose(i, 20 + 37 * i % 400)) for i in range(400)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 2048).collect()
    sequences = check(found, rows, reference, 2048)
    used = sum(length for spans in sequences.values() for _, length in spans)
    assert used / (2048 * len(sequences)) > 0.95


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
@settings(max_examples=100, deadline=None)
def test_patterns_use_every_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    used = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 64 and list(lengths) == sorted(lengths, reverse=True)
        for x in lengths:
            used[x] += count
    assert used == Counter(histogram)
    for length, (firsts, bases, offsets) in packing.placement(patterns).items():
        assert firsts[0] == 0 and (np.diff(firsts) > 0).all()


def test_too_long_pieces_are_an_error():
    with pytest.raises(ValueError):
        packing.shortest_pack_first({65: 1}, 64)
