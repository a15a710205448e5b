import random

import pytest

from chromalyne.llm import decontaminate as d
from helpers import awkward, none, prose


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


ITEMS = [prose(s, n) for s, n in ((500, 14), (501, 30), (502, 59), (503, 5))]


def altered(text, at):
    words = text.split()
    for i in at:
        words[i] = "changed"
    return " ".join(words)


def docs(spark):
    rows = [
        (0, prose(1, 50) + " " + ITEMS[1] + " " + prose(2, 50)),
        (1, prose(3, 200)),
        (2, prose(4, 20) + " " + altered(ITEMS[2], (7, 20, 33, 48)) + " " + prose(5, 20)),
        (3, ITEMS[0].upper().replace(" ", ",  ")),
        (4, prose(6, 30) + " " + " ".join(ITEMS[1].split()[:10]) + " " + prose(7, 30)),  # ten words are too few
        (5, prose(8, 30) + " " + " ".join(ITEMS[2].split()[20:40]) + " " + prose(9, 30)),
        (6, altered(ITEMS[0], (6,))),
        (7, None), (8, ""), (9, ITEMS[3]),
        (10, " ".join(random.Random(4).sample(ITEMS[2].split(), 59))),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def best_segment(x, y):
    """Every shift, every stretch: the most equal words of a stretch whose score is best."""
    found = 0
    for shift in range(-len(y) + 1, len(x)):
        cur = hit = best = at_best = 0
        for i in range(max(0, shift), min(len(x), shift + len(y))):
            same = x[i] == y[i - shift]
            cur, hit = cur + (1 if same else -d.PENALTY), hit + same
            if cur <= 0:
                cur = hit = 0
            if cur > best:
                best, at_best = cur, hit
        found = max(found, at_best)
    return found


@pytest.mark.parametrize("most", [d.BROADCAST_BYTES, 0])
def test_overlaps_match_brute_force(spark, monkeypatch, most):
    import math
    import re

    monkeypatch.setattr(d, "BROADCAST_BYTES", most)
    table = docs(spark)
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = set()
    for r in table.collect():
        for i, item in enumerate(ITEMS):
            n = best_segment(words(r["text"]), words(item))
            if n >= min(d.MIN_WORDS, math.ceil(len(words(item)) * d.IDENTITY)):
                want.add((r["doc_id"], i, n))
    got = {(r["doc_id"], r["item_id"], r["matches"]) for r in d.overlaps(table, bench(spark, ITEMS)).collect()}
    assert got == want and {x[0] for x in got} == {0, 2, 3, 5, 6, 9}


def test_places_of_an_overlap(spark):
    r = d.overlaps(docs(spark).where("doc_id = 0"), bench(spark, ITEMS)).first()
    assert (r["doc_start"], r["item_start"], r["matches"], r["length"]) == (50, 0, 30, 30)


def test_only_leaking_documents_go(spark):
    kept = d.decontaminate(docs(spark), bench(spark, ITEMS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 7, 8, 10]
    table = awkward(spark)
    assert d.decontaminate(table, bench(spark, ITEMS)).count() == table.count()
    leak = d.decontaminate(table, bench(spark, [prose(1, 40), None, ""]))
    assert leak.columns == table.columns and leak.count() == table.count() - 2  # null keys stay


def test_empty_tables(spark):
    assert d.overlaps(none(spark), bench(spark, ITEMS)).count() == 0
    assert d.overlaps(docs(spark), bench(spark, ITEMS).where("false")).count() == 0


def test_short_items_are_found_whole(spark):
    items = ["alpha", "beta gamma", "one two three four five six seven", "", None]
    texts = ["say ALPHA now", "beta, gamma", "gamma beta", "x one two three four five six seven y", "one two three four five six eight", "alphabet"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matches"]) for r in d.overlaps(table, bench(spark, items)).collect()}
    assert got == {(0, 0, 1), (1, 1, 2), (3, 2, 7)}


def test_long_items_are_no_part_of_the_broadcast(spark):
    long = prose(77, 20_000)
    table = spark.createDataFrame([(0, prose(1, 30) + " " + " ".join(long.split()[9000:9040])), (1, prose(2, 90))], "doc_id long, text string")
    rows = d.overlaps(table, bench(spark, [long, prose(3, 20)])).collect()
    assert [(r["doc_id"], r["item_id"], r["matches"], r["item_start"]) for r in rows] == [(0, 0, 40, 9000)]


def test_repeated_words_are_verified_once_a_shift(spark):
    table = spark.createDataFrame([(0, "la " * 300)], "doc_id long, text string")
    r = d.overlaps(table, bench(spark, ["la " * 40])).first()
    assert (r["matches"], r["length"], r["doc_start"], r["item_start"]) == (40, 40, 0, 0)


@pytest.mark.parametrize("share", [0.1, 0.2])
def test_recall_of_the_seeds(spark, share):
    """Of items of the driver's lengths with substituted words, what the rule without seeds finds."""
    r = random.Random(5)
    items = [prose(900 + i, n) for i, n in enumerate(range(15, 60, 3))]
    texts, want = [], set()
    for i in range(600):
        k = i % len(items)
        n = len(items[k].split())
        changed = altered(items[k], r.sample(range(n), int(share * n)))
        texts.append(f"{prose(40_000 + i, 12)} {changed} {prose(50_000 + i, 12)}")
        want.add((i, k))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in d.overlaps(table, bench(spark, items)).collect()}
    assert len(want & got) >= 0.99 * len(want)


def test_no_python_in_the_plan(spark):
    plan = d.overlaps(docs(spark), bench(spark, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def longest_in(x, y, shift):
    """Every stretch along a shift of which four fifths or more are equal: the most equal words."""
    same = [x[i] == y[i - shift] for i in range(max(0, shift), min(len(x), shift + len(y)))]
    found = 0
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            if 5 * sum(same[i:j]) >= 4 * (j - i):
                found = max(found, sum(same[i:j]))
    return found


def longest_similar(x, y):
    """The same over every shift that a seed hits."""
    found = 0
    for shift in range(-len(y) + 1, len(x)):
        same = [x[i] == y[i - shift] for i in range(max(0, shift), min(len(x), shift + len(y)))]
        hit = any(all(same[p + i] for i, bit in enumerate(m) if bit == "1") for m in d.MASKS for p in range(len(same) - len(m) + 1))
        found = max(found, longest_in(x, y, shift) if hit else 0)
    return found


@pytest.mark.parametrize("most", [d.BROADCAST_BYTES, 0])
def test_substituted_words_hide_no_overlap(spark, monkeypatch, most):
    import math

    monkeypatch.setattr(d, "BROADCAST_BYTES", most)
    r = random.Random(11)
    items = [prose(600 + i, n) for i, n in enumerate((15, 16, 15, 17, 24, 33, 40))]
    texts = [altered(items[0], (3,)), altered(items[1], (3,))]
    for i in range(140):
        item = items[i % len(items)]
        n = len(item.split())
        changed = altered(item, r.sample(range(n), r.randrange(n // 3)))
        texts.append(" ".join([prose(7000 + i, r.randrange(1, 9)), changed, prose(8000 + i, r.randrange(1, 9))]) if i % 3 else changed)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            n = longest_similar(text.split(), item.split())
            if n >= min(d.MIN_WORDS, math.ceil(len(item.split()) * d.IDENTITY)):
                want.add((i, k, n))
    rows = d.overlaps(table, bench(spark, items)).collect()
    assert {(x["doc_id"], x["item_id"], x["matches"]) for x in rows} == want and {(0, 0, 14), (1, 1, 15)} <= want
    for x in rows:
        a = texts[x["doc_id"]].split()[x["doc_start"] :][: x["length"]]
        b = items[x["item_id"]].split()[x["item_start"] :][: x["length"]]
        assert sum(u == v for u, v in zip(a, b, strict=True)) == x["matches"] and 5 * x["matches"] >= 4 * x["length"] and a[0] == b[0] and a[-1] == b[-1]
