import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalyne.llm import near_dedup as n
from chromalyne.llm.components import components
from helpers import awkward, none, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        out[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def expected(rows, p):
    sets = sets_of([r for r in rows if r[0] is not None], p.words)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and p.denominator * len(a & b) >= p.numerator * len(a | b):
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: (len(sets[i]), root(i)) for i in ids}


def altered(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{seed}x{i}" if r.random() < share else w for i, w in enumerate(text.split()))


def corpus(members):
    """A group around one text whose alterations range from none to far beyond the threshold, chains, copies, loners."""
    rows, base = [], prose(1, 150)
    for i in range(members):
        rows.append((1000 - i, altered(base, 0.07 * i / members, i)))
    chain = prose(2, 120).split()
    for i in range(8):
        chain = chain[3:] + [f"c{i}", f"d{i}", f"e{i}"]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, prose(3, 40).upper() if i % 2 else prose(3, 40)) for i in range(20)]
    rows += [(4000 + i, prose(50 + i, 30 + i)) for i in range(30)]
    rows += [(5000, "a b"), (5001, "A\tb"), (5002, "a"), (5003, "b a")]
    return rows


@pytest.mark.parametrize("p", [n.NearParams(3, 85, 100, block=16), n.NearParams(5, 80, 100), n.NearParams(3, 85, 100, rows=2, large=10, block=4)])
def test_matches_brute_force(spark, p):
    rows = corpus(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.near_duplicates(docs, p).collect()}
    assert got == expected(rows, p)


def test_awkward_rows(spark):
    table, p = awkward(spark), n.NearParams(3, 85, 100)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = expected(rows, p)
    got = n.near_duplicates(table, p).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert n.near_duplicates(none(spark), p).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    p = n.NearParams(3, 85, 100)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**15, (4000, p.hashes), dtype=np.uint16)
    other = np.where(rng.random(base.shape) < p.threshold, base, base + 1)
    assert len(n.surviving(base, other, p)) >= 3998
    far = np.where(rng.random(base.shape) < 0.4, base, base + 1)
    assert len(n.surviving(base, far, p)) == 0
    assert n.surviving(base[:1], base[:1], p).tolist() == [0]


def test_links_are_of_words_not_hashes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(n, "shingle_hashes", lambda words, k: np.ones(max(0, len(words) - k + 1), np.uint64))
    rows = [(1, 0, None, prose(1, 30)), (1, 1, 2, prose(2, 30)), (1, 1, 3, prose(1, 30))]
    batch = pa.RecordBatch.from_pylist([dict(zip(("a", "kind", "b", "text"), r)) for r in rows])
    out = pa.Table.from_batches(n._confirm(n.NearParams(3, 85, 100), False)(iter([batch]))).to_pylist()
    assert [(r["b"], r["linked"]) for r in out] == [(2, False), (3, True)]


def test_words_that_polynomials_confuse_are_different(spark):
    from test_fingerprint_index import thue_morse

    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, f"{a} x {a} y"), (2, f"{b} x {b} y"), (3, a), (4, b), (5, f"{a} {a} {a} {b} {b} {b}")]
    p = n.NearParams(3, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert got == expected(rows, p) and got[2] == (2, 2) and got[5] == (4, 5)


def test_hot_buckets_are_few(spark):
    reps = spark.createDataFrame([], "rep long, sig binary")
    search = n._Search(spark.createDataFrame([], "doc_id long, text string"), reps, n.NearParams())
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 700 + 10).alias("bucket"), F.col("id").alias("rep"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    found = search.with_buckets(rows, counts, 3000)
    assert found.count() == 3000 and found.where("bucket = 7 and n = 1000").count() == 1000 and found.where("n > 1000").count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate([a[:600], np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))])
    s = n.signatures([a, b], 512)
    assert (s[0] == s[1]).mean() == pytest.approx(600 / (len(a) + len(b) - 600), abs=0.08)
    shares = []
    for i in range(300):  # independent enough: matches spread like draws
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        s = n.signatures([x[:360], x[40:]], 128)
        shares.append((s[0] == s[1]).sum())
    assert np.mean(shares) == pytest.approx(128 * 0.8, abs=1) and np.std(shares) == pytest.approx((128 * 0.8 * 0.2) ** 0.5, rel=0.15)


def test_recall_on_a_larger_table(spark):
    """All links of the brute force in SQL, over the 1,000 documents of sf0.01."""
    import duckdb

    from chromalyne.llm import oracles, queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = dict(con.execute(f"select doc_id, component_id from ({oracles.OP7})").fetchall())
    got = {r["doc_id"]: r["component_id"] for r in queries.op7_bayes_minhash(spark, "/root/testdata/sf0.01").collect()}
    linked = [i for i, c in want.items() if c != i]
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.999 and all(got[i] == i for i, c in want.items() if c == i)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(1000, j) for j in range(1001, 1100)] + [(5, 5), (None, 4)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0
