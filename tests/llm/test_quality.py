import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chromalyne.llm import quality
from chromalyne.llm.common import crc_rest
from helpers import awkward, none, prose


def junk(seed):
    r = np.random.default_rng(seed)
    return " ".join(f"{w}%%$" for w in prose(seed, int(r.integers(20, 60))).split())


def corpus(spark, n=400):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 20 + i % 50), f"h{i % 9}", i % 2, int(i % 4 != 0)) for i in range(n)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang int")
    return docs, spark.createDataFrame([(r[0], r[4], 0) for r in rows], "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    docs, labels = corpus(spark)
    found = quality.score_quality(docs, quality.learn(docs, labels), F.col("source"), F.col("lang"))
    rows = found.join(labels, "doc_id").where(crc_rest("doc_id", 3) == 1).collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def strength(groups, centre):
    n, mean = np.array([len(g) for g in groups]), np.array([np.mean(g) for g in groups])
    if len(groups) < 2 or n.sum() <= len(groups):
        return 10.0
    within = max(sum(((np.array(g) - m) ** 2).sum() for g, m in zip(groups, mean)) / (n.sum() - len(groups)), 1e-9)
    size = (n.sum() - (n**2).sum() / n.sum()) / (len(groups) - 1)
    tau = ((n * (mean - centre) ** 2).sum() / (len(groups) - 1) - within) / max(size, 1e-9)
    return min(max(within / tau, 1.0), 1e6) if tau > 0 else 1e6


def test_posteriors_match_a_plain_computation(spark):
    r = np.random.default_rng(2)
    rows = [(i, f"h{int(r.integers(6))}", f"p{int(r.integers(3))}") for i in range(300)] + [(300, None, None), (301, "h0", None), (302, "lonely", "p0")]
    level = {f"h{k}": 0.15 * k for k in range(6)}
    rows = [(*x, float(np.clip(level.get(x[1], 0.5) + r.normal(0, 0.1), 0.01, 0.99))) for x in rows]
    got = {x["doc_id"]: x for x in quality.site_quality(spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double")).collect()}
    p = {x[0]: x[3] for x in rows}
    m0 = np.mean(list(p.values()))
    hosts, paths = {}, {}
    for i, h, q, v in rows:
        hosts.setdefault(h, []).append(v)
        paths.setdefault((h, q), []).append(v)
    kh = strength(list(hosts.values()), m0)
    post = {h: (sum(v) + kh * m0) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength(list(paths.values()), np.array([post[h] for h, _ in paths]))
    logit = lambda x: math.log(x / (1 - x))
    for i, h, q, v in rows:
        own = paths[h, q]
        host_others = (sum(hosts[h]) - v + kh * m0) / (len(hosts[h]) - 1 + kh)
        others = (sum(own) - v + kp * host_others) / (len(own) - 1 + kp)
        want = 1 / (1 + math.exp(-(logit(v) + logit(others) - logit(m0))))
        assert got[i]["host_posterior"] == pytest.approx(post[h]) and got[i]["score"] == pytest.approx(want)
        assert got[i]["path_posterior"] == pytest.approx((sum(own) + kp * post[h]) / (len(own) + kp))
    assert abs(got[302]["host_posterior"] - m0) < abs(p[302] - m0)


def test_sparse_sites_shrink_and_full_ones_do_not(spark):
    rows = [(i, "big", "p", 0.9 if i % 10 else 0.5) for i in range(400)] + [(1000, "small", "p", 0.05)] + [(2000 + i, "mid", "p", 0.2) for i in range(50)]
    got = {r["host"]: r for r in quality.site_quality(spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double")).collect()}
    assert got["big"]["host_posterior"] == pytest.approx(0.86, abs=0.01) and got["small"]["host_posterior"] > 0.05


def test_a_lone_document_is_judged_by_its_own_evidence(spark):
    rows = [(i, f"h{i % 5}", "p", 0.2 + 0.15 * (i % 5)) for i in range(100)] + [(1000, "lonely", "p", 0.95), (1001, "pair", "a", 0.95), (1002, "pair", "b", 0.05)]
    got = {r["doc_id"]: r["score"] for r in quality.site_quality(spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double")).collect()}
    assert got[1000] == pytest.approx(0.95) and got[1001] < 0.95 and got[1002] > 0.05


def test_awkward_rows(spark):
    docs, labels = corpus(spark, 80)
    evidence, table = quality.learn(docs, labels), awkward(spark)
    rows = quality.score_quality(table, evidence, F.col("source"), F.col("lang")).collect()
    assert len(rows) == table.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(none(spark), evidence, F.col("source"), F.col("lang")).count() == 0
    blank = quality.learn(none(spark), labels)
    assert quality.score_quality(table, blank, F.col("source"), F.col("lang")).count() == table.count()


def test_features_are_finite_and_of_the_row_alone():
    texts = ["", None, "a", prose(1, 30), "x\ny\nx 12 !!", "é" * 50]
    both = quality.describe(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert both[i] == pytest.approx(quality.describe(pa.array([t], pa.string()))[0])
    assert np.isfinite(both).all()
