import itertools
import math
import os

import numpy as np
import pyarrow as pa
import pytest

from chromalyne.llm import toxicity
from chromalyne.llm.common import Words, crc_rest
from helpers import awkward, none, prose

BAD = ["vilkro", "grolmash", "snurf"]


def corpus(n=400):
    rows = []
    for i in range(n):
        words = prose(i, 60).split()
        bad = i % 4 == 0
        if bad:
            for j in range(3):
                words[5 + 11 * j] = BAD[(i // 4 + j) % 3] + ("" if j else "ing")
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.learn(docs, labels)


def test_held_out_documents(spark, trained):
    docs, labels, tagger = trained
    rows = toxicity.tag_toxicity(docs, tagger).join(labels, "doc_id").where(crc_rest("doc_id", 3) == 1).collect()
    assert len(rows) > 80 and all((r["score"] >= 0.7) == (r["toxic"] == 1) for r in rows)


def test_spans_are_the_words(spark, trained):
    docs, _, tagger = trained
    r = toxicity.tag_toxicity(docs.where("doc_id = 4"), tagger).first()
    raw = docs.where("doc_id = 4").first()["text"].encode()
    found = [raw[s["start"] : s["end"]].decode() for s in r["spans"]]
    assert len(found) == 3 and all(any(b in w for b in BAD) for w in found)


def exact(u, start, trans):
    """Marginals by summing over all labellings."""
    p, z = np.zeros(len(u)), 0.0
    for y in itertools.product((0, 1), repeat=len(u)):
        s = sum(a for a, b in zip(u, y) if b) + (start if y[0] else 0) + sum(trans[a][b] for a, b in zip(y, y[1:]))
        z += math.exp(s)
        p += math.exp(s) * np.array(y)
    return p / z


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 7, 0, 10, 3])
    first = np.concatenate([[0], np.cumsum(counts)])
    u = rng.normal(0, 2, counts.sum())
    trans = np.array([[0.3, -1.0], [0.2, 1.5]])
    got = toxicity.marginals(u, first, counts, -0.7, trans)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert got[a:b] == pytest.approx(exact(u[a:b], -0.7, trans), abs=1e-9)


def test_chunks_make_no_difference(monkeypatch):
    rng = np.random.default_rng(1)
    counts = np.array([3000, 5])
    first = np.concatenate([[0], np.cumsum(counts)])
    u, trans = rng.normal(0, 1, counts.sum()), np.array([[0.0, -2.0], [-1.0, 1.0]])
    whole = toxicity._messages(np.exp(u[:3000])[:, None], np.ones((3000, 1), bool), 0.4, np.exp(trans))[0][:, 0]
    assert toxicity.marginals(u, first, counts, 0.4, trans)[:3000] == pytest.approx(whole, abs=1e-8)
    monkeypatch.setattr(toxicity, "CHUNK", 17)
    assert toxicity.marginals(u, first, counts, 0.4, trans)[:3000] == pytest.approx(whole, abs=1e-8)


@pytest.mark.parametrize("strength", [4.0, 40.0, 400.0])
def test_strong_transitions_are_exact_too(monkeypatch, strength):
    rng = np.random.default_rng(2)
    counts = np.array([2500, 0, 40])
    first = np.concatenate([[0], np.cumsum(counts)])
    u, trans = rng.normal(0, 1, counts.sum()), np.array([[strength / 2, -strength / 2], [-strength / 2, strength / 2]])
    trans -= trans[0, 0]
    whole = toxicity._messages(np.exp(u[:2500])[:, None], np.ones((2500, 1), bool), 0.4, np.exp(trans))[0][:, 0]
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    assert toxicity.marginals(u, first, counts, 0.4, trans)[:2500] == pytest.approx(whole, abs=1e-7)


def test_expected_transitions_match_enumeration():
    rng = np.random.default_rng(3)
    u, start, trans = rng.normal(0, 1, 6), 0.3, np.array([[0.2, -0.4], [0.1, 0.9]])
    want, z = np.zeros((2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=6):
        s = math.exp(sum(a for a, b in zip(u, y) if b) + (start if y[0] else 0) + sum(trans[a][b] for a, b in zip(y, y[1:])))
        z += s
        for a, b in zip(y, y[1:]):
            want[a, b] += s
    p, pairs = toxicity._messages(np.exp(u)[:, None], np.ones((6, 1), bool), start, np.exp(trans))
    assert pairs == pytest.approx(want / z) and p[:, 0] == pytest.approx(exact(u, start, trans))


def test_labels_of_tokens_leave_context_alone():
    rows = corpus(120)
    words = Words(pa.array([r[1] for r in rows], pa.large_string()), lower=True)
    toxic = np.array([r[2] == 1 for r in rows])
    marks = toxicity.label_tokens(toxicity.features(words), words.row_of(), toxic, np.ones(len(rows), bool))
    assert marks.sum() == 3 * toxic.sum()


def test_awkward_rows(spark, trained):
    _, _, tagger = trained
    table = awkward(spark)
    rows = toxicity.tag_toxicity(table, tagger).collect()
    assert len(rows) == table.count() and all(0 <= r["score"] < 0.7 and not r["spans"] for r in rows)
    assert toxicity.tag_toxicity(none(spark), tagger).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, None, 0), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.tag_toxicity(docs, toxicity.learn(docs, labels)).first()["score"] < 0.1


def test_rare_words_of_a_large_sample_are_learnt_outside_the_driver(spark, monkeypatch):
    real, driver = toxicity.train, os.getpid()

    def elsewhere(*given):
        assert os.getpid() != driver
        return real(*given)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    rows = []
    for i in range(7200):
        words = prose(20_000 + i, 45).split()
        if i % 2:
            words[7] = "quorvex" if i % 180 == 1 else BAD[i % 3]
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    tagger = toxicity.learn(docs, labels)
    found = toxicity.tag_toxicity(docs.where("text like '%quorvex%'"), tagger).collect()
    assert len(found) == 40 and all(r["n_toxic_words"] == 1 for r in found)
