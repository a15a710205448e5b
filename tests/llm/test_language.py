import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chromalyne.llm import language
from chromalyne.llm.common import crc_rest
from helpers import awkward, none

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["éau", "oux", "lle", "que"]}


def text(lang, seed, n=40):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang], r.integers(2, 4))) for _ in range(n))


def corpus(spark, n=300):
    rows = [(i, text(lang := ["aa", "bb", "cc"][i % 3], i), lang) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = language.learn(docs)
    rows = language.identify(docs, model).join(docs, "doc_id").withColumn("held", crc_rest("doc_id", 5) == 0).where("held").collect()
    assert len(rows) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_other_columns_are_no_inputs(spark):
    docs = corpus(spark, 60)
    model = language.learn(docs)
    turned = docs.selectExpr("doc_id", "text", "'cc' as lang")
    a, b = (sorted(map(tuple, language.identify(x, model).collect())) for x in (docs, turned))
    assert a == b


def test_averages_match_a_plain_loop():
    model = language.train([text("aa", 1), text("bb", 2), text("cc", 3), text("aa", 4)], ["aa", "bb", "cc", "aa"], np.array([False, False, False, True]), epochs=3)
    texts = ["", text("bb", 9), None, "Ka TO!! 12 mi", text("cc", 5)]
    got, shares = model.predict(pa.array(texts, pa.string()))
    for t, p in zip(texts, got):
        slots, _ = language.subwords(pa.array([t or ""], pa.large_string()))
        flat = np.concatenate(slots)
        flat = flat[flat >= 0]
        z = (model.scores[flat].astype(float).mean(0) if len(flat) else 0) + model.bias
        e = np.exp((z - z.max()) / model.temperature)
        assert p == pytest.approx(e / e.sum(), abs=1e-6)
    assert shares[0] == 0 and (shares <= 1).all()


def test_awkward_rows(spark):
    model = language.learn(corpus(spark, 90))
    table = awkward(spark)
    rows = language.identify(table, model).collect()
    assert len(rows) == table.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i in (2, 3, 4, 9):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"]
    assert by[0]["lang_pred"] in ("aa", "bb", "cc") and by[0][1:] == by[1][1:] and by[10]["rejected"]
    assert language.identify(none(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = language.learn(none(spark))
    assert {r["lang_pred"] for r in language.identify(awkward(spark), model).collect()} == {"und"}


def test_scores_are_calibrated_and_foreign_texts_rejected(spark):
    """aa and bb are learned, cc is held back; the mean score of held-out texts is their accuracy to 2 %."""
    docs = corpus(spark, 900).where("lang != 'cc'")
    model = language.learn(docs)
    own = language.identify(docs.where(crc_rest("doc_id", 5) == 0), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in own])
    assert abs(np.mean([r["score"] for r in own]) - right) < 0.02 and 1e-3 < model.temperature < 1e3
    assert np.mean([r["rejected"] for r in own]) < 0.03
    foreign = [text("cc", 5000 + i) for i in range(100)] + ["これは日本語の文章です。" * 4] * 10 + ["Это текст на русском языке. " * 3] * 10 + ["zzzzqqqq xxkk"] * 5
    frame = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    assert np.mean([r["rejected"] for r in language.identify(frame, model).collect()]) > 0.98


def test_temperature_meets_the_accuracy():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = rng.normal(0, 1, (500, 3)) * 9
    logits[np.arange(450), y[:450]] += 20
    t = language.temperature_for(logits, y)
    assert language.softmax(logits, t).max(1).mean() == pytest.approx(((logits.argmax(1) == y).sum() + 1) / 502, abs=1e-6)
    sure = np.eye(2)[y[:100] % 2] * 50
    assert language.softmax(sure, language.temperature_for(sure, y[:100] % 2)).max(1).mean() == pytest.approx(101 / 102)


def test_no_more_languages_than_allowed(spark):
    rare = corpus(spark, 9).withColumn("lang", F.concat("lang", "doc_id"))
    found = language.learn(corpus(spark, 90).unionByName(rare), most_languages=2).languages
    assert len(found) == 2 and set(found) < {"aa", "bb", "cc"}
