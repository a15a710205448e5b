"""The pipeline on a small corpus, each stage against a plain computation on its own input."""

import pytest

import corpus_pipeline as c
from chromalyne.llm import packing
from helpers import awkward, none, prose
from test_fingerprint_index import WORD
from test_near_dedup import altered
from test_near_dedup import expected as near_expected
from test_packing import PATH, check
from test_toxicity import corpus as toxic_corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    toxic = toxic_corpus(200)
    rows = [(i, t) for i, t, _ in toxic]
    rows += [(1000 + i, altered(prose(3000, 120), 0.004 * i, i)) for i in range(12)]
    passage = prose(4000, 70)
    rows += [(2000 + i, f"{prose(5000 + i, 90)} {passage} {prose(6000 + i, 90)}") for i in range(6)]
    rows += [(3000, prose(7000, 40) + " " + prose(8000, 30) + " " + prose(7001, 40)), (3001, None), (3002, ""), (None, prose(9100, 20))]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, prose(8000, 30)), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {}
    for name, stage in c.STAGES[:-1]:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = c.written(out, name)
        rows[name] = (before, {r["doc_id"]: r.asDict() for r in docs.collect()})
    before, after = rows["toxicity"]
    assert set(before) - set(after) == {i for i in range(200) if i % 4 == 0} and all(before[i] == after[i] for i in after)
    before, after = rows["near_duplicates"]
    want = near_expected([(i, r["text"]) for i, r in before.items()], c.NEAR)
    assert set(after) == {None} | {i for i, (_, root) in want.items() if root == i}
    before, after = rows["substring_dedup"]
    assert set(before) == set(after)
    passage = WORD.findall(prose(4000, 70).encode())
    for i in range(1, 6):
        words = WORD.findall(after[2000 + i]["text"].encode())
        assert not set(zip(*(passage[k:] for k in range(13)))) & set(zip(*(words[k:] for k in range(13)))) and len(words) == 180
        assert after[2000 + i]["n_chars"] == len(after[2000 + i]["text"])
    assert after[2000] == before[2000]
    before, after = rows["decontamination"]
    assert set(before) - set(after) == {3000}


def test_run_packs_what_is_left(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        docs = c.written(stage(spark, docs, folder), name)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(c.run(spark, folder).collect(), texts, lambda x: t.encode(x, add_special_tokens=False).ids, 2048)


def test_stages_take_awkward_rows_and_names(spark, folder):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    table = awkward(spark)
    for name, stage in c.STAGES[:-1]:
        out = c.written(stage(spark, table, folder), name)
        assert out.columns == table.columns and out.dtypes == table.dtypes
        gone = table.select("doc_id").exceptAll(out.select("doc_id")).collect()
        assert {r["doc_id"] for r in gone} == ({1, 7} if name == "near_duplicates" else set())
        if name != "substring_dedup":
            assert out.exceptAll(table).count() == 0
        table = out
    assert c.STAGES[-1][1](spark, table, folder).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_stages_take_empty_tables(spark, folder):
    empty = none(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in c.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert packing.pack_documents(empty, PATH).count() == 0
