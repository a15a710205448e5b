"""Every registered query against its DuckDB SQL on the small tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chromalyne.plans import inputs, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in names:
        if a[c].dtype.kind in "fiu" and b[c].dtype.kind in "fiu":
            assert np.array_equal(a[c].to_numpy(), b[c].to_numpy(), equal_nan=a[c].dtype.kind == "f"), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_query(spark, db, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir).toPandas(), db.execute(registry.ORACLES[name]).df())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and sum(r["size"] or 0 for r in rows) > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_points_are_ranked_in_the_shuffle_that_ranges_them(spark, tmp_path):
    items = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").limit(5000)
    none = items.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in items.dtypes])
    items.union(items.limit(700)).union(none).repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = inputs.px3(spark, str(tmp_path))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # on reading, nothing is sorted again
    px = inputs.PX3.replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'").replace("order by l_orderkey,", "order by l_orderkey nulls first,")
    want = sorted(duckdb.sql(f"with {px} select idx, c0, c1, c2 from px").fetchall())
    assert sorted(tuple(r) for r in got.collect()) == want and [r[0] for r in want] == list(range(5701))



def test_points_of_no_items(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(0).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert inputs.px3(spark, str(tmp_path)).count() == 0
