"""Every query of the package against its SQL in DuckDB, at the smallest size."""

import math
import os

import duckdb
import pytest

from lodestrata.plans import object_extra, object_queries, queries, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    result = duck.execute(registry.SQL[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    assert ours == sorted((tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall()), key=repr)


def test_union_in_every_document(spark, tmp_path):
    texts = ["a Union b", "é\u00a0union\u00e9", "reunion", "union_1", None, ""]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["de", None, "en", "fr", "en", None]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["has_union"] for r in queries.union_in_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: None, 5: False}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
