"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import pytest

from matchweave import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([[plain(r[c]) for c in columns] for r in df.collect()], key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == columns
    want = sorted([[plain(r[names.index(c)]) for c in columns] for r in rel.fetchall()], key=str)
    assert rows == want


def test_text_queries_read_the_documents(spark, tmp_path):
    said = "filler words in a row " * 2000
    rows = [(10, said + "\nSenior data engineer in Chicago, salary of $150k, knows Kubernetes\nend"), (19, None), (29, said)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: registry.queries()[n](spark, str(tmp_path)).collect() for n in ("query_keywords", "skill_categories", "marketability", "resume_entries")}
    words = {r["doc_id"]: r for r in got["query_keywords"]}
    assert set(words) == {10, 19, 29} and words[10]["low"] == 150_000 and "Chicago" in words[10]["places"] and "data engineer" in words[10]["titles"]
    assert words[19].asDict() | {"doc_id": 29} == words[29].asDict()
    assert any(r["doc_id"] == 10 and "kubernetes" in r["skills"].split("|") for r in got["skill_categories"])
    scores = {r["doc_id"]: r["technical"] + r["categories"] for r in got["marketability"]}
    assert set(scores) == {10, 19, 29} and scores[10] > scores[19] == scores[29]
    assert any(r["resume_id"] == 10 and r["title"] and "Senior data engineer in Chicago" in r["title"] for r in got["resume_entries"])
