"""Corpus queries that have SQL against DuckDB."""

import duckdb
import pytest

from lumenrv.llm import queries as corpus

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(corpus.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = corpus.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_there_is_one_query_for_each_operator():
    found = [k.split("_")[0] for k in corpus.queries()]
    assert sorted(found, key=lambda k: int(k[2:])) == [f"op{n}" for n in range(1, 14)]
