"""The registered queries against their SQL, on the smallest tables where they are there."""

import os

import duckdb
import pytest

from lectern.llm.entry import oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


@pytest.mark.parametrize("name", oracle_sql())
def test_query(spark, name):
    got = queries()[name](spark, DATA).toPandas()
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert plain(got) == plain(want)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
