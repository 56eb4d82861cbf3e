"""Every query that has SQL against that SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from skein.plans.every_query import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    return sorted(tuple(str(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_trace_sample(spark, sf_dir):
    kept = QUERIES["trace_sample"](spark, sf_dir).toPandas()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas()
    share = kept.user_id.nunique() / events.user_id.nunique()
    assert 0 < share < 0.3
    # all events of a kept trace are there
    assert len(kept) == events.user_id.isin(kept.user_id).sum()
