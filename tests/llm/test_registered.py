"""Registered queries on the smallest tables; those with SQL as another engine has them."""

import pytest

from weirlog.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(name, spark, sf):
    table = "embeddings" if name.startswith("op6") else "documents"
    assert queries.QUERIES[name](spark, sf).count() > 0 and spark.read.parquet(f"{sf}/{table}.parquet").count() > 0
