"""Every query of the library against its SQL on the smallest test tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

from weftgraph import plans

DATA = os.environ.get("WEFTGRAPH_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(columns: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    found = plans.queries()[name](spark, DATA)
    relation = duck.sql(plans.oracle_sql()[name])
    assert sorted(found.columns) == sorted(relation.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0
