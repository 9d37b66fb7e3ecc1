import math

import duckdb
import pytest

from reportlake.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "conversations", "labels", "benchmark")


def plain(rows):
    def one(value):
        return float(f"{value:.9g}") if isinstance(value, float) and not math.isnan(value) else value

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = connection.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert plain(found.select(*columns).collect()) == plain(want.fetchall())


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
