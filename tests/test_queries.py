"""Every rule query against its SQL at the smallest scale."""

import duckdb
import pytest

from deltarule.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query = QUERIES[name]
    found = query(spark, SF)
    result = duck.execute(query.sql)
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    tidy = lambda rows: sorted(tuple(round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert tidy(tuple(r[c] for c in names) for r in found.collect()) == tidy(result.fetchall())


def test_entry_has_sql_for_what_it_lists():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())
