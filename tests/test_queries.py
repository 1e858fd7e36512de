"""Every query next to its SQL on the smallest tables; queries without SQL give a stable, repeatable result."""

import math

import duckdb
import pytest

from tests.conftest import SMALL
from turnloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 5) + 0.0)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else repr(value)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, database, name):
    df = plans.QUERIES[name](spark, SMALL)
    cursor = database.execute(plans.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(_plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    assert sorted(tuple(_plain(row[c]) for c in order) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_repeats(spark, name):
    one, two = (sorted(map(repr, plans.QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert one == two and one
