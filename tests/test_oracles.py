"""Every query with an SQL text gives the same rows as that text on the small tables."""

import duckdb
import pytest

from cohortwise.plans import ORACLES, QUERIES
from cohortwise.plans.prepare import TABLES


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)
