"""Queries against their SQL on a small scale, as rows."""

import os

import pytest

from newsloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Those that compute on fixed rows or streams; the rest have tests of their own.
MODULES = ("newsloom.queries.fixed", "newsloom.queries.streams", "newsloom.queries.store")


def rows_of(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in ORACLES if QUERIES[n].module in MODULES))
def test_query_equals_its_sql(spark, sql, name):
    made = QUERIES[name](spark, SF)
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(made.columns)
    assert rows_of(made.select(*names).collect()) == rows_of(found.fetchall())
