"""Every query with a check in SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tempora import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 4) + 0.0
        return x if x is None or isinstance(x, bool | int | str) else str(x)

    return sorted((tuple(float(y) if isinstance(y, int) and not isinstance(y, bool) else y for y in map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_duckdb(spark, db, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = _plain(found.select(*columns).collect())
    result = db.execute(catalog.ORACLE_SQL[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = _plain([tuple(r[i] for i in order) for r in result.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-4)), (a, b)


NO_SQL = sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL))


@pytest.mark.parametrize("name", NO_SQL)
def test_rows_do_not_hang_on_the_layout(spark, name):
    """A query without SQL gives rows, and the same ones however its tables are dealt out."""

    def rows():
        return sorted(str([round(x, 5) if isinstance(x, float) else x for x in r]) for r in catalog.QUERIES[name](spark, SF).collect())

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    first = rows()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert rows() == first and first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
