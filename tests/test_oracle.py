"""Every registered query with a SQL oracle matches DuckDB on the smallest fixture
(column names, row count, order-insensitive value digest)."""

import pytest

from tests.conftest import SF_SMALL
from tools.compare import digest, duck

import __spark_entry__ as entry_mod

ORACLES = entry_mod.oracle_sql()
QUERIES = entry_mod.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLES[name])
    dcols, drows = list(rel.columns), rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["entry", "counts", "prediction"]
    # R1 contract at sf0.001: 156 rows, counts sum to anchors x top
    assert len(rows) == 156
    assert sum(r["counts"] for r in rows) == 200
