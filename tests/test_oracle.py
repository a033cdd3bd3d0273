"""Every catalog query against its SQL oracle (smallest tables by default;
set NEO_ORACLE_SF=/root/testdata/sf0.1 to run the same check at a larger scale)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL as _DEFAULT
from tools.check_oracle import TABLES, compare

SF_SMALL = os.environ.get("NEO_ORACLE_SF", _DEFAULT)

ORACLE = E.oracle_sql()
QUERIES = E.queries()
SLOW = {"m6_train_classifier", "m8_score_model", "m9_save_load", "q6_train"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert compare(got, want) == "OK"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_every_query_has_an_entry():
    assert len(QUERIES) >= 90 and set(ORACLE) <= set(QUERIES)
