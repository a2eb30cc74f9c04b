"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import compare, duck
from millrace.catalog import load_all

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = load_all()
SLOW = {"text_baseline_cv"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    status, note, _ = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLE.get(name))
    assert status in ("ok", "rows-only"), note


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
