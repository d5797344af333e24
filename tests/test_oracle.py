"""Registered queries beside their checking SQL at the smallest scale.

Iterative fits are left to ``python -m tests.compare`` unless ALL_QUERIES is set.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: Fits without SQL; tests of their operators recompute what they return.
SLOW = {"cv_repeated", "clf_gbm", "topic_grid", "topic_select", "topic_bound", "topic_beta_tidy", "topic_gamma_tidy"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", [k for k in QUERIES if os.environ.get("ALL_QUERIES") or k not in SLOW])
def test_query_equals_sql(spark, con, key):
    assert compare(spark, con, key, QUERIES[key], SQL.get(key), FOLDER) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "logratio"]
