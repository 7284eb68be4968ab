"""The registry itself, and a few queries next to their SQL on the smallest tables."""

import os

import pytest

import compare
from tidewatch.plans.catalog import load

SMALL = "/root/testdata/sf0.001"
QUICK = ["windows_hosts", "windows_size_entropy", "flows_cleaned", "label_transfer", "eval_binary_scores", "flows_simple", "scan_statistics"]


def test_every_sql_text_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    queries, oracles = load()
    con = compare.connect(SMALL)
    assert compare.differences(queries[name](spark, SMALL).toPandas(), con.execute(oracles[name]).fetchdf()) is None
