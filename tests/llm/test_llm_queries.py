import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sql_compare import FOLDER, assert_same, have_data  # noqa: E402

from viewloom.llm.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not have_data(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert len(rows) == len(set(map(str, rows)))
    if name == "p8_roundtrip":
        assert rows[0].n_differ == 0
