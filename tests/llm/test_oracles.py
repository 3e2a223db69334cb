"""The operators' queries against DuckDB."""

import pytest

from speechreport.llm.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])
