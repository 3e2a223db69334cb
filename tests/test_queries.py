"""Every registered query against SQL, or for rows where SQL can't express it."""

import pytest

from speechreport.plans.registry import ORACLES, QUERIES
from tests.oracle import SF, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_works_without_optional_modules(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "OPTIONAL", ("speechreport.llm.nowhere",))
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert __spark_entry__.entry(spark).count() == 200
