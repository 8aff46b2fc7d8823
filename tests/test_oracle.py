"""Every query against its SQL."""

import pytest

from sortline.queries import QUERIES, SQL

from .compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con.sql(SQL[name]))


def test_scans_read_what_they_need(spark, sf):
    df = QUERIES["feedback_totals"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    reads = [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]
    assert reads and not any(c in r for r in reads for c in ("l_quantity", "l_tax", "l_discount", "o_totalprice", "o_orderpriority"))


def test_entry_is_complete(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
