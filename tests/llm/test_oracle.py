"""The subpackage's queries against their SQL, and the native ones for Python in their plans."""

import re

import pytest

from sortline.llm.queries import QUERIES, SQL

from ..compare import assert_same, connect

NATIVE = ("op1_decontamination", "op4_sharding", "op5_secret_scan", "op9_perspective_rotation")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf).sql(SQL[name]))


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
