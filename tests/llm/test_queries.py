"""Operator queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from sqlcorpus.llm.queries import LLM_ORACLES, LLM_QUERIES

from ..conftest import SF_SMALL
from ..test_queries import duck, table  # noqa: F401


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    df = LLM_QUERIES[name](spark, SF_SMALL)
    answer = duck.execute(LLM_ORACLES[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in answer.description], answer.fetchall())


def test_registered():
    assert {*LLM_QUERIES, "pipeline"} <= set(entry_point.queries()) and set(LLM_ORACLES) <= set(entry_point.oracle_sql())
