"""Every query of the core, against its SQL where it has some."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from brute import BRUTE  # noqa: E402
from compare import connect, norm, same  # noqa: E402

from strataforge.plans import catalogue  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    if name in catalogue.SQL:
        same(df, con, catalogue.SQL[name])
    else:
        cols = list(df.columns)
        got = sorted((norm(tuple(r)) for r in df.collect()), key=repr)
        want = sorted((norm(tuple(r[c] for c in cols)) for r in BRUTE[name](con)), key=repr)
        assert got == want and got


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and e.entry(spark).columns == ["unit_id", "name", "score", "second"]


def test_plans_prune_and_push(spark):
    """The scan of a query reads only its columns, and gets the filter."""
    plan = catalogue.QUERIES["card_concepts"](spark, D)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(doc_kind), EqualTo(doc_kind,demand_card)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,doc_kind:string>" in plan


@pytest.mark.parametrize("name", ["classify_scored", "prefix_assign", "fuzzy_pairs", "phrase_rank"])
def test_no_cross_joins(spark, name):
    plan = catalogue.QUERIES[name](spark, D)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
