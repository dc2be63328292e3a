"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import ROOT, compare, connect

SF = f"{ROOT}/sf0.001"
QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    plans = []

    def build(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    verdict, _, _, _ = compare(spark, con, build, SQLS.get(name), SF)
    assert verdict in ("ok", "rows-only")
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert {"sample_id", "pgs_id", "score_sum", "match_rate_value", "status"} <= set(rows.columns)
