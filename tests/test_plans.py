"""Shapes of plans: duplicates of an input are removed once, with the columns that are kept."""

import pytest

from deltarule.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def only_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name, exchanges", [("semi", 3), ("join2", 3), ("join3", 5), ("scan_project_distinct", 1)])
def test_exchanges(spark, only_shuffles, name, exchanges):
    """Two for each join and one for the rows that the rule returns, at most."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= exchanges, plan


def test_duplicates_of_an_input_do_not_count(spark):
    from deltarule import Program

    text = """relation e(i32, i32); relation k(i32, i32); relation n(i32, i64); relation o(i32, i32); relation all(i32, i32); relation p(i32, i32);
    n(x, c) :- k(x, _), agg c = count() in e(x, _); o(x, y) :- k(x, _), e(x, y); all(x, y) :- e(x, y); p(x, y) :- e(x, y); p(x, z) :- p(x, y), e(y, z);"""
    found = Program.parse(text).run(spark, {"e": [(1, 2), (1, 2), (2, 3), (1, 3)], "k": [(1, 0), (1, 0), (1, 1)]})
    rows = {n: sorted(tuple(r) for r in f.collect()) for n, f in found.items()}
    assert rows["n"] == [(1, 2)] and rows["o"] == [(1, 2), (1, 3)] and rows["all"] == [(1, 2), (1, 3), (2, 3)] and rows["p"] == [(1, 2), (1, 3), (2, 3)]
