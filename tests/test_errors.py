"""Programs that are rejected, and why."""

import pytest

from deltarule import Program, RuleError, default_pipeline
from deltarule.pipeline import PLAN_RULE, Pipeline

R = "relation a(i32); relation b(i32, i32); relation o(i32); "
BAD = {
    "declared twice": "relation a(i32); relation a(i32);",
    "not declared": R + "o(x) :- zzz(x);",
    "has 1 columns": R + "o(x) :- a(x, x);",
    "output names": "#![output(nothing)] " + R,
    "more than one output": "#![output(a)] #![output(b)] " + R,
    "unknown program attribute": "#![fast] " + R,
    "negation of o": R + "o(x) :- a(x), !o(x);",
    "has no head": R + ":- a(1);",
    "has no body": R + "o(x) :- ;",
    "must begin": R + "o(1) :- if 1 = 1;",
    "must begin with": R + "o(1) :- !a(1);",
    "is not bound in negated": R + "o(x) :- a(x), !b(x, y);",
    "is bound already": R + "o(x) :- a(x), let x = 1;",
    "x is bound already": R + "o(x) :- a(x), for x in 0..3;",
    "m is bound already": R + "o(m) :- a(m), agg m = min(y) in b(m, y);",
    "unsupported aggregate": R + "o(m) :- agg m = median(x) in a(x);",
    "count takes no argument": R + "o(x) :- a(x), agg m = count(y) in b(x, y);",
    "exactly one argument": R + "o(x) :- a(x), agg m = sum() in b(x, _);",
    "is not bound in aggregate": R + "o(x) :- a(x), agg m = sum(z) in b(x, _);",
    "unsupported binding pattern": R + "o(x) :- a(x), let 1 + y = x;",
    "_ in the head": R + "o(_) :- a(x);",
    "is not bound in head": R + "o(y) :- a(x);",
    "is not bound in condition": R + "o(x) :- a(x), if z > 1;",
    "unknown type": "relation a(what is this);",
    "not closed": R + "o(x :- a(x);",
    "no type is given": "struct P<N>; relation a(N);",
}


@pytest.mark.parametrize("why", BAD)
def test_rejected(why):
    with pytest.raises(RuleError, match=why):
        Program.parse(BAD[why])


def test_recursive_aggregates_are_limited(spark):
    for text in (
        R + "o(x) :- a(x); o(m) :- o(x), agg m = sum(y) in b(x, y);",
        R + "o(x) :- a(x); o(y) :- o(x), b(x, y); o(m) :- o(x), agg m = min(y) in b(x, y);",
    ):
        with pytest.raises(RuleError):
            Program.parse(text).run(spark, {"a": [(1,)], "b": [(1, 2)]})


def test_order_must_be_a_permutation():
    program = Program().relation("a", "i32").relation("o", "i32").rule("o(x)", "a(x)", order=[1])
    with pytest.raises(RuleError, match="permutation"):
        program.resolve()


def test_pipeline_hooks(spark):
    seen = []

    class Watch:
        def install(self, pipeline):
            pipeline.around(PLAN_RULE, lambda rule, go: (seen.append(rule.heads[0].relation), go(rule))[1])

    pipeline = default_pipeline().install(Watch())
    renamed = pipeline.insert_after("read", lambda tree: tree)
    found = Program.parse("relation a(i32); relation o(i32); a(1); o(x) :- a(x);", pipeline=renamed).run(spark)
    assert [tuple(r) for r in found["o"].collect()] == [(1,)] and "o" in seen
    with pytest.raises(RuleError, match="two terminal"):
        pipeline.implement(PLAN_RULE, print)
    with pytest.raises(RuleError, match="no terminal"):
        Pipeline().perform(PLAN_RULE, None)
    twice = default_pipeline().around(PLAN_RULE, lambda rule, go: (go(rule), go(rule)))
    with pytest.raises(RuleError, match="called twice"):
        Program.parse("relation a(i32); relation o(i32); o(x) :- a(x);", pipeline=twice)


def test_regions_follow_rules():
    text = "relation e(i32, i32); relation p(i32, i32); relation u(i32); p(x, y) :- e(x, y); p(x, z) :- p(x, y), e(y, z); u(x) :- e(x, _), !p(x, x);"
    regions = Program.parse(text).resolve().regions
    assert [(r.heads(), r.recursive) for r in regions] == [(["p"], False), (["p"], True), (["u"], False)]
