"""Programs with small inputs and known results."""

import random
from decimal import Decimal

import pytest

from deltarule import Functions, Program, RuleError
from deltarule.programs import library
from tests.naive import evaluate


def run(spark, text, inputs=None, outputs=None, **more):
    results = Program.parse(text, **more).run(spark, inputs, outputs)
    return {k: sorted((tuple(r) for r in v.collect()), key=repr) for k, v in results.items()}


def one(spark, text, inputs=None, **more):
    found = run(spark, text, inputs, **more)
    return found[list(found)[-1]]


PARITY = [
    ("relation i(i32, i32); relation o(i32, i32); o(x, y) :- i(x, y), if x < y;", {"i": [(1, 2), (2, 2), (3, 1)]}, [(1, 2)]),
    ("relation i(i32, i32); relation o(i32); o(x) :- i(x, 10);", {"i": [(1, 10), (2, 11), (3, 10)]}, [(1,), (3,)]),
    ("relation i(i32, i32); relation o(i32, i32); o(x, y) :- i(x, y);", {"i": [(1, 2), (1, 2), (8, 13)]}, [(1, 2), (8, 13)]),
    ("relation o(i32); relation p(i32); o(1), o(2); p(x) :- o(x);", {}, [(1,), (2,)]),
    ("relation l(i32, i32); relation r(i32, i32); relation o(i32, i32); o(x, z) :- l(x, y), r(y, z);", {"l": [(1, 2), (2, 3), (3, 2)], "r": [(2, 7), (3, 8)]}, [(1, 7), (2, 8), (3, 7)]),
    ("relation i(i32); relation b(i32); relation o(i32); o(x) :- i(x), !b(x);", {"i": [(1,), (2,), (3,)], "b": [(2,)]}, [(1,), (3,)]),
    ("relation i(i32, i32); relation o(i32); o(x) :- i(x, _);", {"i": [(1, 10), (1, 20), (2, 30)]}, [(1,), (2,)]),
    ("relation i(i32, i32); relation o(i32); o(x) :- i(x, x);", {"i": [(1, 1), (1, 2), (2, 2)]}, [(1,), (2,)]),
    ("relation a(i32); relation b(i32); relation o(i32); o(x) :- a(x); o(x) :- b(x);", {"a": [(1,), (2,)], "b": [(2,), (3,)]}, [(1,), (2,), (3,)]),
    (library.REACH, {"edge": [(1, 2), (2, 3), (9, 8)], "source": [(1,)]}, [(1,), (2,), (3,)]),
]


@pytest.mark.parametrize("text, inputs, expected", PARITY)
def test_small_programs(spark, text, inputs, expected):
    assert one(spark, text, inputs) == expected


def test_dl_reader(spark):
    from deltarule.parser import parse_dl

    text = ".decl Edge(x: int32, y: int32)\n.input Edge(IO=\"file\")\n.decl Reach(x: int32)\n.output Reach\nReach(1).\nReach(y) :- Reach(x), Edge(x, y), y != 5.\n"
    found = Program(parse_dl(text)).run(spark, {"Edge": [(1, 2), (2, 5), (5, 6)]})
    assert sorted(r[0] for r in found["Reach"].collect()) == [1, 2]


def test_aggregates_and_chains(spark):
    found = run(spark, "relation n(i32); relation lo(i32); relation hi(i32); relation avg(i32); relation sum(i32); relation cnt(usize);"
                "lo(y) :- agg y = min(x) in n(x); hi(y) :- agg y = max(x) in n(x); avg(round(y)) :- agg y = mean(x) in n(x);"
                "sum(y) :- agg y = sum(x) in n(x); cnt(y) :- agg y = count() in n(_);", {"n": [(i,) for i in range(1, 6)]})  # fmt: skip
    assert found == {"lo": [(1,)], "hi": [(5,)], "avg": [(3,)], "sum": [(15,)], "cnt": [(5,)]}
    assert run(spark, "relation n(i32); relation s(i32); relation c(i64); s(y) :- agg y = sum(x) in n(x); c(y) :- agg y = count() in n(_);") == {"s": [], "c": []}
    # a direct sum counts each distinct value of a group once; a generic sum counts rows
    rows = {"r": [(1, 1, 5), (1, 2, 5), (1, 3, 7)], "g": [(1,), (2,)]}
    assert one(spark, "relation r(i32, i32, i32); relation o(i32, i32); o(g, m) :- agg m = sum(v) in r(g, _, v);", {"r": rows["r"]}) == [(1, 12)]
    assert one(spark, "relation g(i32); relation r(i32, i32, i32); relation o(i32, i32); o(g, m) :- g(g), agg m = sum(v) in r(g, _, v);", rows) == [(1, 17)]
    assert one(spark, "relation r(i32, i32, i32); relation o(i32, i32); o(g, m) :- agg m = mean(v) in r(g, _, v);", {"r": [(1, 1, -3), (1, 2, -4), (1, 3, -4)]}) == [(1, -3)]
    # constants and repeats in a source are filters
    assert one(spark, "relation g(i32); relation r(i32, i32, i32); relation o(i32, i64); o(g, m) :- g(g), agg m = count() in r(g, 2, _);", rows) == [(1, 1)]


def test_grouped_aggregate_and_means(spark):
    """Two means of one source for each group, over rows that one rule makes for both groups."""
    text = """relation season(i32); relation team(String); relation speed(String, i32, i32); relation typical(String, i32, i32);
    season(2020); team('red'); team('blue');
    speed('red', d, d * 3), speed('blue', d * 2, 40 - d) :- season(_), for d in 0..21;
    typical(t, round(a), round(b)) :- team(t), agg a = mean(x) in speed(t, x, _), agg b = mean(y) in speed(t, _, y);"""
    assert run(spark, text)["typical"] == [("blue", 20, 30), ("red", 10, 30)]


def test_rank_by_counting(spark):
    text = """relation v(i32, i32); relation le(i32, i32, i32); relation rank(i32, i32, usize);
    le(g, a, b) :- v(g, a), v(g, b), if b <= a; rank(g, a, n) :- v(g, a), agg n = count() in le(g, a, _);"""
    assert run(spark, text, {"v": [(1, x * x) for x in range(1, 5)]})["rank"] == [(1, 1, 1), (1, 16, 4), (1, 4, 2), (1, 9, 3)]


def test_patterns_joins_and_options(spark):
    stock = """relation stock(String, Option<i32>); relation low(String, i32); relation unknown(String); relation middling(String);
    stock('bolt', Some(4)); stock('nut', None); stock('gear', Some(60)); stock('rod', Some(12));
    low(n, q) :- stock(n, v), if let Some(q) = v, if q < 10; unknown(n) :- stock(n, None); middling(n) :- stock(n, v), if let Some(10..=50) = v;"""
    found = run(spark, stock)
    assert found["low"] == [("bolt", 4)] and found["unknown"] == [("nut",)] and found["middling"] == [("rod",)]
    travel = """relation hop(i32, i32); relation fare(i32, i32); relation cost(i32, i32); relation stop(i32, i32, i32); relation priced(i32);
    hop(5, 6); hop(7, 6); hop(-1, 6); fare(6, 100); fare(6, 3); fare(9, 1); stop(4, 9, 1); stop(8, 6, 6); stop(8, 5, 6);
    cost(a, f - a) :- hop(a, b), if a > 0, fare(b, f); priced(m) :- stop(_, m, _), fare(m, _);"""
    found = run(spark, travel)
    assert found["cost"] == [(5, -2), (5, 95), (7, -4), (7, 93)] and found["priced"] == [(6,), (9,)]


def test_generators_and_heads(spark):
    text = """relation board(i32); relation cell(i32, i32); relation axis(i32); board(4);
    cell(r, c) :- board(_), for r in 0..4, for c in 0..(r + 1); axis(r), axis(c) :- cell(r, c);
    relation basket(String, Vec<String>); relation full(String); relation goods(Vec<String>); relation item(String);
    basket('mon', ['tea', 'rye']); basket('tue', ['oats']); basket('wed', ['tea', 'salt', 'tea']);
    full(d), goods(g) :- basket(d, g), if size(g) > 1; item(x) :- goods(g), for x in g;"""
    found = run(spark, text)
    assert found["cell"] == [(r, c) for r in range(4) for c in range(r + 1)] and found["axis"] == [(i,) for i in range(4)]
    assert found["full"] == [("mon",), ("wed",)] and found["goods"] == [(["tea", "rye"],), (["tea", "salt", "tea"],)]
    assert found["item"] == [("rye",), ("salt",), ("tea",)]


def test_enums_records_and_lists(spark):
    laundry = """enum Task { Wash(String), Dry(String), Fold(i32), Done }
    relation next(Task, Task); relation after(Task, Task); relation owner(String, String); relation folds(String, String);
    next(Task::Wash('wool'), Task::Dry('wool')); next(Task::Dry('wool'), Task::Fold(3)); next(Task::Fold(3), Task::Done); next(Task::Wash('silk'), Task::Done);
    after(x, y) :- next(x, y); after(x, z) :- after(x, y), next(y, z);
    folds(who, what) :- owner(who, what), let start = Task::Wash(what), let end = Task::Fold(3), after(start, end);"""
    assert run(spark, laundry, {"owner": [("ann", "wool"), ("bob", "silk"), ("cy", "wool")]}, ["folds"])["folds"] == [("ann", "wool"), ("cy", "wool")]
    doubling = "relation chain(Vec<i32>, i32); chain(array(1), 1); chain(concat(t, array(h * 2)), h * 2) :- chain(t, h), if h < 16;"
    assert sorted(run(spark, doubling)["chain"], key=lambda r: r[1])[-1] == ([1, 2, 4, 8, 16], 16)
    books = """relation book(i32, (String, (i32, bool))); relation lent(String, i32); book(7, ('atlas', (3, true))); book(8, ('novel', (4, false)));
    lent(b.0, days) :- book(_, b), let (title, (days, out)) = b, if out;"""
    assert run(spark, books)["lent"] == [("atlas", 3)]


def test_recursion(spark):
    fibonacci = "relation n(i64); relation fib(i64, i64); n(9); n(x - 1) :- n(x), if x > 0; fib(0, 0); fib(1, 1); fib(x, a + b) :- n(x), if x > 1, fib(x - 1, a), fib(x - 2, b);"
    assert one(spark, fibonacci)[-1] == (9, 34)
    wide = "relation n(u64); relation power(u64, u64); n(63); power(0, 1); power(k + 1, p * 2) :- power(k, p), n(m), if k < m;"
    assert (Decimal(63), Decimal(2**63)) in one(spark, wide)
    turns = "relation move(i32, i32); relation mine(i32); relation theirs(i32); mine(0); theirs(y) :- mine(x), move(x, y); mine(y) :- theirs(x), move(x, y);"
    found = run(spark, turns, {"move": [(0, 1), (1, 2), (2, 3), (3, 3)]})
    assert found["mine"] == [(0,), (2,), (3,)] and found["theirs"] == [(1,), (3,)]
    roads = "relation road(i32, i32); relation near(i32, i32); near(x, y), near(y, x) :- road(x, y); near(x, z) :- near(x, y), near(y, z), if x != z;"
    assert one(spark, roads, {"road": [(1, 2), (2, 3), (8, 9)]}) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (8, 9), (9, 8)]
    switch = "relation road(i32, i32); relation both(bool); relation way(i32, i32); way(x, y) :- road(x, y); way(y, x) :- both(true), way(x, y);"
    assert one(spark, switch, {"road": [(1, 2)], "both": [(True,)]}) == [(1, 2), (2, 1)] and one(spark, switch, {"road": [(1, 2)], "both": [(False,)]}) == [(1, 2)]
    keys = """relation holds(i32, i32); relation door(i32, i32, i32); relation room(i32); relation key(i32); room(1);
    key(k) :- room(r), holds(r, k); room(s) :- room(r), door(r, s, k), key(k);"""
    found = run(spark, keys, {"holds": [(1, 10), (2, 11), (5, 12)], "door": [(1, 2, 10), (2, 3, 11), (3, 4, 12), (1, 4, 13)]})
    assert found["room"] == [(1,), (2,), (3,)] and found["key"] == [(10,), (11,)]
    assert len(one(spark, library.TC, {"edge": [(i, i + 1) for i in range(32)]})) == 528
    generic = "struct Kinship<P>; relation parent(P, P); relation elder(P, P); elder(a, b) :- parent(a, b); elder(a, c) :- parent(a, b), elder(b, c);"
    assert one(spark, generic, {"parent": [("ida", "leo"), ("leo", "uma")]}, types={"P": "String"}) == [("ida", "leo"), ("ida", "uma"), ("leo", "uma")]


def test_least_and_greatest_values(spark):
    arcs = [(1, 2, 7), (1, 3, 20), (2, 3, 5), (3, 4, 1), (4, 2, 1)]
    sssp = "relation edge(i64, i64, i64);" + library.SHORTEST.format(relation="d", seed="1", step="d + w")
    assert one(spark, sssp, {"edge": arcs}) == [(1, 0), (2, 7), (3, 12), (4, 13)]
    assert one(spark, library.COMPONENTS, {"edge": [(3, 2), (2, 1), (4, 4)]}) == [(1, 2), (2, 2), (3, 3), (4, 4)]
    longest = "relation s(i32); relation edge(i32, i32, i32); relation d(i32, i32); d(x, m) :- agg m = max(0) in s(x); d(y, m) :- d(x, c), agg m = max(c + w) in edge(x, y, w);"
    assert one(spark, longest, {"s": [(1,)], "edge": [(1, 2, 1), (1, 3, 9), (2, 3, 20), (3, 4, 1)]}) == [(1, 0), (2, 1), (3, 21), (4, 22)]
    with pytest.raises(RuleError, match="no fixed point"):
        Program.parse(longest).run(spark, {"s": [(1,)], "edge": [(1, 2, 1), (2, 1, 1)]}, most_rounds=5)


def test_negation_shapes(spark):
    base = "relation a(i32, i32); relation b(i32, i32, i32); relation f(); relation o(i32); "
    rows = {"a": [(1, 1), (2, 5), (3, 7)], "b": [(1, 1, 2), (2, 5, 9)]}
    assert one(spark, base + "o(x) :- a(x, y), !b(x, y, _);", rows) == [(3,)]
    assert one(spark, base + "o(x) :- a(x, y), !b(x, y, y + 1);", rows) == [(2,), (3,)]
    assert one(spark, base + "o(x) :- a(x, _), !f();", rows) == [(1,), (2,), (3,)]
    assert one(spark, base + "o(x) :- a(x, _), !f();", rows | {"f": [()]}) == []
    assert one(spark, base + "o(x) :- a(x, _), !b(_, _, 9);", rows) == []


def test_functions_builder_and_order(spark):
    functions = Functions().sql("twice", {"x": "INT"}, "INT", "2 * x")

    @functions.scalar("odd", "boolean")
    def odd(x):
        return x % 2 == 1

    @functions.vectorised("negate", "int")
    def negate(x):
        return -x

    built = Program(functions=functions).relation("n", "i32").relation("o", "i32").fact("n", 3).fact("n", 4).fact("n", 5)
    built.rule("o(negate(twice(x)))", "n(x)", "if odd(x)").output("o")
    assert sorted(r[0] for r in built.run(spark)["o"].collect()) == [-10, -6]
    ordered = Program().relation("e", "i32", "i32").relation("o", "i32", "i32").rule("o(x, z)", "e(x, y)", "e(y, z)", order=[1, 0])
    assert sorted(map(tuple, ordered.run(spark, {"e": [(1, 2), (2, 3)]})["o"].collect())) == [(1, 3)]
    assert "region 0 plain: o" in ordered.explain()


def test_inputs(spark):
    text = "relation e(i32, i32); relation o(i32); o(x) :- e(x, _);"
    frame = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "anything long, other long")
    assert one(spark, text, {"e": frame}) == [(1,), (3,)]
    assert one(spark, text) == []
    for bad in ({"x": []}, {"e": spark.range(1)}):
        with pytest.raises(RuleError):
            Program.parse(text).run(spark, bad)
    with pytest.raises(RuleError):
        Program.parse(text).run(spark, partitions=0)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    """Closure, reach around blocked nodes and same generation, against the naive evaluator."""
    draw = random.Random(seed)
    nodes = range(draw.randint(2, 9))
    edges = {(draw.choice(nodes), draw.choice(nodes)) for _ in range(draw.randint(0, 14))}
    blocked = {(n,) for n in nodes if draw.random() < 0.2}
    text = """relation e(i32, i32); relation b(i32); relation p(i32, i32); relation r(i32); relation s(i32, i32); relation u(i32);
    p(x, y) :- e(x, y); p(x, z) :- p(x, y), p(y, z); r(0); r(y) :- r(x), e(x, y), !b(y);
    s(x, y) :- e(p, x), e(p, y), if x != y; s(x, y) :- e(p, x), s(p, q), e(q, y); u(x) :- e(x, _), !r(x);"""
    rules = [
        ("p", "xy", [("e", "xy", False)], None), ("p", "xz", [("p", "xy", False), ("p", "yz", False)], None),
        ("r", "y", [("r", "x", False), ("e", "xy", False), ("b", "y", True)], None),
        ("s", "xy", [("e", "px", False), ("e", "py", False)], lambda v: v["x"] != v["y"]), ("s", "xy", [("e", "px", False), ("s", "pq", False), ("e", "qy", False)], None),
    ]
    expected = evaluate({"e": edges, "b": blocked, "r": {(0,)}}, rules)
    expected = evaluate(expected, [("u", "x", [("e", "x_", False), ("r", "x", True)], None)])
    found = run(spark, text, {"e": list(edges), "b": list(blocked)})
    for name in "prsu":
        assert found[name] == sorted(expected.get(name, set()), key=repr), name
