"""Recursion over the rows that lead to others: the same rows as by all rounds, few of them stored."""

import random

import pytest

from deltarule import Program
from deltarule.operators import expansion
from deltarule.operators.store import Store
from deltarule.programs import library
from tests.naive import evaluate

UP = "relation up(i64, i64); relation out(i64, i64); out(x, y) :- up(x, p), up(y, p), if x <> y;"
STEP = "out(x, y) :- up(x, p), out(p, q), up(y, q);"


@pytest.fixture
def seen(monkeypatch):
    """Rows that the store writes, and whether each expansion was made."""
    counts, made = [], []
    write, expand = Store.write, expansion.expand
    monkeypatch.setattr(Store, "write", lambda self, rows: (lambda out: (counts.append(out[1]), out)[1])(write(self, rows)))
    monkeypatch.setattr("deltarule.program.expand", lambda *a: (lambda out: (made.append(out is not None), out)[1])(expand(*a)))
    return counts, made


def rows(spark, text, inputs):
    found = Program.parse(text).run(spark, inputs, [n for n in ("out", "same") if f"relation {n}(" in text])
    return sorted(tuple(r) for r in next(iter(found.values())).collect())


def naive(up):
    rules = [("out", ("x", "y"), [("up", ("x", "p"), False), ("up", ("y", "p"), False)], lambda e: e["x"] != e["y"]), ("out", ("x", "y"), [("up", ("x", "p"), False), ("out", ("p", "q"), False), ("up", ("y", "q"), False)], None)]
    return sorted(evaluate({"up": set(up)}, rules).get("out", set()))


def test_leaves_are_not_stored(spark, seen):
    """3 roots, 12 inner nodes, 600 leaves: all pairs of leaves under a root, but only nodes and their pairs are written."""
    up = [(10 + i, 1 + i % 3) for i in range(12)] + [(1000 + i, 10 + i % 12) for i in range(600)]
    found = rows(spark, UP + STEP, {"up": up})
    assert len(found) == len(set(found)) == 3 * (200 * 199 + 4 * 3) and sum(seen[0]) < 1000 and seen[1] == [True]


@pytest.mark.parametrize("step", [STEP, "out(x, y) :- out(p, q), up(x, p), up(y, q);", "out(x, y) :- up(y, q), out(p, q), up(x, p);"])
def test_trees(spark, seen, step):
    """Deep and uneven ones, nodes that are their own parents and rings included, rows twice in the input."""
    draw = random.Random(5)
    up = [(i, draw.randrange(i)) for i in range(1, 40)] + [(50, 50), (51, 50), (52, 53), (53, 52), (54, 52), (55, 53)]
    assert rows(spark, UP + step, {"up": up + up[:9]}) == naive(up)
    assert seen[1] == [True]


def test_without_keys_all_rounds_run(spark, seen):
    """Nodes of two parents."""
    draw = random.Random(6)
    up = list({(i, draw.randrange(i)) for i in range(1, 30) for _ in range(2)})
    assert rows(spark, UP + STEP, {"up": up}) == naive(up)
    assert seen[1] == [False]


FIRST = {
    "up": "out(x, y) :- up(x, p), up(y, p), if x <> y;",
    "alike": "out(x, y) :- up(x, p), up(y, p);",
    "parents": "out(x, p) :- up(x, p);",
    "both": "out(x, p) :- up(x, p); out(x, y) :- up(x, p), up(y, p), if x <> y;",
    "joined": "out(x, y) :- up(x, p), up(x, q), up(y, q);",
}


@pytest.mark.parametrize("first", FIRST)
def test_nulls(spark, seen, monkeypatch, first):
    """As all rounds do: a null is a value of a row, and equals nothing in a join."""
    draw = random.Random(8)
    up = [(i, draw.choice([None, *range(max(1, i // 2))])) for i in range(1, 25)] + [(None, 2)]
    text = "relation up(i64, i64); relation out(i64, i64);" + FIRST[first] + STEP
    run = lambda: sorted((tuple(r) for r in Program.parse(text).run(spark, {"up": up}, ["out"])["out"].collect()), key=repr)
    found = run()
    assert seen[1] == [True]
    monkeypatch.setattr("deltarule.program.expansion_of", lambda *_: None)
    assert found == run() and any(None in r for r in found)


def test_other_first_rules(spark, seen):
    """Two rules before the recursion, whose rows overlap, and the program of the library."""
    draw = random.Random(7)
    up = [(i, draw.randrange(max(1, i // 3))) for i in range(1, 60)]
    two = UP + "out(x, y) :- up(x, p), up(y, p), if x < y;" + STEP
    assert rows(spark, two, {"up": up}) == naive(up) == rows(spark, library.SAME_GENERATION, {"parent": [(p, x) for x, p in up]})
    pairs = rows(spark, "relation up(i64, i64); relation out(i64, i64); out(x, p) :- up(x, p);" + STEP, {"up": up})
    known = set(up)
    while more := {(x, y) for x, p in up for y, q in up if (p, q) in known} - known:
        known |= more
    assert pairs == sorted(known)
    assert seen[1][:2] == [True, True]


@pytest.mark.parametrize(
    "text",
    [
        "relation e(i64, i64); relation out(i64, i64); out(x, y) :- e(x, y); out(x, z) :- out(x, y), e(y, z);",
        UP + STEP + "relation more(i64); more(x) :- out(x, _);",
        UP + "out(1, 2);" + STEP,
        UP + "relation other(i64, i64); out(x, p) :- up(x, p), other(x, a);" + STEP,
        UP + "out(x, y) :- up(x, p), out(p, q), up(y, q), if p + q > 3;",
        UP + "out(x, y) :- up(x, p), out(p, q), up(y, q), !up(x, q);",
        UP + "out(x, y) :- up(x, p), out(p, q), up(y, _);",
        "relation up(i64, Option<i64>); relation out(i64, i64); out(x, y) :- up(x, p), up(y, p), if x <> y; relation w(i64, i64);" + STEP,
    ],
)
def test_programs_of_other_shapes(text):
    resolved = Program.parse(text).resolve()
    assert all(expansion.expansion_of(resolved, r) is None for r in resolved.regions if r.recursive)
