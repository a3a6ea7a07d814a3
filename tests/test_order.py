"""Orders put on results, first appearance, and functions that are written out."""

from deltarule import Program
from deltarule.operators import order
from deltarule.sources.files import read_delimited


def test_ordered_and_limited(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", None)], "name string, score int")
    assert [r[0] for r in order.ordered(rows, "score desc").collect()] == ["c", "a", "b", "d"]
    assert [r[0] for r in order.ordered(rows, "score desc", limit=2).collect()] == ["c", "a"]
    assert [r[0] for r in order.ordered(rows, "name").collect()] == ["a", "b", "c", "d"]
    assert order.ordered(rows.limit(0), "name", limit=3).collect() == []


def test_first_seen(spark, monkeypatch):
    rows = spark.createDataFrame([("x", 30), ("y", 4), ("x", 12), ("z", 4), (None, 7), ("w", 1000)], "v string, p long")
    expected = {"y": 0, "z": 1, None: 2, "x": 3, "w": 4}
    for block in (order.BLOCK, 5):
        monkeypatch.setattr(order, "BLOCK", block)
        seen = order.first_seen(rows, "v", "p")
        assert {r["v"]: r["ord"] for r in seen.collect()} == expected
    result = spark.createDataFrame([("w",), ("x",), ("unknown",), ("z",)], "v string")
    assert [r[0] for r in order.by_first_appearance(result, seen, "v").collect()] == ["z", "x", "w", "unknown"]
    assert order.first_seen(rows.limit(0), "v", "p").collect() == []


def test_place_follows_the_file(spark, tmp_path):
    (tmp_path / "names.tsv").write_text("pear\t1\nfig\t2\npear\t3\nplum\t4\n")
    rows = order.with_place(read_delimited(spark, str(tmp_path / "names.tsv"), ["String", "i32"], sep="\t"))
    assert {r[0]: r[1] for r in order.first_seen(rows, "_0", "place").collect()} == {"pear": 0, "fig": 1, "plum": 2}
    assert [r[1] for r in rows.orderBy("place").collect()] == [1, 2, 3, 4]


def test_clamp_and_wrapping_abs(spark):
    text = "relation n(i32); relation o(i32, i32, i32, i32); o(x, clamp(x, -2, 5), wrapping_abs(x), max(min(x, 3), 1)) :- n(x);"
    found = Program.parse(text).run(spark, {"n": [(-(2**31),), (-7,), (0,), (4,), (9,)]})["o"]
    assert sorted(map(tuple, found.collect())) == [(-(2**31), -2, -(2**31), 1), (-7, -2, 7, 1), (0, 0, 0, 1), (4, 4, 4, 3), (9, 5, 9, 3)]
