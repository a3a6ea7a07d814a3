"""Files, the command line and streams."""

import pytest

from deltarule import Program
from deltarule.run import main
from deltarule.sources.files import read_delimited, sizes, write_csv, write_text
from deltarule.streaming.rerun import run_on_stream


def test_delimited_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n\n2,y y\n")
    rows = read_delimited(spark, str(tmp_path / "a.csv"), ["i32", "String"])
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (2, "y y")]
    (tmp_path / "b.txt").write_text('id|n\n7|"a|b""c"  \n')
    quoted = read_delimited(spark, str(tmp_path / "b.txt"), ["i64", "String"], "|", header=True, quoted=True, trim=True)
    assert [tuple(r) for r in quoted.collect()] == [(7, 'a|b"c')]
    assert read_delimited(spark, str(tmp_path / "none.csv"), ["i32"]).count() == 0
    with pytest.raises(Exception):
        read_delimited(spark, str(tmp_path / "none.csv"), ["i32"], missing_ok=False).count()
    with pytest.raises(Exception):
        read_delimited(spark, str(tmp_path / "a.csv"), ["i32", "i32"]).collect()
    write_csv(quoted, str(tmp_path / "out"))
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "out"), ["i64", "String"], quoted=True).collect()] == [(7, 'a|b"c')]


def test_text_of_tuples(spark, tmp_path):
    found = Program.parse("relation o(i32, (i32, String), bool, (i32,)); relation p(i32, (i32, String), bool, (i32,)); o(1, (2, 'a'), true, (5,)); p(a, b, c, d) :- o(a, b, c, d);").run(spark)
    write_text(found["p"], str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1\t(2, a)\tTrue\t(5,)"]
    assert sizes({"P": found["p"]}) == ["p\t1"]


def test_command(spark, tmp_path, capsys):
    (tmp_path / "p.rules").write_text("#![profile] relation edge(i32, i32); relation path(i32, i32); path(x, y) :- edge(x, y); path(x, z) :- path(x, y), edge(y, z);")
    (tmp_path / "edge.csv").write_text("1,2\n2,3\n")
    main(str(tmp_path / "p.rules"), str(tmp_path), str(tmp_path / "out"))
    assert "path\t3" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(("1,2\n", "2,3\n")):
        (tmp_path / "in" / f"{k}.csv").write_text(rows)
    stream = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    program = Program.parse("relation edge(i32, i32); relation path(i32, i32); path(x, y) :- edge(x, y); path(x, z) :- path(x, y), edge(y, z);")
    counts = []
    run_on_stream(program, stream, "edge", str(tmp_path / "seen"), lambda r, n: counts.append(r["path"].count()), str(tmp_path / "check")).awaitTermination(60)
    assert counts == [1, 3]
