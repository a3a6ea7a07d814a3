"""Operators 8, 9 and 10, the pipeline, and the queries with SQL."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from deltarule.llm import mixing, queries, topk, url_filter

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    tidy = lambda rows: Counter(tuple(round(float(v), 6) if isinstance(v, int | float) else str(v) for v in r) for r in rows)
    assert tidy(tuple(r[c] for c in names) for r in found.collect()) == tidy(result.fetchall())


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target = sum(sizes.values()), {}
    free = set(order)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} if over else share
        free = free - over if over else set()
    return target


def test_mixing(frame, odd_rows):
    draw = random.Random(9)
    names = ["b", "a", None, "é", "Z", "tiny", "empty"]
    rows = [(i, t, None, draw.choice(names[:5])) for i, t in odd_rows] + [(900, "one two", None, "tiny"), (901, "", None, "empty"), (901, "", None, "empty")]
    found = mixing.allocate(frame(rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    expected = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        taken[r.source] += r.taken
        assert abs(r.target - expected[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - expected[s]) <= 0.5 for s in sizes)
    again = mixing.allocate(frame(rows, 5)).collect()
    pick = lambda x: Counter((r.doc_id, r.text, r.taken) for r in x)
    assert pick(again) == pick(found)
    mixed = mixing.mix(frame(rows))
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert mixed.columns == frame(rows).columns and all(words[s] == taken[s] for s in sizes)
    assert mixing.allocate(frame(rows).limit(0)).count() == 0


def test_one_source_may_hold_nearly_all(frame):
    rows = [(i, "x " * (i % 7), None, "big") for i in range(500)] + [(1000, "x y z", None, "small")]
    found = mixing.allocate(frame(rows)).collect()
    assert sum(r.taken for r in found if r.source == "small") == 9
    assert sum(r.taken for r in found) == sum(r["size"] for r in found)


def test_urls(spark):
    cases = {
        "http://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://Example.ORG/en/12?q=/x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://x.com/fr/#a": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/9": ("x.com", "/de/9", "com/de/", "block"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://cheap-pills.example.net/": ("cheap-pills.example.net", "/", None, "block"),
        "http://cheap-pillsy.example.net/": ("cheap-pillsy.example.net", "/", None, "allow"),
        "CHEAP-PILLS": ("", "", None, "block"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://m.net/a/wp-login.php?x": ("m.net", "/a/wp-login.php", None, "block"), "http://?": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(u, "clash") for u in cases], "url string, host string")
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()} == cases
    assert url_filter.judge(pages, (), ()).select("verdict").distinct().count() == 1
    assert url_filter.judge(pages.limit(0)).count() == 0
    many = [url_filter.HostRule(f"h{i}.test", "/", "block") for i in range(300)]
    joined = url_filter.judge(pages.unionByName(pages), (*url_filter.HOST_RULES, *many)).collect()
    assert len(joined) == 2 * len(cases) and {r.url: (r.host, r.path, r.rule, r.verdict) for r in joined} == cases
    assert {r.host: r.rule for r in url_filter.judge(spark.createDataFrame([("http://a.h7.test/x",)], "url string"), many).collect()} == {"a.h7.test": "h7.test/"}


def test_columns_of_the_user_stay(spark):
    """Columns with the names that operators use inside keep their values."""
    from deltarule.llm import simhash

    names = "rank of slice key copy size row id th place first best by before target kept _id _th _best".split()
    rows = [(i, f"word{i} " * 3, f"s{i % 2}", "http://x.org/a", *(100 * i + k for k in range(len(names)))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, url string, " + ", ".join(f"`{n}` long" for n in names))
    mine = lambda found, skip=(): {r.doc_id: tuple(r[n] for n in names if n not in skip) for r in found.collect()}
    expected = lambda skip=(): {r[0]: tuple(v for n, v in zip(names, r[4:], strict=True) if n not in skip) for r in rows}
    assert mine(simhash.representatives(docs)) == expected() and mine(url_filter.judge(docs)) == expected()
    mixed = mine(mixing.mix(docs))
    assert mixed and mixed == {i: v for i, v in expected().items() if i in mixed} and mixing.mix(docs).columns == docs.columns
    gone = ("size", "target", "key")
    assert mine(mixing.allocate(docs), gone) == expected(gone)


def test_mix_is_the_same_again(frame):
    """Rows that share id and size but not text keep their place."""
    rows = [(7, f"a{i} b{i} c{i}", None, "s") for i in range(20)] + [(8, "x y z w", None, "t")]
    pick = lambda n: Counter((r.text, r.taken) for r in mixing.allocate(frame(rows, n)).collect())
    assert pick(1) == pick(7)


def test_rarest_literal_is_the_index(spark):
    urls = spark.createDataFrame([("http://free.net/free",), ("http://free.org/x-bets",)], "url string")
    assert set(url_filter.index(urls, [url_filter.phrase("free", "bets")])) == {"bets"}
    assert set(url_filter.index(urls, [url_filter.phrase("free", "pills")])) == {"pills"}


def plain_top(vectors, every, k):
    out = []
    for q, v in vectors:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return Counter(out)


@pytest.mark.parametrize("n, same, k, pivots, blocks", [(300, 0, 20, 64, 8192), (300, 100, 5, 8, 40), (15, 0, 20, 128, 8192), (0, 0, 20, 4, 8192)])
def test_top_k(spark, monkeypatch, n, same, k, pivots, blocks):
    draw = random.Random(n + k)
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.2) for c in draw.choice(centres)]) for i in range(n)] + [(n + i, [1.0] * 8) for i in range(same)]
    rows += [(7, rows[3][1])] if n > 20 else []
    odd = [(10**6, None), (10**6 + 20, [1.0, None]), (10**6 + 40, [float("nan")] * 8), (10**6 + 60, [float("inf")]), (None, [1.0]), (10**6 + 80, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    import math

    plain = plain_top([(i, [math.floor(64 * x) for x in v]) for i, v in rows], 20, k)
    found = topk.top_k(topk.quantised(frame), 20, k, pivots)
    assert Counter(map(tuple, found.collect())) == plain


def test_groups_that_cannot_matter_are_skipped(spark, monkeypatch):
    """Tight clusters around far-apart centres: most pairs of groups are never compared, and the result is exact."""
    draw, seen = random.Random(3), []
    routes = topk.routes
    monkeypatch.setattr(topk, "routes", lambda *x, **y: seen.append(routes(*x, **y)) or seen[-1])
    centres = [[100.0 * (i == j) for j in range(12)] for i in range(12)]
    rows = [(i, [c + draw.gauss(0, 0.5) for c in centres[i % 12]]) for i in range(2400)]
    frame = spark.createDataFrame([(i, [int(64 * x) for x in v]) for i, v in rows], "vec_id long, v array<long>")
    found = topk.top_k(frame, 40, 3)
    plain = plain_top([tuple(r) for r in frame.collect()], 40, 3)
    assert Counter(map(tuple, found.collect())) == plain
    assert 0 < seen[0].share < 0.2
    assert sum(map(len, seen[0].blocks)) <= len(seen[0].blocks)


def test_blocks_hold_neighbouring_groups():
    import numpy as np

    centre = np.array([[0.0, 0], [10, 0], [1, 0], [11, 0], [50, 0]])
    queries = np.array([3, 3, 3, 3, 25])
    found = topk.routes(centre, np.full(5, 9), np.ones(5), queries, np.ones(5), np.full(5, 60.0), np.full(5, -np.inf), k=100, block=8)
    assert found.share == 1 and found.first[0] == found.first[2] and found.first[1] == found.first[3] and found.parts[4] == 4
    assert found.blocks == [list(range(max(found.first[4] + 4, found.first[0] + 1, found.first[1] + 1)))] * 5


def test_pipeline(spark, tmp_path):
    """All stages over planted documents, against what the plain rules leave."""
    import corpus_pipeline
    from deltarule.llm import bpe
    from tests.llm import brute

    source = spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()
    passage = " ".join(f"planted{i}" for i in range(60))
    rows = [tuple(r) for r in source] + [(10_000, source[0].text, "en", "src1", 5), (10_001, source[3].text + " " + passage, "en", "src1", 5), (10_002, "clean " + passage + " end of it", "en", "src2", 5), (10_003, "12 34", "en", "src2", 5), (10_004, None, None, None, None)]
    folder = tmp_path / "sf"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(folder / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(folder)).collect()
    text = {r[0]: r[1] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    kept = [(i, text[i]) for i, least in brute.similar(list(text.items()), 5) if least == i]
    assert {r.doc_id for r in found} <= {i for i, _ in kept} and 10_003 not in {r.doc_id for r in found} and 10_004 not in {r.doc_id for r in found}
    left = {i: (n, gone) for i, n, gone, _ in brute.substring(kept, 50)}
    stage = docs
    for name, step in corpus_pipeline.STAGES:
        before, stage = stage, step(spark, stage, str(folder))
        if name == "substring_dedup":
            assert {r.doc_id: len((r.text or "").encode().split()) for r in stage.collect()} == {i: n - g for i, (n, g) in left.items() if not g or g < n}
        if name == "source_mixing":
            total = lambda x: sum(len((r.text or "").encode().split()) for r in x.collect())
            assert abs(total(stage) - total(before)) <= 25
        if name != "byte_bpe":
            assert stage.columns == docs.columns
    ranks = bpe.default_ranks()
    assert Counter(tuple(r.ids) for r in stage.collect()) == Counter(tuple(r.ids) for r in found)
    assert bpe.decode(stage, ranks).count() == len(found)
