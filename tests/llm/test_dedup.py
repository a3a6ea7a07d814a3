"""Operators 1, 2 and 6 against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltarule.llm import components, repeats, simhash, substring_dedup, suffix_dedup
from deltarule.llm.common import BYTE_VALUE, Rolling
from tests.llm import brute

key = lambda r: tuple((x is not None, x) for x in r)


def substring(docs, window):
    found = substring_dedup._run(docs, window, True, ["doc_id"])
    return sorted((tuple(r) for r in found.select("rest.doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=key)


@pytest.mark.parametrize("window", [2, 3, 7, 20, 50])
def test_substring(frame, odd_rows, window):
    assert substring(frame(odd_rows), window) == sorted(brute.substring(odd_rows, window), key=key)


@pytest.mark.parametrize("threshold", [5, 16, 40, 400])
def test_suffix(frame, odd_rows, threshold):
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 9000]
    found = suffix_dedup._run(frame(rows), threshold, True).drop("removed")
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute.suffix(rows, threshold), key=key)


def test_few_symbols(frame):
    """Periodic texts and many ties between anchors."""
    draw = random.Random(2)
    rows = [(i, "".join(draw.choice("ab ") for _ in range(draw.randint(0, 200)))) for i in range(40)]
    assert substring(frame(rows), 6) == sorted(brute.substring(rows, 6), key=key)
    found = suffix_dedup._run(frame(rows), 12, True).drop("removed")
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute.suffix(rows, 12), key=key)


@pytest.mark.parametrize("part", ["run", "window"])
def test_names_of_one_anchor_have_64_bits(frame, part):
    """Two texts with 380 bytes in common whose names agree in 32 bits have no repeated string of 400 bytes."""
    draw = np.random.default_rng(10)  # puts the anchor into the common bytes
    head = draw.integers(97, 123, 380, dtype=np.uint8)
    tails, found = draw.integers(97, 123, (200_000, 20), dtype=np.uint8), []
    for some in np.array_split(tails, 100):
        texts = np.concatenate((np.tile(head, (len(some), 1)), some), axis=1)
        at = np.arange(len(some)) * 400
        rolling = Rolling(BYTE_VALUE[texts.ravel()])
        found.append(rolling.at(at, at + 400) + np.uint64(1) if part == "run" else rolling.at(at + 144, at + 400))
    names = np.concatenate(found) >> np.uint64(32)
    order = np.argsort(names)
    same = np.flatnonzero(names[order][1:] == names[order][:-1])
    assert len(same)
    rows = [(k, bytes(np.concatenate((head, tails[i]))).decode()) for k, i in enumerate(order[same[0] : same[0] + 2])]
    kept = suffix_dedup._run(frame(rows), 400, True).drop("removed")
    assert sorted(map(tuple, kept.collect())) == sorted(brute.suffix(rows, 400))


def test_kept_texts(frame):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = frame([(1, f"begin {passage} end"), (2, f"other {passage}\nrest"), (3, None), (4, passage), (5, "left  alone")])
    kept = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(docs).collect()}
    assert kept == {1: f"begin {passage} end", 2: "other rest", 3: None, 4: "", 5: "left  alone"}
    cut = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.cut(docs).collect()}
    assert cut == {1: (f"begin {passage} end", len(passage) + 10), 2: ("other rest", 10), 3: (None, None), 5: ("left  alone", 11)}
    assert substring_dedup.cut(docs).columns == docs.columns
    spans = {r.doc_id: [tuple(x) for x in r.removed] for r in suffix_dedup.suffix_dedup(frame([(1, "x" + "ab" * 20), (2, "y")]), 10).collect()}
    assert spans == {1: [(1, 41)], 2: []}


def test_empty_tables(frame, spark):
    docs = frame([(1, "x")]).filter("doc_id > 1")
    assert substring(docs, 50) == [] and suffix_dedup.suffix_dedup(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0 and simhash.representatives(docs).count() == 0


def test_runs_own_every_window_once():
    draw = np.random.default_rng(0)
    values = draw.integers(0, 3, 500, dtype=np.uint64)
    bounds = np.array([0, 120, 120, 125, 500])
    doc, first, count, anchor = repeats.find_runs(Rolling(values), bounds, 12, 5)
    windows = [(d, f + j) for d, f, c in zip(doc, first, count) for j in range(c)]
    assert windows == [(d, p) for d in range(4) for p in range(bounds[d], bounds[d + 1] - 11)]
    assert ((first + count - 1 <= anchor) & (anchor + 5 <= first + 12)).all()


@pytest.mark.parametrize("width", [3, 5])
def test_near_duplicates(frame, odd_rows, width):
    draw = random.Random(3)
    rows = [(i, t) for i, t in odd_rows if i is not None]
    base = [f"v{draw.randint(0, 400)}" for _ in range(300)]
    for k in range(40):
        words = list(base)
        for _ in range(k % 4):
            words[draw.randrange(300)] = f"n{k}"
        rows.append((1000 + k, " ".join(words)))
    found = simhash.near_duplicates(frame(rows), width)
    found = found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(tuple, found.collect())) == sorted(brute.near(rows, width))


def test_links_are_all_links(spark):
    """Fingerprints around a few centres, at all distances up to five."""
    draw = np.random.default_rng(4)
    fps = [0, (1 << 64) - 1]
    for centre in draw.integers(0, 1 << 64, 12, dtype=np.uint64).tolist():
        for _ in range(40):
            bits = draw.choice(64, draw.integers(0, 6), replace=False).tolist()
            fps.append(centre ^ sum(1 << b for b in bits))
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    found = simhash.links(spark.createDataFrame([(x, x) for x in signed], "fp long, group long"))
    assert {tuple(r) for r in found.collect()} == expected
    grouped = simhash.links(spark.createDataFrame([(x, k % 5) for k, x in enumerate(signed)], "fp long, group long"))
    place = {x: k % 5 for k, x in enumerate(signed)}
    apart = {tuple(sorted((place[a], place[b]))) for a, b in expected if place[a] != place[b]}
    assert {tuple(r) for r in grouped.collect()} == apart


def test_golay_decoder_covers_every_word():
    exact, around = simhash.fuzzy_indices()
    words = simhash._codewords()
    assert len(set(words.tolist())) == 4096 and min(int(w).bit_count() for w in words[1:]) == 7
    assert (np.bitwise_count(words[exact] ^ np.arange(1 << 16)) <= 3).all()
    assert (exact[:, None] == around).any(1).all() and around.shape[1] <= 6


def test_representatives(frame):
    rows = [(3, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "something else entirely here now"), (None, "no id at all in this text")]
    kept = simhash.representatives(frame(rows), 5)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "None"] and kept.columns == frame(rows).columns


@pytest.mark.parametrize("length", [9, 40, 500])
def test_representatives_are_those_of_all_pairs(frame, odd_rows, length):
    """Against all pairs: copies with words changed apart, added behind, or sharing a passage only."""
    draw = random.Random(length)
    fresh = lambda n: [f"v{draw.randint(0, 10**6)}" for _ in range(n)]
    rows, passage = [r for r in odd_rows if r[0] is not None], fresh(length)
    for k in range(12):
        base = fresh(length)
        for c in range(6):
            words = list(base)
            for _ in range(draw.randint(0, max(1, length // 40))):
                words[draw.randrange(len(words))] = f"n{k}_{c}"
            rows.append((1000 + 10 * k + c, " ".join(words + fresh(draw.choice([0, 0, length // 9, length // 5])))))
        rows.append((2000 + k, " ".join(passage + fresh(length // 2 + 1))))
    draw.shuffle(rows)
    expected = {least for _, least in brute.similar(rows, 5)}
    kept = simhash.representatives(frame(rows), 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)
    assert len(expected) < len({i for i, _ in rows}) - 20 and len(set(expected) & set(range(2000, 2012))) == 12


@pytest.mark.parametrize("own", [40, 60, 80])
def test_representatives_keep_a_family_below_the_limit(frame, own):
    """A template of 240 words and 40 to 80 words of its own put every pair at 0.59 to 0.75, though fingerprints come within three bits."""
    draw = random.Random(own)
    template = [f"t{i}" for i in range(240)]
    rows = [(i, " ".join(template + [f"o{draw.randint(0, 10**9)}" for _ in range(own)])) for i in range(400)]
    fps = [simhash.bits(np.unique(simhash.shingle_hashes(t.encode().split(), 5)), 1)[0] for _, t in rows]
    close = sum((a ^ b).bit_count() <= 3 for i, a in enumerate(fps) for b in fps[:i])
    assert own > 40 or close
    assert sorted(r.doc_id for r in simhash.representatives(frame(rows), 5).collect()) == list(range(400))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 160)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 150, 150: 150, 160: 150}
