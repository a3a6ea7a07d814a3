"""Operators 3, 4, 5 and 7."""

import base64
import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from deltarule.llm import bpe, language_id, quality_classifier, quality_rules
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def rules(text):
    words = (text or "").encode().split()
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat), failed)


def test_base_rules(frame, odd_rows):
    rows = odd_rows + [(500, "a b c a b c\n\na b c\n a b c\nx"), (501, "#a *b c " * 30), (502, "l\n" * 3 + "m")]
    found = quality_rules.compression_bands(frame(rows)).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in found) == sorted((str(i), *rules(t)) for i, t in rows)
    assert all(not r.kept for r in found if r.base_failed)
    assert quality_rules.compression_bands(frame(rows).limit(0)).count() == 0


def test_bands(frame):
    draw = random.Random(1)
    alphabet = "etaoin shrdlu cmfwyp"
    prose = " ".join("".join(draw.choice(alphabet.replace(" ", "")) for _ in range(draw.randint(2, 8))) for _ in range(600))
    noise = " ".join(base64.b64encode(draw.randbytes(30)).decode() for _ in range(200))
    padded = " ".join(f"{i} " + "=" * 120 for i in range(100))
    reason = {r.doc_id: (r.kept, r.reason) for r in quality_rules.compression_bands(frame([(1, prose), (2, noise), (3, padded), (4, "few words"), (5, prose + padded[:2400])])).collect()}
    assert reason[1] == (True, None) and reason[3] == (False, "repetitive") and reason[4] == (False, "base") and reason[5] == (False, "chunks")
    tight = quality_rules.Limits(bands=((1 << 62, 1.6, 9.0),))
    assert {r.doc_id: r.reason for r in quality_rules.compression_bands(frame([(2, noise)]), tight).collect()} == {2: "incompressible"}


def test_noise_of_every_length_is_incompressible(frame):
    """Random letters and digits, and base64, in words of eight; the production limits."""
    draw = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = lambda s: " ".join(s[i : i + 8] for i in range(0, len(s), 8))
    rows = []
    for size in (460, 505, 700, 2000, 2300, 9000, 16000, 20000, 60000):
        rows.append((size, words("".join(draw.choice(alphabet) for _ in range(size)))[:size]))
        rows.append((size + 1, words(base64.b64encode(draw.randbytes(size)).decode())[:size]))
    found = quality_rules.compression_bands(frame(rows)).collect()
    assert {(r.doc_id, r.kept, r.reason) for r in found} == {(i, False, "incompressible") for i, _ in rows}
    assert all(r.bad_chunks == r.n_chunks for r in found)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_every_column_of_the_bands(spark, folder):
    """The query over a whole table against the plain version; the fitted bands decide on some documents."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute.compression_bands(rows, quality_rules.BANDS)
    found = {r[0]: tuple(r)[1:] for r in quality_rules.query(spark, f"/root/testdata/{folder}").collect()}
    assert found == expected
    assert folder == "sf0.001" or any(x[-1] == "repetitive" for x in expected.values())


def test_bands_reject_by_label(spark):
    """Of labelled documents that pass the base rule, the fitted bands reject most bad ones and few good ones."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.kept) for r in quality_rules.query(spark, folder).collect() if r.doc_id in labels and not r.base_failed]
    share = lambda q: sum(not kept for label, kept in rows if label == q) / sum(label == q for label, _ in rows)
    assert share(0) > 0.5 and share(1) < 0.005


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"  # smaller scales have too few bad labels to learn from
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = quality_classifier.query(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_edges(spark, frame, odd_rows):
    docs = frame(odd_rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    found = quality_classifier.score(docs, model)
    assert found.count() == len(odd_rows) and found.filter("score is null or score < 0 or score > 1").count() == 0
    for some in (labels.filter("quality = 1"), labels.limit(0)):
        found = quality_classifier.score(docs, quality_classifier.train(docs, some)).select("score").distinct().collect()
        assert len(found) == 1


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = language_id.query(spark, SF).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out]
    assert len(found) == len(lang) and sum(held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)


def test_language_edges(frame):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(20)] + [(50 + i, f"der Hund und die Katze {i}", "de") for i in range(20)]
    rows += [(100 + i, f"le chien et le chat {i}", "fr") for i in range(20)] + [(150 + i, f"neko to inu {i}", "ja") for i in range(20)]
    odd = [(200, None, "en"), (201, "", None), (202, "123 !", "en"), (203, "日本", None), (204, "É", "fr")]
    docs = frame(rows + odd)
    model = language_id.train(docs)
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert all(found[i] == "und" for i in (200, 201, 202)) and found[203] != "und" != found[204]
    assert [found[i] for i in (0, 50, 100, 150)] == ["en", "de", "fr", "ja"]
    kept = language_id.relabel(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    pairs = bpe.BytePairs.load(bpe.default_ranks())
    return pairs, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def test_bpe_is_tiktoken(frame, odd_rows, tiktoken_encoding):
    pairs, library = tiktoken_encoding
    draw = random.Random(7)
    alphabet = " '  \n\tstmdrevl aZ9é!.　中 _''llré🙂\x1c\x85"
    rows = odd_rows + [(1000 + i, "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))) for i in range(3000)]
    rows += [(5000, "a" * 5000), (5001, "!" * 3000 + " x"), (5002, "ab" * 3000), (5003, "<|endoftext|>"), (5004, " " * 400)]
    found = bpe.encode(frame(rows), bpe.default_ranks())
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in found.collect())
    assert got == collections.Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    back = bpe.decode(found, bpe.default_ranks())
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((i, t or "") for i, t in rows)
    one = found.filter("doc_id = 5001").first()
    assert one.offsets[0] == 0 and one.n_tokens == len(one.ids) == len(one.offsets)
    assert bpe.encode(frame(rows).limit(0), bpe.default_ranks()).count() == 0


def test_every_code_point_splits_as_the_library_splits(tiktoken_encoding):
    import numpy as np

    pairs, library = tiktoken_encoding
    texts = [f"a{chr(i)}1 {chr(i)}{chr(i)}b" for i in range(0, 0x110000, 7) if not 0xD800 <= i < 0xE000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    cuts, bounds = bpe.slices(data, offsets)
    for i, text in enumerate(texts):
        own = [*cuts[bounds[i] : bounds[i + 1]].tolist(), int(offsets[i + 1])]
        ids = [x for a, b in zip(own, own[1:]) for x in pairs.merge(data[a:b].tobytes())]
        assert ids == library.encode_ordinary(text), hex(ord(text[1]))


def test_digests(spark, frame):
    found = bpe.encode(frame([(1, "héllo wörld"), (2, None)]), bpe.default_ranks(), digest=True)
    from tests.llm.brute import sha

    assert {r.doc_id: r.decoded_sha256 for r in found.collect()} == {1: sha("héllo wörld".encode()), 2: sha(b"")}
    assert found.filter(F.col("n_tokens") == 0).count() == 1


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF6220C3' AS STRING) AS text UNION ALL SELECT 2L, 'fine é'")
    ranks = bpe.default_ranks()
    encoded = bpe.encode(docs, ranks)
    assert all(r.restored for r in encoded.collect())
    assert {r.doc_id: r.text for r in bpe.decode(encoded, ranks).collect()} == {1: "a\ufffdb \ufffd", 2: "fine é"}
