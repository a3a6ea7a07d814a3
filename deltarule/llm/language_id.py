"""Operator 5, language ID: hierarchical discrimination.

First the language family, then one-versus-one linear support vector machines between
the languages of that family. Features are relative frequencies of hashed byte n-grams
(one to three bytes) of the lower-cased text, so a score is a mean of weights over the
whole text and needs no feature vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarule.llm.common import crc_mod, mix, small_batches, steps, table
from deltarule.llm.samples import per_class

#: Families of common codes; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"
OUT = "doc_id long, lang_pred string, score double"
_BITS = 12
_SIZE = 1 << _BITS


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z, and the two-byte letters from A-grave to Thorn."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = np.concatenate(([False], data[:-1] == 0xC3)) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        out[latin] += 32
    return out


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Feature of the n-gram that ends at each byte, for n of 1, 2 and 3.

    N-grams that begin in an earlier text (at most two a text) count too, in scoring as in training
    each text stands after a space."""
    low = _lowered(data).astype(np.uint64)
    one = np.concatenate((np.full(2, 32, np.uint64), low))
    two = one[1:-1] << np.uint64(8) | low
    three = one[:-2] << np.uint64(16) | two
    shift = np.uint64(64 - _BITS)
    return [(mix(x + np.uint64(n << 32)) >> shift).astype(np.int32) for n, x in ((1, low), (2, two), (3, three))]


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets two spaces before each text, so that n-grams never reach into another text."""
    lengths = np.diff(offsets) + 2
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    out = np.full(bounds[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(1, len(lengths) + 1), lengths - 2)] = data
    return out, bounds


class LanguageModel:
    """machines: (level, first, second) -> weights by feature and a shift; positive means first."""

    def __init__(self, family: dict[str, str], names: list[str], weights: np.ndarray, shifts: np.ndarray, pairs: list[tuple[str, str, str]]):
        self.family, self.names, self.weights, self.shifts, self.pairs = family, names, weights, shifts, pairs

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of every text (row) for every machine (column)."""
        spaced, bounds = _spaced(data, offsets)
        grams = _grams(spaced)
        out = np.empty((len(offsets) - 1, len(self.pairs)))
        for j in range(len(self.pairs)):
            w = self.weights[j]
            sums = np.add.reduceat(w[grams[0]] + w[grams[1]] + w[grams[2]], bounds[:-1]) if len(offsets) > 1 else np.zeros(0)
            out[:, j] = sums / np.diff(bounds) + self.shifts[j]
        return out

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(margins)
        if not self.names:
            return [UNKNOWN] * n, np.zeros(n)
        families = sorted(set(self.family.values()))
        which, sure = self._vote(margins, "family", families)
        lang, score = np.empty(n, object), np.zeros(n)
        for k, name in enumerate(families):
            own = sorted(x for x in self.names if self.family[x] == name)
            rows = np.flatnonzero(which == k)
            best, p = self._vote(margins[rows], name, own)
            lang[rows] = np.array(own, object)[best]
            score[rows] = sure[rows] * p
        return lang.tolist(), score

    def _vote(self, margins: np.ndarray, level: str, options: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-one: most duels won, then the larger sum of margins; least winning probability."""
        n = len(margins)
        votes, totals = np.zeros((n, len(options))), np.zeros((n, len(options)))
        least = np.ones((n, len(options)))
        for j, (where, a, b) in enumerate(self.pairs):
            if where != level:
                continue
            i, k, m = options.index(a), options.index(b), margins[:, j]
            p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
            for at, won, margin, chance in ((i, m >= 0, m, p), (k, m < 0, -m, 1 - p)):
                votes[:, at] += won
                totals[:, at] += margin
                least[:, at] = np.minimum(least[:, at], chance)
        best = np.argmax(votes + 1e-9 * np.tanh(totals), axis=1) if n else np.zeros(0, int)
        return best, least[np.arange(n), best]

    @classmethod
    def fit(cls, texts: list[bytes], langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
        names = sorted(set(langs))
        known = {code: name for name, codes in families.items() for code in codes}
        family = {x: known.get(x, f"only {x}") for x in names}
        x, y = _frequencies(texts), np.array(langs, object)
        scale = 1 / np.sqrt((x**2).mean(0) + 1e-8) if len(x) else np.ones(_SIZE)
        x = x * scale / np.sqrt(_SIZE)
        of = np.array([family[v] for v in langs], object)
        weights, shifts, pairs = [], [], []
        for level, column in [("family", of), *((f, np.where(of == f, y, None)) for f in sorted(set(family.values())))]:
            for a, b in combinations(sorted({v for v in column if v is not None}), 2):
                rows = np.flatnonzero((column == a) | (column == b))
                w, shift = _svm(x[rows], np.where(column[rows] == a, 1.0, -1.0))
                weights.append((w * scale / np.sqrt(_SIZE)).astype(np.float32))
                shifts.append(shift)
                pairs.append((level, a, b))
        return cls(family, names, np.array(weights), np.array(shifts), pairs)


def _frequencies(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), _SIZE))
    for i, text in enumerate(texts):
        spaced, bounds = _spaced(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        for grams in _grams(spaced):
            out[i] += np.bincount(grams, minlength=_SIZE)
        out[i] /= bounds[1]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 30000.0, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes of equal weight, by
    accelerated gradient descent; the shift is a regularised weight of its own."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean()) * cost / len(y)
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    rate = np.float32(1 / (1 + 2 * weight.max() * _top(a)))
    w = v = np.zeros(a.shape[1], np.float32)
    for t in range(rounds):
        gap = np.maximum(0, 1 - y * (a @ v))
        after = v - rate * (v - 2 * a.T @ (weight * y * gap))
        v = after + np.float32(t / (t + 3)) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def _top(a: np.ndarray) -> float:
    """An upper estimate of the largest eigenvalue of a.T @ a, by power iteration."""
    v = np.full(a.shape[1], a.shape[1] ** -0.5, a.dtype)
    for _ in range(30):
        v = a.T @ (a @ v)
        size = np.linalg.norm(v)
        v /= size
    return 1.05 * float(size)


def train(docs: DataFrame, per_language: int = 300, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """Learns from text and lang of at most 1.5 * per_language rows of each language; null rows are left out."""
    rows = per_class(docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null and length(text) > 0"), "doc_id", "lang", per_language).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["text"]))
    return LanguageModel.fit([r["text"].encode() for r in rows], [r["lang"] for r in rows], families)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for every row of docs, from whole texts, within partitions.

    Null texts and texts without a letter (any alphabet) are ``und`` with score 0, as is
    every text if nothing was learned; repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, langs, scores in _predicted(batches, model):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(of, OUT)


def _predicted(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    for rows, data, offsets in steps(batches):
        letters = np.diff(np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))[offsets]) > 0
        for i in np.flatnonzero(~letters):
            letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        langs, scores = model.predict(model.margins(data, offsets))
        yield rows, [x if ok else UNKNOWN for x, ok in zip(langs, letters.tolist(), strict=True)], np.where(letters, scores, 0.0)


def relabel(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with their columns and lang set to the prediction; documents that are ``und`` go."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, langs, _ in _predicted(batches, model):
            at = rows.schema.get_field_index("lang")
            yield rows.set_column(at, "lang", pa.array(langs, pa.string())).filter(pa.array([x != UNKNOWN for x in langs]))

    rows = docs.withColumn("lang", F.lit(None).cast("string"))
    return rows.mapInArrow(of, rows.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts for every document; those with crc32(id) mod 5 = 0 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 5) != 0))
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
