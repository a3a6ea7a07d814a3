"""Operator 3, quality rules: compression bands.

zstandard ratios (bytes over compressed bytes) of the whole text and of its fixed
chunks must lie in bands that depend on their length; above a band a text is
repetitive, below it is close to random. A band is the narrower of a fixed one, which
holds for any corpus, and of one fitted on all documents: the median ratio of texts
of that length (four classes an octave), or of all full chunks, and so many robust
deviations around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarule.llm.common import mix, small_batches, steps, table, word_bounds, word_hashes

#: Bytes of the text (below), least and greatest ratio of the whole text. Longer texts
#: compress better as they hold more to refer to. From 128 bytes on, the least ratio lies
#: between those of random letters and digits (1.23, 1.37, 1.40, 1.40) and of prose (1.34,
#: 1.43, 1.92, 2.33).
BANDS = ((128, 0.4, 3.0), (512, 1.25, 3.2), (2048, 1.4, 4.2), (16384, 1.6, 5.0), (1 << 62, 1.8, 6.0))
OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long, reason string"
)


#: Classes of length in an octave, and documents that a class needs to be fitted.
CLASSES, FEWEST = 4, 32
#: In place of a length class: a full chunk.
CHUNK = -1


@dataclass(frozen=True)
class Limits:
    """bands: as BANDS; chunk: bytes of a chunk; below and above: robust deviations from the
    median at which a fitted band ends; chunk_share: share of chunks outside their bands from
    which a text is rejected."""

    bands: tuple = BANDS
    level: int = 3
    chunk: int = 1024
    below: float = 6.0
    above: float = 4.0
    chunk_share: float = 0.25


def length_class(n: int) -> int:
    """Number of the class of n bytes (n > 0)."""
    return int(np.floor(CLASSES * np.log2(n)))


Fitted = dict[int, tuple[float, float]]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def fit(docs: DataFrame, limits: Limits = Limits()) -> Fitted:
    """Least and greatest ratio of each length class, from all documents that pass the base rule.

    The deviation is that of a normal distribution with the same quartiles, a hundredth of
    the median at least. Classes of fewer than FEWEST documents are left to the fixed bands,
    and so is an empty table. One row a class, some 250 at most, reaches the driver.
    """
    small_batches(docs.sparkSession)
    ratios = docs.select("doc_id", "text").mapInArrow(lambda batches: _ratios(batches, limits), "class int, ratio double")
    quartiles = F.percentile("ratio", F.lit([0.25, 0.5, 0.75])).alias("q")  # of ratios rounded to thousandths, so few values are held
    rows = ratios.groupBy("class").agg(F.count(F.lit(1)).alias("n"), quartiles).filter(F.col("n") >= FEWEST).collect()
    out = {}
    for r in rows:
        low, middle, high = r["q"]
        deviation = max((high - low) / 1.349, middle / 100)
        out[r["class"]] = middle - limits.below * deviation, middle + limits.above * deviation
    return out


def band(n: int, limits: Limits, fitted: Fitted, full_chunk: bool = False) -> tuple[float, float]:
    """Least and greatest ratio of n bytes."""
    _, low, high = next(b for b in limits.bands if n < b[0])
    own_low, own_high = fitted.get(CHUNK if full_chunk else length_class(n), (low, high)) if n else (low, high)
    return max(low, own_low), min(high, own_high)


def compression_bands(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document with its counts, ratios and verdict: a pass that fits the bands, and one that judges.

    docs: any frame with doc_id and text; other columns are ignored, repeated rows give
    repeated results. Null reads as empty; an empty text has no words (base_failed), ratio 0
    and no chunks. The last chunk ends with the text; a text shorter than a chunk is one chunk. reason is null for kept documents, else base, incompressible, repetitive,
    or chunks.
    """
    fitted = fit(docs, limits)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _judge(batches, limits, fitted), OUT)


def _base(data: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words in repeated windows, and whether the base rule fails, for each document."""
    n_words = np.diff(bounds)
    repeat_words = _per_doc(_repeated(word_hashes(data, first, last), bounds), bounds)
    return n_words, repeat_words, (n_words < 50) | (100 * repeat_words > 50 * n_words)


def _chunks(text: bytes, size: int) -> list[bytes]:
    """The text in chunks of one size, the last of which ends with the text and may overlap the one before; a shorter text is a chunk."""
    return [text[min(j, max(0, len(text) - size)) :][:size] for j in range(0, len(text), size)]


def _ratios(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=limits.level)
    for _, data, offsets in steps(batches):
        *_, failed = _base(data, *word_bounds(data, offsets))
        raw, kept = data.tobytes(), np.flatnonzero(~failed)
        texts = [raw[offsets[i] : offsets[i + 1]] for i in kept.tolist()]
        chunks = [c for x in texts if len(x) >= limits.chunk for c in _chunks(x, limits.chunk)]
        classes = [length_class(len(x)) for x in texts] + [CHUNK] * len(chunks)
        found = [round(len(x) / len(zstd.compress(x)), 3) for x in texts + chunks]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(found, pa.float64())], ["class", "ratio"])


def _judge(batches: Iterator[pa.RecordBatch], limits: Limits, fitted: Fitted) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=limits.level)
    full = band(limits.chunk, limits, fitted, True)
    for rows, data, offsets in steps(batches):
        first, last, bounds = word_bounds(data, offsets)
        n_words, repeat_words, base_failed = _base(data, first, last, bounds)
        starts_char = (data & 0xC0) != 0x80
        in_word = np.zeros(len(data) + 1, np.int64)
        np.add.at(in_word, first, 1)
        np.add.at(in_word, last, -1)
        word_chars = _per_doc(starts_char & (np.cumsum(in_word[:-1]) > 0), offsets)
        n_symbols = _per_doc(_SYMBOL[data], offsets)
        raw = data.tobytes()
        ratios, bad, chunks, dup_lines, reasons = [], [], [], [], []
        for i in range(rows.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            lines = [x for x in text.split(b"\n") if x.split()]
            dup_lines.append(len(lines) - len(set(lines)))
            ratio = len(text) / len(zstd.compress(text)) if text else 0.0
            parts = _chunks(text, limits.chunk)
            out = 0
            for x in parts:
                least, most = full if len(x) == limits.chunk else band(len(x), limits, fitted)
                out += not least <= len(x) / len(zstd.compress(x)) <= most
            low, high = band(len(text), limits, fitted)
            ratios.append(ratio)
            bad.append(out)
            chunks.append(len(parts))
            reasons.append(
                "base" if base_failed[i] else "incompressible" if ratio < low else "repetitive" if ratio > high
                else "chunks" if out and out >= limits.chunk_share * len(parts) else None
            )
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, dup_lines, repeat_words)), pa.array(base_failed),
             pa.array([x is None for x in reasons]), pa.array(ratios, pa.float64()), pa.array(bad, pa.int64()), pa.array(chunks, pa.int64()), pa.array(reasons, pa.string())],
            [x.split()[0] for x in OUT.split(", ")],
        )


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def _repeated(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks words in a 3-word window that its document holds twice or more."""
    marked = np.zeros(len(words), bool)
    if len(words) < 3:
        return marked
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key = mix(mix(mix(words[at]) + words[at + 1]) + words[at + 2]) + mix(doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    for k in range(3):
        marked[at[twice] + k] = True
    return marked


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over all documents, with the limits as they are; nulls, empty texts and repeated rows as there."""
    return compression_bands(table(spark, sf_dir, "documents"))
