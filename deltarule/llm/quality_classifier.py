"""Operator 4, quality classifier: which of two zstandard dictionaries describes a text better?

One dictionary is built from good and one from bad labelled text. A text's feature is the
difference of its two compressed sizes over its own length; a logistic curve, fitted on
labelled texts that are in neither dictionary, turns that into a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarule.llm.common import crc_mod, small_batches, steps, table
from deltarule.llm.samples import per_class

CHUNK = 2048
OUT = "doc_id long, score double, difference double"


class CompressionModel:
    """Two raw-content dictionaries and a calibration; plain bytes and floats, so it pickles."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3, slope: float = 1.0, shift: float = 0.0):
        self.good, self.bad, self.level, self.slope, self.shift = good, bad, level, slope, shift

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.bad, self.good):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False))
        return made

    @staticmethod
    def difference(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> float:
        """Bits per byte that the good dictionary saves against the bad one; 0 for an empty text.

        The whole text counts, in chunks, as else a long text's own beginning would serve it
        better than either dictionary."""
        if not text:
            return 0.0
        parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        bad, good = (sum(len(c.compress(part)) for part in parts) for c in compressors)
        return 8 * (bad - good) / len(text)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.shift, -30, 30)))

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], dictionary_bytes: int, piece: int = 1024, share: float = 0.5, level: int = 3) -> CompressionModel:
        """Fills the dictionaries with pieces of half of the texts and calibrates on the others.

        piece: bytes that one text gives a dictionary, so that many texts stand in it; they
        begin anywhere in the text. share: of label 1 among all labelled rows. With one class
        only, the score is constant: that class; with no texts, one half.
        """
        if len(set(labels)) < 2:
            return cls(b"", b"", level, 0.0, 30.0 * (2 * labels[0] - 1) if labels else 0.0)
        content: dict[int, list[bytes]] = {0: [], 1: []}
        rest = []
        for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
            kept = content[label]
            if i % 2 == 0 and sum(map(len, kept)) < dictionary_bytes:
                begin = zlib.crc32(text) % max(1, len(text) - piece + 1)
                kept.append(text[begin : begin + piece])
            else:
                rest.append((text, label))
        model = cls(*(b"\n".join(content[x])[:dictionary_bytes].ljust(8) for x in (1, 0)), level)
        pair = model.compressors()
        x = np.array([cls.difference(t, pair) for t, _ in rest])
        y = np.array([label for _, label in rest], float)
        model.slope, model.shift = _logistic(x, y, share)
        return model


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Newton's method on a slope and a shift, label 1 weighted to its share of all rows, slightly regularised."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 1500, dictionary_bytes: int = 448 * 1024, level: int = 3) -> CompressionModel:
    """Fits on at most 1.5 * per_label texts of each label; labels and docs share doc_id.

    The sample is chosen among labels alone and is small (a bound times two), so only its
    texts leave the documents, by a broadcast of the ids. Null labels and texts are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg("label")).first()[0] or 0.0
    chosen = per_class(known, "doc_id", "label", per_label)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: (_spread(r["doc_id"]), r["text"]))
    return CompressionModel.fit([r["text"].encode() for r in rows], [r["label"] for r in rows], dictionary_bytes, share=min(max(share, 0.01), 0.99), level=level)


def _spread(doc_id: int) -> int:
    return doc_id * 0x9E3779B97F4A7C15 % (1 << 64)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and difference, for every row of docs.

    Whole texts are compressed, within partitions; null reads as empty, which has difference 0.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for rows, data, offsets in steps(batches):
            raw = data.tobytes()
            found = np.array([model.difference(raw[a:b], pair) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], float)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(found)), pa.array(found)], ["doc_id", "score", "difference"])

    return docs.select("doc_id", "text").mapInArrow(of, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of documents with crc32(id) mod 4 = 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "difference",
    )
