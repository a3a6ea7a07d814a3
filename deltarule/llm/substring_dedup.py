"""Operator 1, substring dedup: repeated windows of words merge into maximal removal intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarule.llm.common import table
from deltarule.llm.windows import cut_earlier

OUT = "rest {}, n_words long, n_removed long, kept_text string"


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Removes words that stand in a passage of ``window`` words known from an earlier document.

    docs: any frame with doc_id and text; other columns are ignored. Rabin-Karp hashes
    of every window are counted as ``windows`` describes; a word goes if some window
    over it also starts in a document with a smaller id (a null id counts as largest).
    Null, empty or short texts lose nothing; of rows with one id none counts as earlier,
    so equal rows have equal results. An empty table gives an empty result.

    Returns doc_id, n_words, n_removed and kept_text: the kept words joined by one space,
    or the text itself, null included, if nothing was removed.
    """
    return _run(docs, window, False, ["doc_id"]).select("rest.doc_id", "n_words", "n_removed", "kept_text")


def cut(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with their columns, repeated passages cut out of text; texts left without a word go.

    A text that loses nothing stays as it is; n_chars, if there, follows the text."""
    found = _run(docs, window, False, [c for c in docs.columns if c != "text"])
    found = found.filter("n_removed = 0 or n_removed < n_words")
    sizes = {"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    column = lambda c: F.col("kept_text") if c == "text" else sizes.get(c, F.col(f"rest.`{c}`"))
    return found.select(*(column(c).alias(c) for c in docs.columns))


def _run(docs: DataFrame, window: int, digest: bool, keep: list[str]) -> DataFrame:
    out = OUT.format(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep))).schema[0].dataType.simpleString())
    return cut_earlier(docs, window, keep, _cut(digest), out.replace("kept_text", "kept_sha256") if digest else out)


def _cut(digest: bool):
    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds])
        raw, texts = data.tobytes(), rows.column("text")
        kept = []
        for i in range(rows.num_rows):
            if not lost[i] and not digest:
                kept.append(texts[i].as_py())
                continue
            words = raw[offsets[i] : offsets[i + 1]].split()
            if lost[i]:
                words = [w for w, g in zip(words, gone[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not g]
            text = b" ".join(words)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays(
            [rows.column("rest"), pa.array(np.diff(bounds)), pa.array(lost.astype(np.int64)), pa.array(kept, pa.string())],
            ["rest", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
        )

    return of


def query(spark: SparkSession, sf_dir: str, window: int = 50) -> DataFrame:
    """The operator over all documents, with a digest in place of each kept text."""
    return _run(table(spark, sf_dir, "documents"), window, True, ["doc_id"]).select("rest.doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS lo FROM h GROUP BY k),
r AS (SELECT h.doc_id, list(DISTINCT p) AS ps FROM h JOIN m USING (k) WHERE h.doc_id > m.lo GROUP BY h.doc_id),
c AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM (SELECT doc_id, unnest(ps) AS p FROM r)) GROUP BY doc_id),
g AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS q FROM d JOIN c USING (doc_id)),
k AS (SELECT g.doc_id, count(*) AS n, string_agg(w[q], ' ' ORDER BY q) AS t FROM g JOIN c USING (doc_id)
      WHERE NOT list_contains(c.gone, q) GROUP BY g.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
       CASE WHEN c.doc_id IS NULL THEN 0 ELSE len(d.w) - coalesce(k.n, 0) END::BIGINT AS n_removed,
       sha256(CASE WHEN c.doc_id IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(k.t, '') END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
