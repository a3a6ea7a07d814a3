"""Operator 2, suffix-array dedup: bytes of long repeated strings, by prefix doubling.

The ranks are content names (Rabin-Karp hashes), so the rank of position p + offset
needs no join. Round one ranks positions by the pair of names of 128 bytes at p and
p + 128, round two by the pair of 256 bytes at p and p + 144, which is past the
threshold of 400; unique positions drop out between rounds. Ranking every byte position
would shuffle some twenty times the input, so round one ranks only anchors, the
positions that content selects so that every string of 400 bytes holds one
(``repeats``); no repeated string is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deltarule.llm.common import steps, table
from deltarule.llm.repeats import Plan, covered, spans, with_repeats

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, {} string, removed array<struct<first:long,last:long>>"


def suffix_dedup(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """Removes each byte that a repeated string of ``threshold`` bytes covers, in all its places.

    docs: any frame with doc_id and text; other columns are ignored. Texts count as UTF-8
    bytes, null as empty; matches never cross documents and may overlap themselves; equal
    rows are copies of each other. An empty table gives an empty result.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_text (bytes that are left, with U+FFFD
    for code points that a cut splits) and removed: the maximal removed runs as byte offsets.
    """
    return _run(docs, threshold, False)


def _run(docs: DataFrame, threshold: int, digest: bool) -> DataFrame:
    plan = Plan("byte", threshold, max(2, threshold * 16 // 25), earlier=False)
    return with_repeats(docs, plan).mapInArrow(_cut(threshold, digest), OUT.format("kept_sha256" if digest else "kept_text"))


def _cut(threshold: int, digest: bool):
    runs = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            gone = covered(*spans(rows.column("spans")), offsets, threshold)
            lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets])
            kept, removed = [], []
            for i in range(rows.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                cuts = np.zeros(0, np.int64)
                if lost[i]:
                    mask = gone[offsets[i] : offsets[i + 1]]
                    cuts = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                    own = own[~mask]
                raw = own.tobytes()
                kept.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8", "replace"))
                removed.append([{"first": a, "last": b} for a, b in cuts.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [rows.column("rest").field("doc_id"), pa.array(np.diff(offsets)), pa.array(lost), pa.array([len(x) for x in removed], pa.int64()), pa.array(kept, pa.string()), pa.array(removed, runs)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept_text", "removed"],
            )

    return of


def query(spark: SparkSession, sf_dir: str, threshold: int = 400) -> DataFrame:
    """The operator over all documents, with a digest in place of each kept text."""
    return _run(table(spark, sf_dir, "documents"), threshold, True).drop("removed")
