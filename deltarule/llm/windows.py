"""Counts the Rabin-Karp hash of every window of words, and tells documents which windows an earlier one has.

Documents are spread by hash over *chunks* of about CHUNK_BYTES of text, hash values over as
many *ranges*. Both numbers follow the size of the corpus; a task holds one chunk or one range.

1. A chunk hashes each window of its documents and pre-aggregates: a hash once, with the
   smallest document id. For each range it sends the sorted hashes as one packed row.
2. A range counts what all chunks sent: the smallest id of each hash in the corpus. It answers
   each chunk with one bit for each hash that it sent: whether a smaller id has it elsewhere.
3. The chunk hashes its windows again and reads the bits, so windows are never rows of a table.

A hash has 80 bits, made of two overlapping parts of the window. Work and shuffled bytes grow
with the number of windows. A hash, however frequent, reaches its range once from each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from deltarule.llm.common import NO_ID, Rolling, mix, release, small_batches, steps, word_bounds, word_hashes

#: Bytes of text in a chunk, on average; a longer document makes its chunk longer.
CHUNK_BYTES = 4 << 20
#: Partitions of a shuffle; beyond it a partition holds several chunks, one after the other.
MOST_TASKS = 50_000
SENT = "chunk int, range int, hashes binary, more binary, ids binary, owner binary"
ANSWERS = "chunk int, range int, bits binary"

#: Cuts a step of documents: its rows, bytes, offsets, words (first, last, bounds) and which words go.
Cut = Callable[..., pa.RecordBatch]


@dataclass
class Windows:
    """All windows of a chunk: document id and hash of each; ``order`` sorts them by hash,
    ``starts`` are the places in that order at which another hash begins."""

    ids: np.ndarray
    hashes: np.ndarray
    more: np.ndarray
    order: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> Windows:
        order = np.argsort(hashes, kind="stable")
        begins = _begins(hashes[order], more[order])
        if (begins[1:] & (hashes[order[1:]] == hashes[order[:-1]])).any():  # 64 bits agree, 80 do not
            order = np.lexsort((more, hashes))
            begins = _begins(hashes[order], more[order])
        return cls(ids, hashes, more, order, np.flatnonzero(begins))

    def least_ids(self) -> np.ndarray:
        return np.minimum.reduceat(self.ids[self.order], self.starts) if len(self.starts) else np.zeros(0, np.int64)

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.order)))


def _begins(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    begins = np.ones(len(hashes), bool)
    begins[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
    return begins


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that those which hardly differ compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(raw: bytes | pa.Buffer, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _hashed(batches: list[pa.RecordBatch], width: int) -> Windows:
    part = 1 << (width.bit_length() - 1)
    ids, hashes, more = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    for rows, data, offsets in steps(iter(batches)):
        first, last, bounds = word_bounds(data, offsets)
        lengths = np.maximum(np.diff(bounds) - width + 1, 0)
        rolling = Rolling(word_hashes(data, first, last))
        at = np.arange(lengths.sum()) + np.repeat(bounds[:-1] - np.cumsum(lengths) + lengths, lengths)
        head, tail = rolling.at(at, at + part), rolling.at(at + width - part, at + width)
        ids.append(np.repeat(rows.column("rk").to_numpy(zero_copy_only=False), lengths))
        hashes.append(mix(head * np.uint64(3) + tail))
        more.append((mix(head ^ (tail << np.uint64(1))) >> np.uint64(48)).astype(np.uint16))
    return Windows.of(np.concatenate(ids), np.concatenate(hashes), np.concatenate(more))


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """First place of each range, and the end, in sorted hashes."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def _send(width: int, ranges: int):
    def of(chunk: pa.Table) -> pa.Table:
        release()
        found = _hashed(chunk.to_batches(), width)
        firsts = found.order[found.starts]
        hashes, more, least = found.hashes[firsts], found.more[firsts], found.least_ids()
        known, owner = np.unique(least, return_inverse=True)
        cuts = _ranges(hashes, ranges)
        out: dict[str, list] = {c.split()[0]: [] for c in SENT.split(", ")}
        number = chunk.column("chunk")[0].as_py()
        for r in np.flatnonzero(np.diff(cuts)):
            piece = slice(cuts[r], cuts[r + 1])
            used = np.zeros(len(known), bool)
            used[owner[piece]] = True
            place = (np.cumsum(used) - 1).astype(np.uint32)
            row = number, int(r), _planes(np.diff(hashes[piece], prepend=np.uint64(0))), _planes(more[piece]), known[used].tobytes(), _planes(place[owner[piece]])
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return of


def _answer(sent: pa.Table) -> pa.Table:
    """One range: which hashes of each chunk have a smaller id in another chunk."""
    release()
    columns = {c: sent.column(c).combine_chunks() for c in ("hashes", "more", "ids", "owner")}
    raw = lambda c, i: columns[c][i].as_buffer()
    ends = np.cumsum([raw("hashes", i).size // 8 for i in range(sent.num_rows)])
    hashes, more, ids = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint16), np.empty(ends[-1], np.int64)
    for i, end in enumerate(ends):
        piece = slice(ends[i - 1] if i else 0, end)
        np.cumsum(_values(raw("hashes", i), np.uint64), out=hashes[piece])
        more[piece] = _values(raw("more", i), np.uint16)
        ids[piece] = np.frombuffer(raw("ids", i), np.int64)[_values(raw("owner", i), np.uint32)]
    found = Windows.of(ids, hashes, more)
    later = np.zeros(len(found.order), bool)
    later[found.order] = found.ids[found.order] > np.repeat(found.least_ids(), found.sizes())
    parts = np.split(later, ends[:-1])
    kept = [i for i, p in enumerate(parts) if p.any()]
    return pa.table({
        "chunk": sent.column("chunk").take(pa.array(kept, pa.int64())), "range": sent.column("range").take(pa.array(kept, pa.int64())),
        "bits": pa.array([np.packbits(parts[i]).tobytes() for i in kept], pa.binary()),
    })


def _apply(width: int, ranges: int, cut: Cut, schema: pa.Schema):
    def of(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        batches = chunk.to_batches()
        found = _hashed(batches, width)
        cuts = _ranges(found.hashes[found.order[found.starts]], ranges)
        elsewhere = np.zeros(len(found.starts), bool)
        for r, bits in zip(answers.column("range").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            elsewhere[cuts[r] : cuts[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[r + 1] - cuts[r])
        again = np.zeros(len(found.order), bool)
        again[found.order] = np.repeat(elsewhere, found.sizes()) | (found.ids[found.order] > np.repeat(found.least_ids(), found.sizes()))
        return pa.Table.from_batches(list(_cut_all(batches, again, width, cut))).cast(schema)

    return of


def _cut_all(batches: list[pa.RecordBatch], again: np.ndarray, width: int, cut: Cut) -> Iterator[pa.RecordBatch]:
    done = 0
    for rows, data, offsets in steps(iter(batches)):
        first, last, bounds = word_bounds(data, offsets)
        lengths = np.maximum(np.diff(bounds) - width + 1, 0)
        total = int(lengths.sum())
        at = (np.arange(total) + np.repeat(bounds[:-1] - np.cumsum(lengths) + lengths, lengths))[again[done : done + total]]
        done += total
        edge = np.bincount(at, minlength=bounds[-1] + 1) - np.bincount(at + width, minlength=bounds[-1] + 1)
        yield cut(rows, data, offsets, bounds, np.cumsum(edge[:-1]) > 0)


def cut_earlier(docs: DataFrame, width: int, keep: list[str], cut: Cut, out: str) -> DataFrame:
    """docs through ``cut``, which is told the words of windows that a document with a smaller id has.

    cut gets rows with rest (a struct of the columns to keep) and text, and returns columns as
    ``out`` says. A null id counts as largest; documents with one id are not earlier than each
    other. Texts too short for a window never move. Rows alike in id, text and kept columns
    share a chunk.
    """
    small_batches(docs.sparkSession)
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rk"),
        F.col("text").cast("string").alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest"),
    )
    long = F.coalesce(F.octet_length("text") >= 2 * width - 1, F.lit(False))
    size = base.filter(long).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(max(1, -(-size // CHUNK_BYTES)))
    chunk = F.pmod(F.xxhash64("rk", "text", F.to_json("rest")), F.lit(parts)).cast("int")
    # a stated number of partitions is not coalesced: a task sorts and holds few chunks or ranges
    tasks = min(parts, MOST_TASKS)
    spread = base.filter(long).withColumn("chunk", chunk).repartition(tasks, "chunk")
    sent = spread.groupBy("chunk").applyInArrow(_send(width, parts), SENT).repartition(tasks, "range")
    answers = sent.groupBy("range").applyInArrow(_answer, ANSWERS)
    schema = to_arrow_schema(StructType.fromDDL(out))  # grouped Arrow results must agree in nullability too
    done = spread.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_apply(width, parts, cut, schema), out)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut_all([batch], np.zeros(0, bool), width, cut)

    return done.unionByName(base.filter(~long).mapInArrow(short, out))
