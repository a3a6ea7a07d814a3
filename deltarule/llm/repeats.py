"""Exact search for windows of fixed width that repeat in a corpus, without shuffling every window.

Windows are judged by Rabin-Karp hashes of all their symbols (words or bytes). Each
window owns one *anchor*: the slice of ``k`` symbols in it with the smallest hash
(leftmost of ties). The anchor depends on the window's content alone, so equal windows
have equal anchors at equal places. Consecutive windows with one anchor are a *run*;
its hash covers all bytes of the run. Then

1. Spark counts anchors. A window whose anchor occurs once is unique and drops out.
2. Equal runs are equal in each of their windows, so where all runs of an anchor are
   equal they are decided together. This holds for the inside of every copied passage.
3. Only where runs of one anchor differ, at the ends of passages, do their windows
   become rows of their own, counted by a pair of hashes of overlapping parts (128 bits).

Nothing is sampled or capped: every window is decided as if all had been shuffled.
Rows are keyed by (id, hash of the text), so rows that share an id stay apart. Keys of
hot anchors are pre-aggregated before each shuffle, and the joins are plain equi-joins
that adaptive execution splits. Memory of a task is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltarule.llm.common import BYTE_VALUE, NO_ID, Rolling, join_totals, small_batches, steps, with_checkpoints, word_bounds, word_hashes

RUNS = "k long, ctx long, rk long, pk long, lo long"
WINDOWS = "ra long, rb long, rk long, th long, lo long"


@dataclass(frozen=True)
class Plan:
    """unit: "word" or "byte"; width: symbols of a window; k: symbols of an anchor.

    earlier: a window counts as repeated only if an equal one starts in a document with
    a smaller id; otherwise, if an equal one starts anywhere else.
    """

    unit: str
    width: int
    k: int
    earlier: bool

    def __post_init__(self) -> None:
        if not 2 <= self.k <= self.width < 1 << 15:
            raise ValueError("needs 2 <= k <= width < 32768")


def symbols(plan: Plan, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if plan.unit == "byte":
        return BYTE_VALUE[data], offsets
    first, last, bounds = word_bounds(data, offsets)
    return word_hashes(data, first, last), bounds


def find_runs(rolling: Rolling, offsets: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run: document, first window, number of windows, place of the anchor."""
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    total, none = int(lengths.sum()), np.zeros(0, np.int64)
    if not total:
        return none, none, none, none
    grams = (rolling.every(k) >> np.uint64(32)).astype(np.uint32)
    span, reach = width - k + 1, 1
    least = grams
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    at = np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(offsets[:-1], lengths)
    value = least[at]
    follows = np.empty(total, bool)
    follows[0] = False
    follows[1:] = at[1:] == at[:-1] + 1
    entered = np.zeros(total, bool)
    entered[1:] = follows[1:] & (value[1:] < value[:-1])
    left = np.zeros(total, bool)
    left[1:] = follows[1:] & (grams[at[:-1]] == value[:-1])
    begins = np.flatnonzero(~follows | entered | left | np.concatenate(([True], value[1:] != value[:-1])))
    first = at[begins]
    anchor = first + span - 1
    search = np.flatnonzero(~entered[begins])
    for part in np.array_split(search, max(1, len(search) * span // 4_000_000)):
        anchor[part] = first[part] + np.argmin(grams[first[part][:, None] + np.arange(span)], axis=1)
    return doc[begins], first, np.diff(np.append(begins, total)), anchor


def rank_pair(rolling: Rolling, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks (content names) of two overlapping parts, of a power of two each, that make up a window."""
    part = 1 << (width.bit_length() - 1)
    return rolling.at(at, at + part), rolling.at(at + width - part, at + width)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(np.ascontiguousarray(v).view(np.int64)) for k, v in columns.items()})


def _runs(plan: Plan) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            values, bounds = symbols(plan, data, offsets)
            rolling = Rolling(values)
            doc, first, count, anchor = find_runs(rolling, bounds, plan.width, plan.k)
            if not len(doc):
                continue
            half = plan.k // 2
            # the rank pair of the anchor: names of its halves, renamed as one
            key = rolling.at(anchor, anchor + half) * np.uint64(3) + rolling.at(anchor + half, anchor + plan.k)
            ctx = rolling.at(first, first + count - 1 + plan.width) + count.astype(np.uint64)
            rk, th = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rk", "th"))
            local = first - bounds[doc]
            yield _batch({"k": key, "ctx": ctx, "rk": rk[doc], "pk": (th[doc] << 16) | count, "lo": local})

    return of


def _windows(plan: Plan) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(_listed(batches)):
            values, bounds = symbols(plan, data, offsets)
            rolling = Rolling(values)
            doc, lo, count = spans(rows.column("spans"))
            owner = np.repeat(np.arange(len(doc)), count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + lo[owner]
            ra, rb = rank_pair(rolling, at + bounds[doc[owner]], plan.width)
            rk, th = (rows.column(c).to_numpy(zero_copy_only=False)[doc[owner]] for c in ("rk", "th"))
            yield _batch({"ra": ra, "rb": rb, "rk": rk, "th": th, "lo": at})

    return of


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.filter(batch.column("spans").is_valid())
        if kept.num_rows:
            yield kept


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, firsts and counts of a list<struct<lo, n>> column."""
    column = pa.array(column) if not isinstance(column, pa.Array) else column
    flat, owner = column.flatten(), np.asarray(column.value_lengths().fill_null(0))
    lo, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return np.repeat(np.arange(len(column)), owner), lo, n


def covered(doc: np.ndarray, lo: np.ndarray, n: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Marks every symbol of a step that some repeated window covers."""
    edge = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(edge, lo + bounds[doc], 1)
    np.add.at(edge, lo + n - 1 + width + bounds[doc], -1)
    return np.cumsum(edge[:-1]) > 0


def keyed(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """rk: the id, NO_ID for null; th: 31 bits of the text's hash; text; rest: a struct of the columns to keep."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rk"),
        F.xxhash64("text").bitwiseAND(0x7FFFFFFF).alias("th"),
        F.col("text").cast("string").alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest"),
    )


def with_repeats(docs: DataFrame, plan: Plan, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """rest (a struct of the columns to keep), text and spans: list of (lo, n), the runs of
    repeated windows, null if none."""
    spark = docs.sparkSession
    small_batches(spark)
    with_checkpoints(spark)
    base = keyed(docs, keep)
    runs = base.select("rk", "th", "text").mapInArrow(_runs(plan), RUNS)
    several = F.col("r0") < F.col("r1") if plan.earlier else F.col("r0") > 1
    # r0: of an earlier-document plan the smallest id, else the number of rows
    counts = [F.min("rk").alias("r0"), F.max("rk").alias("r1")] if plan.earlier else [F.count(F.lit(1)).alias("r0")]
    groups = (
        runs.groupBy("k")
        .agg(F.min("ctx").alias("c0"), F.max("ctx").alias("c1"), *counts)
        .filter(several)
        .select("k", "r0", (F.col("c0") != F.col("c1")).alias("mixed"))
    )
    hits = join_totals(runs, groups, ["k"]).checkpoint()
    mixed = hits.filter("mixed").select("k", "ctx", "rk", "pk", "lo")
    ctxs = mixed.groupBy("k", "ctx").agg(F.count(F.lit(1)).alias("cc"), F.min(F.struct("rk", "pk", "lo")).alias("one"))
    mixed = join_totals(mixed, ctxs, ["k", "ctx"])
    if plan.earlier:
        known = hits.filter("not mixed and rk > r0"), mixed.filter("rk > one.rk")
        open_ = mixed.filter("rk = one.rk")
    else:
        known = hits.filter("not mixed"), mixed.filter("cc > 1")
        open_ = mixed.filter("cc = 1 or (rk = one.rk and pk = one.pk and lo = one.lo)")
    parts = ["rk", F.shiftright("pk", 16).alias("th"), "lo", F.col("pk").bitwiseAND(0xFFFF).alias("n")]
    as_list = F.collect_list(F.struct("lo", "n")).alias("spans")
    asked = open_.select(*parts).groupBy("rk", "th").agg(as_list)
    windows = base.join(asked, ["rk", "th"], "left").mapInArrow(_windows(plan), WINDOWS)
    again = windows.groupBy("ra", "rb").agg(*counts).filter(several).select("ra", "rb", "r0")
    found = join_totals(windows, again, ["ra", "rb"])
    if plan.earlier:
        found = found.filter("rk > r0")
    found = found.select("rk", "th", "lo", F.lit(1).cast("long").alias("n"))
    every = known[0].select(*parts).unionByName(known[1].select(*parts)).unionByName(found)
    return base.join(every.groupBy("rk", "th").agg(as_list), ["rk", "th"], "left").select("rest", "text", "spans")
