"""Operator 10, exact top-k search: a Voronoi kNN join for inner products.

Rows are grouped by their nearest pivot, and so are queries. A query's own bound is its
k-th best score among the pivots, which are rows themselves, or what the k rows of the
best groups reach at least. A group's summary is small:
its rows, its radius, and for its queries their number, radius, greatest length and least
bound. Two summaries bound every score between a group of queries and a group of rows, so
the pairs of groups that can matter are known before any row moves. Groups of queries are
packed into blocks, neighbours together; a row is copied only to blocks with a group that
needs its group, and a query only to groups that its own bound reaches. Groups of rows are
packed, or cut, into slices of bounded size, slices are solved locally and their best k
merged. No row that could be in the result is left out, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltarule.llm.common import table

#: Most pivots, otherwise as many as the root of the number of rows; rows of the sample that one
#: is chosen from, taken by the hash of their id; rows in one slice and queries in one block.
PIVOTS, SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 1024, 4, 8192, 4096
_PLACED = "vec_id long, v array<long>, cell int, far double, length double, floor double"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, short lists filled with zeros, which leaves products as they are."""
    out = np.zeros((len(column), width))
    counts = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(column)), counts)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows; doubles are exact below 2**53, else Python's integers decide."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        return (a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T).astype(np.int64)
    return np.rint(a @ b.T).astype(np.int64)


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; unusable rows are left out.

    A null vector, an empty one, or one with a null or non-finite component takes no part,
    nor does a null id."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Places of n points (all, if fewer), each the farthest from those before it, so that every cluster gets one."""
    chosen, apart = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)):
        apart[chosen[-1]] = -1.0
        chosen.append(int(np.argmax(apart)))
        apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


@dataclass(frozen=True)
class Routes:
    """needs: whether a group of queries (row) can need a group of rows (column); first, parts: of a
    group's queries the first block and over how many they are dealt; blocks: those that need a group."""

    needs: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    blocks: list[list[int]]

    @property
    def share(self) -> float:
        """Of the pairs of groups that hold queries and rows, those that are compared."""
        held = self.parts > 0
        return float(self.needs[held].mean()) if held.any() and self.needs.shape[1] else 0.0


def _kth(least: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """For each line of least scores of groups: what k rows other than the query reach at least."""
    order = np.argsort(-least, axis=1, kind="stable")
    enough = np.cumsum(rows[order], axis=1) > k
    found = np.take_along_axis(least, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)[:, 0]
    return np.where(enough.any(axis=1), found, -np.inf)


def pack(centre: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals groups to numbered bins of about ``limit`` members, neighbours together: the first bin of
    each group, and over how many it is dealt (none for an empty group)."""
    held = np.flatnonzero(counts)
    first, parts = np.zeros(len(centre), np.int64), np.zeros(len(centre), np.int64)
    left, at, now, room = np.ones(len(held), bool), 0, -1, 0
    while left.any():  # a chain from neighbour to neighbour
        group, left[at] = held[at], False
        at = int(np.argmin(np.where(left, ((centre[held] - centre[group]) ** 2).sum(1), np.inf)))
        if counts[group] > room:
            now, room = now + 1, limit
        first[group], parts[group] = now, math.ceil(counts[group] / limit)
        now, room = now + parts[group] - 1, room - counts[group] if parts[group] == 1 else 0
    return first, parts


def routes(centre: np.ndarray, rows: np.ndarray, radius: np.ndarray, queries: np.ndarray, reach: np.ndarray, longest: np.ndarray, floor: np.ndarray, k: int, block: int) -> Routes:
    """Of groups by pivot: rows and their radius, queries, their radius, greatest length and least bound.

    For q within a of pivot p and x within b of pivot s, q.x = q.s + q.(x - s) is at most
    p.s + a |s| + |q| b, and at least p.s - a |s| - |q| b.
    """
    size = np.sqrt((centre**2).sum(1))
    spread = reach[:, None] * size + longest[:, None] * radius
    most, least = centre @ centre.T + spread, centre @ centre.T - spread
    most, least = most + 1e-6 * (1 + np.abs(most)), least - 1e-6 * (1 + np.abs(least))
    floor = np.maximum(floor, _kth(least, rows, k))
    needs = (most >= floor[:, None]) & (queries > 0)[:, None] & (rows > 0)
    first, parts = pack(centre, queries, block)
    blocks = [sorted({int(first[q] + j) for q in np.flatnonzero(needs[:, c]) for j in range(parts[q])}) for c in range(len(centre))]
    return Routes(needs, first, parts, blocks)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest inner products of each query.

    vectors: rows (vec_id, v) as from ``quantised``. Queries are the rows whose id ``every``
    divides; candidates are all rows of another id. Ties go to the smaller vec_id; rows
    that share an id are candidates each. With fewer candidates than k, all are returned;
    an empty table, or one without queries, gives an empty result. Pivots are a bounded
    sample; everything else covers all rows.
    """
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most_pivots = max(1, min(pivots, math.isqrt(n)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * most_pivots).collect()
    points = np.zeros((max(1, len(sample)), width or 1))
    for i, r in enumerate(sample):
        points[i, : len(r["v"])] = r["v"]
    chosen = far_apart(points, most_pivots)
    centre, width = points[chosen], width or 1
    owner = np.array([r["vec_id"] for r in sample] or [-1])[chosen]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centre**2).sum(1)
        for rows in batches:
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), width)
            products = x @ centre.T
            cell = np.argmin(square - 2 * products, axis=1)
            far = np.sqrt(((x - centre[cell]) ** 2).sum(1))
            floor = np.full(len(x), np.nan)
            asks = np.flatnonzero(ids % every == 0)
            if len(asks):
                known = _exact(x[asks], centre).astype(float)
                known[owner[None] == ids[asks][:, None]] = -np.inf
                floor[asks] = np.sort(known, axis=1)[:, -k] if known.shape[1] >= k else -np.inf
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x**2).sum(1))), pa.array(floor)], ["vec_id", "v", "cell", "far", "length", "floor"])

    placed = vectors.select("vec_id", "v").mapInArrow(place, _PLACED)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    asks = lambda c: F.when(is_query, F.col(c))
    # A summary row for each of a bounded number of groups.
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius"), F.count_if(is_query).alias("queries"), F.max(asks("far")).alias("reach"), F.max(asks("length")).alias("longest"), F.min(asks("floor")).alias("floor")).collect()
    of = {c: np.zeros(len(centre)) for c in ("rows", "radius", "queries", "reach", "longest", "floor")}
    for r in summary:
        for c, x in of.items():
            x[r["cell"]] = r[c] or 0
    of["rows"], of["queries"] = of["rows"].astype(np.int64), of["queries"].astype(np.int64)
    ways = routes(centre, **of, k=k, block=BLOCK_QUERIES)
    slice_, slices = pack(centre, of["rows"], BLOCK_ROWS)
    radius = of["radius"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            q, own, part, floor = _matrix(rows.column("v"), width), *(rows.column(c).to_numpy() for c in ("cell", "part", "floor"))
            spread = np.sqrt((q**2).sum(1))[:, None] * radius
            most, least = q @ centre.T + spread, q @ centre.T - spread
            most, least = most + 1e-6 * (1 + np.abs(most)), least - 1e-6 * (1 + np.abs(least))
            floor = np.maximum(floor, _kth(least, of["rows"], k))
            at, cell = np.nonzero((most >= floor[:, None]) & ways.needs[own])
            copies = slices[cell]
            at, cell = np.repeat(at, copies), np.repeat(cell, copies)
            block = slice_[cell] + np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            once = np.unique(np.stack([at, block]), axis=1)
            at, block = once[0], once[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int32)), pa.array((ways.first[own] + part)[at].astype(np.int32)), pa.array(np.ones(len(at), bool)), rows.column("vec_id").take(pa.array(at)), rows.column("v").take(pa.array(at))],
                ["block", "part", "is_query", "vec_id", "v"],
            )

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            cell, block = (rows.column(c).to_numpy() for c in ("cell", "block"))
            at = np.repeat(np.arange(len(cell)), [len(ways.blocks[c]) for c in cell])
            part = np.array([b for c in cell for b in ways.blocks[c]], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array((slice_[cell] + block)[at].astype(np.int32)), pa.array(part), pa.array(np.zeros(len(at), bool)), rows.column("vec_id").take(pa.array(at)), rows.column("v").take(pa.array(at))],
                ["block", "part", "is_query", "vec_id", "v"],
            )

    def dealt(counts: np.ndarray, *keys: str) -> Column:
        """A number below the count of the row's group, by hash."""
        held = F.array(*(F.lit(int(max(1, x))) for x in counts))
        return F.pmod(F.xxhash64(*keys, F.lit(1)), F.element_at(held, F.col("cell") + 1).cast("long")).cast("int")

    routed = "block int, part int, is_query boolean, vec_id long, v array<long>"
    asked = placed.filter(is_query).select("cell", "floor", "vec_id", "v", dealt(ways.parts, "vec_id").alias("part")).mapInArrow(route, routed)
    offered = placed.select("cell", "vec_id", "v", dealt(slices, "vec_id", "v").alias("block")).mapInArrow(offer, routed)

    def solve(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        flags = np.asarray(group.column("is_query"))
        ids, v = group.column("vec_id").to_numpy(), _matrix(group.column("v").combine_chunks() if isinstance(group.column("v"), pa.ChunkedArray) else group.column("v"), width)
        order = np.argsort(ids[~flags], kind="stable")
        rows, x = ids[~flags][order], v[~flags][order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.array_split(np.flatnonzero(flags), max(1, flags.sum() // 256)):
            scores = _exact(v[part], x) if len(rows) else np.zeros((len(part), 0), np.int64)
            for i, s in zip(part.tolist(), scores, strict=True):
                other = np.flatnonzero(rows != ids[i])
                s = s[other]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    kept = np.flatnonzero(s >= least)
                    kept = kept[np.argsort(-s[kept], kind="stable")][:k]
                else:
                    kept = np.arange(len(s))
                found.append((np.full(len(kept), ids[i]), rows[other[kept]], s[kept]))
        return pa.table({n: np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j, n in enumerate(("query_id", "vec_id", "score"))})

    local = asked.unionByName(offered).groupBy("block", "part").applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over all vectors; unusable ones are left out as ``quantised`` says."""
    return top_k(quantised(table(spark, sf_dir, "embeddings")))


SQL = """
WITH e AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
