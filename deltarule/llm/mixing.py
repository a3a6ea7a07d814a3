"""Operator 8, mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source, documents stand in key order;
the leading digits of the key range-split a source into slices, whose totals make
prefix sums between slices, and a window inside each slice makes the rest. So a source
that holds most rows is spread over thousands of slices and never lies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltarule.llm.common import WORD, n_words, table, with_checkpoints

#: Hexadecimal digits of the key that name a slice: 4096 slices for each source.
SLICE_DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """For sources (source, source_size), one row each: adds a number (rank) and the target.

    Weights repeat over the sources in code point order, null last. A target stops at
    ``most`` times its source's size and the excess is reshared by weight, until none is
    above. In order of limit over weight the limited sources come first, so one pass of
    running sums finds them. Sources are a dimension, one row each: this small table, and
    nothing that grows with the documents, is put in order in one task.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("rank", F.row_number().over(ordered).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("left", F.col("total") - (F.sum("limit").over(by_limit) - F.col("limit")))
    rows = rows.withColumn("weights", F.sum("weight").over(everything) - (F.sum("weight").over(by_limit) - F.col("weight")))
    rows = rows.withColumn("limited", F.col("limit") * F.col("weights") <= F.col("weight") * F.col("left"))
    taken = F.coalesce(F.sum(F.when(F.col("limited"), F.col("limit"))).over(everything), F.lit(0))
    free = F.sum(F.when(~F.col("limited"), F.col("weight"))).over(everything)
    each = F.col("weight") * ((F.col("total") - taken) / free)
    return rows.select("source", "source_size", "rank", F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(each).alias("target"))


def allocate(docs: DataFrame, seed: str = "mix", **kind) -> DataFrame:
    """docs with size, source_size, target and taken, and key, the place in the source's order.

    docs: any frame with doc_id, text and source; its other columns stay, but these five
    replace columns of their names. size is the number of words (null text: 0); taken is the
    number of words the mix takes of the document, repeats counted: whole epochs of its
    source, and in the last one the documents before the cut, the one at the cut in part, so
    that a source's taken words are its target rounded. Null sources are a source; rows that
    repeat are documents of their own. Ids, sizes and hashes of texts decide the order, so
    reruns agree. An empty table gives an empty result.
    """
    made = ("size", "source_size", "target", "taken", "key")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in made))
    return _placed(_sized(docs, row), seed, kind).select("row.*", *made)


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    """row, id, source, size and a hash of the text; the names of the user's columns stay inside row."""
    return docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))


def _placed(sized: DataFrame, seed: str, kind: dict) -> DataFrame:
    """sized with key, source_size, target and taken; reads it twice."""
    with_checkpoints(sized.sparkSession)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"))
    keyed = sized.withColumn("key", key).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    # a row for each source and slice, from one pass over the documents
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("inside")).checkpoint()
    own = targets(slices.groupBy("source").agg(F.sum("inside").alias("source_size")), **kind).withColumnRenamed("source", "of")
    keyed = keyed.join(own, keyed["source"].eqNullSafe(own["of"])).drop("of")
    slices = slices.join(own.select("of", "rank"), slices["source"].eqNullSafe(own["of"])).select("rank", "slice", "inside")
    before = F.sum("inside").over(Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("inside")
    placed = keyed.join(slices.select("rank", "slice", before.alias("before")), ["rank", "slice"])
    within = Window.partitionBy("rank", "slice").orderBy("key", "id", "size", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(within) - F.col("size")
    epochs, cut = _cut()
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), cut - start))
    return placed.withColumn("taken", F.when(F.col("source_size") > 0, epochs * F.col("size") + part).otherwise(F.lit(0).cast("long")))


def _cut() -> tuple[Column, Column]:
    """Whole epochs of a source, and the words of one more."""
    size = F.when(F.col("source_size") > 0, F.col("source_size"))
    epochs = F.floor(F.col("target") / size)
    return epochs, F.round(F.col("target") - epochs * size).cast("long")


def mix(docs: DataFrame, **kind) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken.

    A document at its source's cut comes with its first words only, joined by a space.
    Documents without words are in no source's count; they stay once, as they are.
    """
    found = _placed(_sized(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns))), kind.pop("seed", "mix"), kind)
    size, taken = F.col("size"), F.col("taken")
    copies = F.when(size == 0, F.lit(1)).otherwise(F.ceil(taken / F.when(size > 0, size))).cast("int")
    rows = found.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    words = (taken - (F.col("copy") - 1) * size).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(words, F.lit(0))), " ")
    shorter = (size > 0) & (words < size)
    text = F.when(shorter, cut).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(shorter, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over all documents, whose texts are read once: ids, sources and sizes are checkpointed."""
    with_checkpoints(spark)
    docs = table(spark, sf_dir, "documents")
    sized = _sized(docs, F.struct("doc_id")).checkpoint()
    return _placed(sized, "mix", {}).select("row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS top, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
r AS (SELECT *, total - (sum(top) OVER b - top) AS rest, (SELECT sum(weight) FROM w) - (sum(weight) OVER b - weight) AS weights
      FROM w WINDOW b AS (ORDER BY top / weight, rank ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, top * weights <= weight * rest AS limited FROM r),
g AS (SELECT source, source_size, CASE WHEN limited THEN top::DOUBLE ELSE weight * ((total - coalesce((SELECT sum(top) FROM l WHERE limited), 0))
      / (SELECT sum(weight) FROM l WHERE NOT limited)) END::DOUBLE AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target / nullif(g.source_size, 0)) AS epochs,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0
         THEN epochs * size + greatest(0, least(size, round(target - epochs * source_size) - start)) ELSE 0 END::BIGINT AS taken FROM p
"""
