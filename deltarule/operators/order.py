"""Order of results: sorted, cut to the first rows, or by first appearance in an input.

Relations are sets; an order is put on a result when it leaves the program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places that are numbered together; a block is the largest group that one task sorts.
BLOCK = 1 << 18


def ordered(rows: DataFrame, *keys: str | Column, limit: int | None = None) -> DataFrame:
    """Rows by keys ("name" or "name desc"), compared from left to right, rows with equal keys by
    their other columns; with a limit only the first ones (each task keeps that many, not more)."""
    named = [k for k in keys if isinstance(k, str)]
    columns = [k if isinstance(k, Column) else F.desc(k.split()[0]) if k.lower().endswith(" desc") else F.asc(k.split()[0]) for k in keys]
    used = {k.split()[0] for k in named}
    columns += [F.asc(f"`{f.name}`") for f in rows.schema.fields if f.name not in used]
    sorted_ = rows.orderBy(*columns)
    return sorted_ if limit is None else sorted_.limit(limit)


def with_place(rows: DataFrame, name: str = "place") -> DataFrame:
    """Numbers the rows of an input in the order in which its files are read; gaps between files."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def first_seen(rows: DataFrame, value: str, place: str, name: str = "ord") -> DataFrame:
    """Distinct values with their ordinals, from 0, in the order of their first places.

    place: an integer column. Ordinals count inside blocks of places and add the sizes of the
    blocks before, so that no task sorts all values; values that share a place go by value.
    """
    first = rows.groupBy(value).agg(F.min(place).alias("_place")).withColumn("_block", F.floor(F.col("_place") / BLOCK))
    blocks = first.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy("_place", value))
    return first.withColumn("_within", within).join(blocks, "_block").select(value, (F.col("_before") + F.col("_within") - 1).cast("long").alias(name))


def by_first_appearance(result: DataFrame, seen: DataFrame, value: str, ordinal: str = "ord") -> DataFrame:
    """A result in the order in which ``seen`` (of first_seen) has its values; unknown ones last."""
    return result.join(seen.withColumnRenamed(ordinal, "_ord"), value, "left").orderBy(F.asc_nulls_last("_ord")).drop("_ord")
