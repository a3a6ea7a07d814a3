"""Reading and writing relations as delimited text.

Parquet, ORC, JSON, JDBC and tables need nothing of their own: a relation's input is any
DataFrame and so is its result.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltarule.types import parse_type

log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_delimited(spark: SparkSession, path: str, types: list[str], sep: str = ",", header: bool = False, quoted: bool = False, trim: bool = False, missing_ok: bool = True) -> DataFrame:
    """Rows of a text file, one column for each type; values that do not parse fail the job.

    sep: one character. quoted: RFC 4180 quoting, else quotes are text. trim: drops space at
    the right of each field. Blank lines are skipped. A missing file is an empty relation
    with a warning, unless missing_ok is false.
    """
    columns = [parse_type(t).spark for t in types]
    text = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns))])
    if missing_ok and not exists(spark, path):
        log.warning("%s is missing and read as empty", path)
        rows = spark.createDataFrame([], text)
    else:
        options = {"sep": sep, "header": header, "mode": "FAILFAST", "quote": '"' if quoted else "", "escape": '"' if quoted else "", "emptyValue": "", "nullValue": "\u0000", "ignoreTrailingWhiteSpace": trim}
        rows = spark.read.schema(text).options(**options).csv(path)
    return rows.select(*(F.col(f"_{i}").cast(c).alias(f"_{i}") for i, c in enumerate(columns)))


def rendered(column: Column, kind: T.DataType) -> Column:
    """A value as text: tuples as (a, b), a tuple of one as (a,), booleans as True and False."""
    if isinstance(kind, T.StructType):
        parts = F.concat_ws(", ", *(rendered(column.getField(f.name), f.dataType) for f in kind.fields))
        return F.concat(F.lit("("), parts, F.lit(",)" if len(kind.fields) == 1 else ")"))
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").otherwise("False")
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: rendered(x, kind.elementType)), ", "), F.lit("]"))
    return column.cast("string")


def write_text(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """One line for each row, its values joined; a relation without columns writes True."""
    line = F.concat_ws(sep, *(rendered(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields))
    rows.select(line.alias("line")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited values with CSV quoting and no header; tuples and arrays as text."""
    flat = rows.select(*(rendered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if isinstance(f.dataType, T.StructType | T.ArrayType) else F.col(f"`{f.name}`") for f in rows.schema.fields))
    flat.write.mode("overwrite").option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def sizes(relations: dict[str, DataFrame]) -> list[str]:
    """name, a tab and the number of rows, for each relation, in lower case."""
    return [f"{name.lower()}\t{rows.count()}" for name, rows in relations.items()]
