"""Column types of rule programs as Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from deltarule.errors import RuleError
from deltarule.text import split_top

#: Names of the rule language; unsigned integers take the next wider signed type.
SCALARS = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "isize": T.LongType(), "usize": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "String": T.StringType(), "char": T.StringType(), "str": T.StringType(), "IStr": T.StringType(),
}
#: Wrappers that do not change a value.
TRANSPARENT = ("Box", "Arc", "Rc", "OrderedFloat")


@dataclass(frozen=True)
class ColumnType:
    spark: T.DataType
    nullable: bool = False

    @property
    def name(self) -> str:
        return self.spark.simpleString()


def enum_type(variants: dict[str, list[str]], known: dict[str, ColumnType]) -> ColumnType:
    """A sum type: its tag, and one nullable struct of payloads for each variant that has any."""
    fields = [T.StructField("tag", T.StringType())]
    fields += [T.StructField(v, parse_type(f"({','.join(parts)},)", known).spark) for v, parts in variants.items() if parts]
    return ColumnType(T.StructType(fields), True)


def parse_type(text: str, known: dict[str, ColumnType] | None = None) -> ColumnType:
    """Reads i32, (A, B), Option<T>, Vec<T>, a known name, or any Spark DDL type."""
    text = text.strip()
    known = known or {}
    if text in known:
        return known[text]
    if text in SCALARS:
        return ColumnType(SCALARS[text])
    if text.startswith("&"):
        return parse_type(text[1:].removeprefix("'static "), known)
    if text.startswith("(") and text.endswith(")"):
        parts = [parse_type(x, known) for x in split_top(text[1:-1], ",", angles=True) if x.strip()]
        return ColumnType(T.StructType([T.StructField(f"_{i}", p.spark) for i, p in enumerate(parts)]), any(p.nullable for p in parts))
    head, _, inner = text.partition("<")
    if inner.endswith(">"):
        inner = inner[:-1]
        if head == "Option":
            return ColumnType(parse_type(inner, known).spark, True)
        if head == "Vec":
            return ColumnType(T.ArrayType(parse_type(inner, known).spark), parse_type(inner, known).nullable)
        if head in TRANSPARENT:
            return parse_type(inner, known)
    try:
        return ColumnType(T.DataType.fromDDL(text), True)
    except Exception as error:
        raise RuleError(f"unknown type {text}") from error
