"""Rule bodies as DataFrames.

A relation is a DataFrame with columns c0, c1, ..; an environment is one whose columns
are the variables bound so far. Everything is declarative, so Catalyst prunes columns,
pushes filters and picks the joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltarule.ast import WILDCARD, Aggregate, Atom, Condition, Generator, Item, Let, Relation, Rule, is_variable
from deltarule.patterns import Pattern
from deltarule.plans.expressions import Expressions
from deltarule.text import split_top, variables

#: The hidden column of a relation without columns.
UNIT = "unit"
#: Gives the rows for an atom, by its place in the body and its relation.
Read = Callable[[int, str], DataFrame]
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Env:
    frame: DataFrame | None
    nullable: dict[str, bool]
    guards: tuple[Column, ...] = ()

    def names(self) -> set[str]:
        return set(self.nullable)


def columns_of(relation: Relation) -> list[str]:
    return [f"c{i}" for i in range(len(relation.columns))] or [UNIT]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def same(left: Column, right: Column, nullable: bool) -> Column:
    return left.eqNullSafe(right) if nullable else left == right


class RuleCompiler:
    def __init__(self, relations: dict[str, Relation], expressions: Expressions):
        self.relations, self.expressions = relations, expressions

    def rows(self, rule: Rule, head: Atom, read: Read) -> DataFrame:
        """What the rule adds to the head's relation, duplicates included."""
        env = self.body(rule, [head], read)
        return self.project(env, head)

    def project(self, env: Env, head: Atom) -> DataFrame:
        relation = self.relations[head.relation]
        if not relation.columns:
            return env.frame.select(F.lit(True).alias(UNIT))
        values = [self.expressions.column(x, env.guards).cast(c.spark).alias(f"c{i}") for i, (x, c) in enumerate(zip(head.arguments, relation.columns, strict=True))]
        return env.frame.select(*values)

    def distinct_by_shape(self, rule: Rule, head: Atom) -> bool:
        """Whether rows cannot repeat: one positive atom whose columns are all kept, plus filters."""
        first = rule.ordered()[0]
        if not isinstance(first, Atom) or WILDCARD in first.arguments:
            return False
        others = [i for i in rule.ordered()[1:] if not (isinstance(i, Condition) or isinstance(i, Atom) and i.negated)]
        return not others and set(first.names()) <= set(head.arguments)

    def body(self, rule: Rule, heads: list[Atom], read: Read, lattice: bool = False) -> Env:
        items = rule.ordered()
        env = Env(None, {})
        for k, item in enumerate(items):
            later = self._used(items[k + 1 :], heads)
            if isinstance(item, Atom) and item.negated:
                env = self._negated(env, item, read(k, item.relation))
            elif isinstance(item, Atom):
                env = self._positive(env, item, read(k, item.relation), later)
            elif isinstance(item, Condition):
                test = self.expressions.column(item.expression, env.guards)
                env = replace(env, frame=env.frame.filter(test), guards=(*env.guards, test))
            elif isinstance(item, Let):
                env = self._let(env, item.pattern, self.expressions.column(item.expression, env.guards), item.refutable)
            elif isinstance(item, Generator):
                env = self._generator(env, item)
            elif lattice:  # one candidate for each row; the fixpoint reduces them
                env = self._positive(env, item.source, read(k, item.source.relation), later | variables(item.arguments[0]))
                env = self._let(env, item.binding, self.expressions.column(item.arguments[0], env.guards), False)
            else:
                env = self._aggregate(env, item, read(k, item.source.relation))
        return env

    @staticmethod
    def _used(items: tuple[Item, ...], heads: list[Atom]) -> set[str]:
        texts = [a for h in heads for a in h.arguments]
        for item in items:
            if isinstance(item, Atom):
                texts += item.arguments
            elif isinstance(item, Aggregate):
                texts += [*item.source.arguments, *item.arguments]
            else:
                texts.append(item.expression)
        return set().union(*map(variables, texts)) if texts else set()

    def scan(self, atom: Atom, rows: DataFrame, bound: set[str]) -> tuple[DataFrame, list[str], dict[str, str]]:
        """Rows by variable, with constants and repeats applied; and the columns that wait for an
        expression over variables bound elsewhere."""
        relation = self.relations[atom.relation]
        kept: dict[str, int] = {}
        tests, waiting = [], {}
        for i, (argument, column) in enumerate(zip(atom.arguments, relation.columns, strict=True)):
            place = F.col(f"c{i}")
            if argument == WILDCARD:
                continue
            if is_variable(argument):
                if argument in kept:
                    tests.append(same(place, F.col(f"c{kept[argument]}"), column.nullable))
                else:
                    kept[argument] = i
            elif not variables(argument):
                tests.append(same(place, self.expressions.column(argument).cast(column.spark), column.nullable or argument == "None"))
            else:
                waiting[f"wait_{i}"] = argument
        rows = rows.filter(all_of(tests)) if tests else rows
        values = [F.col(f"c{i}").alias(v) for v, i in kept.items()] + [F.col(f"c{w[5:]}").alias(w) for w in waiting]
        return rows.select(*values or [F.lit(True).alias(UNIT)]), list(kept), waiting

    def _types(self, atom: Atom) -> dict[str, bool]:
        return {a: c.nullable for a, c in zip(atom.arguments, self.relations[atom.relation].columns, strict=True) if is_variable(a)}

    def _positive(self, env: Env, atom: Atom, rows: DataFrame, later: set[str]) -> Env:
        right, names, waiting = self.scan(atom, rows, env.names())
        nullable = self._types(atom)
        column = {w: self.relations[atom.relation].columns[int(w[5:])] for w in waiting}
        inside = {w: x for w, x in waiting.items() if variables(x) & (set(names) - env.names())}
        if env.frame is None:
            tests = [same(F.col(w), self.expressions.column(x).cast(column[w].spark), column[w].nullable) for w, x in waiting.items()]
            right = right.filter(all_of(tests)) if tests else right
            return Env(right.drop(*waiting), nullable)
        shared = [n for n in names if n in env.nullable]
        fresh = [n for n in names if n not in env.nullable]
        right = right.withColumnsRenamed({n: f"right_{n}" for n in shared})
        conditions = [same(col(n), col(f"right_{n}"), nullable[n] or env.nullable[n]) for n in shared]
        conditions += [same(self.expressions.column(x, env.guards).cast(column[w].spark), F.col(w), True) for w, x in waiting.items() if w not in inside]
        wanted = [n for n in fresh if n in later]
        if not wanted and not inside:
            how = "left_semi"
            frame = env.frame.join(right, all_of(conditions), how) if conditions else env.frame.join(right.limit(1), F.lit(True), how)
            return env if frame is None else replace(env, frame=frame)
        right = right.drop(*(n for n in fresh if n not in wanted and not inside))
        frame = env.frame.join(right, all_of(conditions), "inner") if conditions else env.frame.crossJoin(right)
        if inside:
            frame = frame.filter(all_of([same(self.expressions.column(x, env.guards).cast(column[w].spark), F.col(w), True) for w, x in inside.items()]))
        kept = [*env.nullable, *(n for n in fresh if n in frame.columns)]
        return replace(env, frame=frame.select(*map(col, kept)), nullable=env.nullable | {n: nullable[n] for n in kept if n in fresh})

    def _negated(self, env: Env, atom: Atom, rows: DataFrame) -> Env:
        columns = self.relations[atom.relation].columns
        keys, tests = {}, []
        for i, (argument, column) in enumerate(zip(atom.arguments, columns, strict=True)):
            if argument == WILDCARD:
                continue
            if variables(argument):
                keys[i] = argument
            else:
                tests.append(same(F.col(f"c{i}"), self.expressions.column(argument).cast(column.spark), column.nullable or argument == "None"))
        rows = rows.filter(all_of(tests)) if tests else rows
        if not keys:
            return replace(env, frame=env.frame.join(rows.limit(1).select(F.lit(True).alias(UNIT)), F.lit(True), "left_anti"))
        right = rows.select(*(F.col(f"c{i}").alias(f"not_{i}") for i in keys))
        conditions = [same(self.expressions.column(x, env.guards).cast(columns[i].spark), F.col(f"not_{i}"), columns[i].nullable or env.nullable.get(x, True)) for i, x in keys.items()]
        return replace(env, frame=env.frame.join(right, all_of(conditions), "left_anti"))

    def _let(self, env: Env, pattern: str, value: Column, refutable: bool) -> Env:
        tests, found = Pattern.parse(pattern).bind(value, self.expressions.column)
        frame = env.frame.filter(all_of(tests)) if refutable and tests else env.frame
        guards = (*env.guards, *tests) if refutable else env.guards
        if guards and tests:
            found = {n: F.when(all_of(tests), c) for n, c in found.items()}
        return Env(frame.withColumns(found) if found else frame, env.nullable | dict.fromkeys(found, True), guards)

    def _generator(self, env: Env, item: Generator) -> Env:
        text = item.expression.strip()
        if text.startswith("(") and text.endswith(")") and len(split_top(text, "..", most=1)) == 1:
            text = text[1:-1]  # a range in brackets
        bounds = split_top(text, "..", most=1)
        if len(bounds) == 2:
            low, high = self.expressions.sql(bounds[0]), self.expressions.sql(bounds[1].lstrip("="))
            high = high if bounds[1].startswith("=") else f"({high}) - 1"
            # a sequence whose end lies before its begin would run downwards
            values = F.expr(f"CASE WHEN ({high}) >= ({low}) THEN sequence({low}, {high}) END")
        else:
            values = self.expressions.column(text if text == item.expression.strip() else f"({text})", env.guards)
        frame = env.frame.withColumn("element", F.explode(values))
        env = self._let(replace(env, frame=frame), item.pattern, F.col("element"), True)
        return replace(env, frame=env.frame.drop("element") if "element" not in env.nullable else env.frame)

    def source(self, item: Aggregate, rows: DataFrame, bound: set[str]) -> DataFrame:
        return self.scan(item.source, rows, bound)[0]

    def _aggregate(self, env: Env, item: Aggregate, rows: DataFrame) -> Env:
        """Over the rows of the source that agree with the bound variables; rows without any vanish."""
        source, names, waiting = self.scan(item.source, rows, env.names())
        keys = [n for n in names if n in env.nullable]
        if env.frame is None and waiting:
            keys = []
        value = self.expressions.column(item.arguments[0]) if item.arguments else None
        made = reduction(item.operator, value, self._value_type(source, value)).alias(item.binding)
        group = [*keys, *waiting]
        if not group:
            found = source.agg(made, F.count(F.lit(1)).alias("rows_")).filter("rows_ > 0").select(col(item.binding))
            frame = found if env.frame is None else env.frame.crossJoin(found)
            return replace(env, frame=frame, nullable=env.nullable | {item.binding: True})
        found = source.groupBy(*map(col, group)).agg(made).withColumnsRenamed({k: f"right_{k}" for k in keys})
        nullable = self._types(item.source)
        conditions = [same(col(k), col(f"right_{k}"), nullable[k] or env.nullable[k]) for k in keys]
        conditions += [same(self.expressions.column(x, env.guards).cast(self.relations[item.source.relation].columns[int(w[5:])].spark), F.col(w), True) for w, x in waiting.items()]
        frame = env.frame.join(found, all_of(conditions), "inner").select(*map(col, [*env.nullable, item.binding]))
        return replace(env, frame=frame, nullable=env.nullable | {item.binding: True})

    @staticmethod
    def _value_type(source: DataFrame, value: Column | None) -> T.DataType | None:
        return None if value is None else source.select(value).schema[0].dataType

    def candidates(self, rule: Rule, rows: DataFrame) -> tuple[DataFrame, str, str]:
        """Of an aggregate grouped by its head: the rows (groups, value), the operator, and the
        last head expression with the binding written as `value`."""
        item, head = rule.direct_aggregate(), rule.heads[0]
        source = self.source(item, rows, set())
        relation = self.relations[head.relation]
        groups = [self.expressions.column(x).cast(c.spark).alias(f"c{i}") for i, (x, c) in enumerate(zip(head.arguments[:-1], relation.columns, strict=False))]
        last = self.expressions.sql(head.arguments[-1]).replace(f"`{item.binding}`", "`value`")
        return source.select(*groups, self.expressions.column(item.arguments[0]).alias("value")), item.operator, last

    def reduce(self, rows: DataFrame, operator: str, last: str, relation: Relation) -> DataFrame:
        """Direct aggregates count each distinct (groups, value) once; an integer mean truncates."""
        groups = columns_of(relation)[:-1]
        kind = rows.schema["value"].dataType
        if operator in ("sum", "count", "mean"):
            rows = rows.distinct()
        if operator == "mean" and isinstance(kind, _INTEGERS):
            made = F.expr("sum(value) div count(value)").cast(kind)
        else:
            made = reduction(operator, F.col("value"), kind)
        rows = rows.groupBy(*groups).agg(made.alias("value"), F.count(F.lit(1)).alias("rows_")).filter("rows_ > 0")
        return rows.select(*groups, F.expr(last).cast(relation.columns[-1].spark).alias(f"c{len(groups)}"))


def reduction(operator: str, value: Column | None, kind: T.DataType | None) -> Column:
    if operator == "count":
        return F.count(F.lit(1))
    if operator == "mean":
        return F.avg(value)
    if operator == "sum":
        return F.sum(value).cast(kind)
    return F.min(value) if operator == "min" else F.max(value)
