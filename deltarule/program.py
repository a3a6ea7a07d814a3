"""Programs that run: rule text or builder calls in, DataFrames out."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltarule import ast
from deltarule.errors import RuleError
from deltarule.functions.registry import Functions
from deltarule.operators.expansion import Expansion, expand, expansion_of
from deltarule.operators.fixpoint import Fixpoint
from deltarule.operators.store import Store
from deltarule.parser import atom, bodies
from deltarule.pipeline import Pipeline, default_pipeline
from deltarule.plans.expressions import Expressions
from deltarule.plans.rules import UNIT, RuleCompiler, columns_of
from deltarule.resolve import Region, Resolved
from deltarule.types import parse_type

Input = DataFrame | Iterable[tuple]
MOST_ROUNDS = 65_535


class Results(dict[str, DataFrame]):
    """Relations by name; metrics has a row for each round and region; clear() deletes intermediate files."""

    def __init__(self, relations: dict[str, DataFrame], metrics: list[dict], store: Store):
        super().__init__(relations)
        self.metrics, self._store = metrics, store

    def clear(self) -> None:
        self._store.clear()


class Program:
    """A checked program. Build one with parse(), or with relation() and rule() on Program()."""

    def __init__(self, tree: ast.Program | None = None, functions: Functions | None = None, pipeline: Pipeline | None = None):
        self.tree = tree or ast.Program()
        self.functions = functions or Functions()
        self.pipeline = pipeline or default_pipeline()

    @classmethod
    def parse(cls, text: str, types: dict[str, str] | None = None, functions: Functions | None = None, pipeline: Pipeline | None = None) -> Program:
        pipeline = pipeline or default_pipeline()
        program = cls(pipeline.stage("read")(text, types or {}), functions, pipeline)
        program.resolve()
        return program

    def relation(self, name: str, *columns: str) -> Program:
        self.tree.relations.append(ast.Relation(name, tuple(parse_type(c, self.tree.types) for c in columns)))
        return self

    def fact(self, name: str, *values: object) -> Program:
        """Values are Python literals."""
        write = lambda v: "None" if v is None else json.dumps(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
        self.tree.rules.append(ast.Rule((ast.Atom(name, tuple(map(write, values))),), ()))
        return self

    def rule(self, heads: str | list[str], *body: str, order: list[int] | None = None) -> Program:
        """heads and body items as rule text; order: another order of evaluation of the body."""
        made = tuple(atom(h) for h in ([heads] if isinstance(heads, str) else heads))
        for items in bodies(", ".join(body)) if body else [()]:
            self.tree.rules.append(ast.Rule(made, items, tuple(order) if order is not None else None))
        return self

    def output(self, *names: str) -> Program:
        if self.tree.outputs is not None:
            raise RuleError("more than one output attribute")
        self.tree.outputs = names
        return self

    def resolve(self) -> Resolved:
        return self.pipeline.stage("plan")(self.pipeline.stage("lower")(self.tree), self.pipeline)

    def explain(self) -> str:
        """Inputs, outputs and regions in the order in which they run."""
        found = self.resolve()
        lines = [f"inputs: {', '.join(found.inputs)}", f"outputs: {', '.join(found.outputs)}"]
        for k, region in enumerate(found.regions):
            lines.append(f"region {k} {'recursive' if region.recursive else 'plain'}: {', '.join(region.heads())}")
            lines += [f"  {', '.join(h.relation for h in r.heads)} from {', '.join(type(i).__name__.lower() + ' ' + (i.source.relation if isinstance(i, ast.Aggregate) else i.relation if isinstance(i, ast.Atom) else i.expression) for i in r.ordered())}" for r in region.rules]
        return "\n".join(lines)

    def run(self, spark: SparkSession, inputs: dict[str, Input] | None = None, outputs: list[str] | None = None, most_rounds: int = MOST_ROUNDS, partitions: int | None = None) -> Results:
        """Evaluates what the outputs need. Relations without recursion stay lazy.

        inputs: DataFrames, whose columns count by position, or rows; a missing one is empty.
        partitions: shuffle partitions of the session, if given (at least one).
        """
        if partitions is not None:
            if partitions < 1:
                raise RuleError("the number of partitions must be positive")
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        return self.pipeline.stage("render")(self, spark, dict(inputs or {}), outputs, most_rounds)


def render(program: Program, spark: SparkSession, inputs: dict[str, Input], outputs: list[str] | None, most_rounds: int) -> Results:
    return _Run(program, spark, inputs, most_rounds).results(outputs)


class _Run:
    def __init__(self, program: Program, spark: SparkSession, inputs: dict[str, Input], most_rounds: int):
        self.program, self.spark, self.resolved = program, spark, program.resolve()
        self.relations = self.resolved.relations
        if unknown := set(inputs) - set(self.relations):
            raise RuleError(f"input for the undeclared relation {sorted(unknown)[0]}")
        program.functions.register(spark)
        self.expressions = Expressions(program.tree)
        self.compiler = RuleCompiler(self.relations, self.expressions)
        self.store, self.metrics = Store(spark), []
        self.fixpoint = Fixpoint(self.compiler, self.store, most_rounds, lambda **row: self.metrics.append(row))
        self.parts: dict[str, list[DataFrame]] = {n: [] for n in self.relations}
        self.sets: dict[str, bool] = dict.fromkeys(self.relations, True)
        self.waiting: dict[str, dict[tuple[str, str], list[DataFrame]]] = {n: {} for n in self.relations}
        self.done: dict[str, DataFrame] = {}
        for name in self.resolved.inputs:
            if name in inputs:
                self._add(name, self._input(name, inputs[name]), False)
        for name in self.relations:
            if rows := self._facts(name):
                self._add(name, rows, False)

    def schema(self, name: str) -> T.StructType:
        columns = self.relations[name].columns
        return T.StructType([T.StructField(f"c{i}", c.spark) for i, c in enumerate(columns)] or [T.StructField(UNIT, T.BooleanType())])

    def _input(self, name: str, given: Input) -> DataFrame:
        schema = self.schema(name)
        if not isinstance(given, DataFrame):
            given = self.spark.createDataFrame([tuple(r) if len(r) else (True,) for r in given], schema)
        if not self.relations[name].columns:
            return given.select(F.lit(True).alias(UNIT)).limit(1)
        if len(given.columns) != len(schema):
            raise RuleError(f"the input for {name} has {len(given.columns)} columns, not {len(schema)}")
        return given.toDF(*(f"c{i}" for i in range(len(schema)))).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))

    def _facts(self, name: str) -> DataFrame | None:
        columns = self.relations[name].columns
        rows = [h.arguments for r in self.resolved.facts for h in r.heads if h.relation == name]
        if not rows:
            return None
        if not columns:
            return self.spark.range(1).select(F.lit(True).alias(UNIT))
        one = lambda args: F.struct(*(self.expressions.column(a).cast(c.spark).alias(f"c{i}") for i, (a, c) in enumerate(zip(args, columns, strict=True))))
        return self.spark.range(1).select(F.inline(F.array(*map(one, rows))))

    def _add(self, name: str, rows: DataFrame, is_set: bool) -> None:
        self.parts[name].append(rows)
        self.sets[name] = is_set and len(self.parts[name]) == 1
        self.done.pop(name, None)

    def get(self, name: str) -> DataFrame:
        """The relation as it is known so far, without duplicates."""
        if name not in self.done:
            parts, is_set = list(self.parts[name]), self.sets[name]
            for (operator, last), rows in self.waiting[name].items():
                parts.append(self.compiler.reduce(reduce(DataFrame.unionByName, rows), operator, last, self.relations[name]))
                is_set = len(parts) == 1
            if not parts:
                self.done[name] = self.spark.createDataFrame([], self.schema(name))
            else:
                rows = reduce(DataFrame.unionByName, parts)
                self.done[name] = rows if is_set else rows.distinct()
        return self.done[name]

    def scan(self, name: str) -> DataFrame:
        """The relation for a rule that only scans it: an input keeps the duplicates that it came
        with, as what the rule makes of them is made distinct once, on fewer columns."""
        plain = name in self.resolved.inputs and len(self.parts[name]) == 1 and not self.waiting[name]
        return self.parts[name][0] if plain else self.get(name)

    def results(self, outputs: list[str] | None) -> Results:
        names = self.resolved.outputs if outputs is None else outputs
        if unknown := set(names) - set(self.relations):
            raise RuleError(f"output names the undeclared relation {sorted(unknown)[0]}")
        regions = self.resolved.needed(list(names))
        expansions = {e.relation: e for r in regions if r.recursive and (e := expansion_of(self.resolved, r))}
        later = [r for e in expansions.values() for r in e.first]
        for region in regions:
            began = time.perf_counter()
            if region.recursive:
                self._recursive(region, expansions.get(region.heads()[0]))
            else:
                self._plain([r for r in region.rules if r not in later])
            self.metrics.append({"region": ", ".join(region.heads()), "recursive": region.recursive, "seconds": time.perf_counter() - began})
        return Results({n: self._named(n) for n in names}, self.metrics, self.store)

    def _recursive(self, region: Region, expansion: Expansion | None) -> None:
        if expansion:
            rows = expand(expansion, self.fixpoint, self.scan)
            if rows is not None:
                return self._add(expansion.relation, rows, True)
            self._plain(expansion.first)
        for name, rows in self.fixpoint.run(region, self.get, self.scan).items():
            self.parts[name], self.waiting[name] = [], {}
            self._add(name, rows, True)

    def _plain(self, rules: Iterable[ast.Rule]) -> None:
        made: list[Callable[[], None]] = []
        for rule in rules:
            if item := rule.direct_aggregate():
                rows, operator, last = self.compiler.candidates(rule, self.get(item.source.relation))
                name = rule.heads[0].relation
                made.append(lambda n=name, k=(operator, last), r=rows: (self.waiting[n].setdefault(k, []).append(r), self.done.pop(n, None)))
                continue
            items = rule.ordered()
            read = lambda k, name, items=items: self.get(name) if isinstance(items[k], ast.Aggregate) else self.scan(name)
            for head in rule.heads:
                rows = self.compiler.rows(rule, head, read)
                is_set = self.compiler.distinct_by_shape(rule, head) and self.scan(items[0].relation) is self.get(items[0].relation)
                made.append(lambda n=head.relation, r=rows, s=is_set: self._add(n, r, s))
        for add in made:  # rules of one region never read each other's heads
            add()

    def _named(self, name: str) -> DataFrame:
        rows = self.get(name)
        return rows.toDF(*(f"_{i}" for i in range(len(rows.columns)))) if self.relations[name].columns else rows


__all__ = ["Program", "Results", "columns_of", "render"]
