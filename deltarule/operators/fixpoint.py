"""Recursive regions: semi-naive evaluation, for sets and for least or greatest values.

A round joins only what the last round found (delta) with everything known. Known rows
are files in the store; a round writes its new rows and their count in one job. Tables
that do not change in the recursion are written once before it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltarule.ast import WILDCARD, Aggregate, Atom, Relation, Rule
from deltarule.errors import RuleError
from deltarule.operators.store import Store
from deltarule.plans.rules import RuleCompiler, all_of, columns_of
from deltarule.resolve import Region, lattice_of


#: Rounds whose tables are joined into one.
MERGED = 8


@dataclass
class Known:
    """A growing relation: its files, those of the last round, and the operator of its values."""

    relation: Relation
    schema: T.StructType
    operator: str | None = None
    paths: list[str] = field(default_factory=list)
    latest: list[str] = field(default_factory=list)
    level: dict[str, int] = field(default_factory=dict)

    @property
    def earlier(self) -> list[str]:
        return [p for p in self.paths if p not in self.latest]


class Fixpoint:
    def __init__(self, compiler: RuleCompiler, store: Store, most_rounds: int, note: Callable[..., None]):
        self.compiler, self.store, self.most_rounds, self.note = compiler, store, most_rounds, note

    def run(self, region: Region, get: Callable[[str], DataFrame], scan: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
        """The finished relations of the region; get gives what is known of a relation before it,
        scan the same, perhaps with duplicates."""
        fixed: dict[str, DataFrame] = {}
        for name in sorted({n for r in region.rules for n in r.reads()} - set(region.heads())):
            fixed[name] = self._fixed(region, name, scan(name))
        return {n: self._whole(k) for n, k in self.rounds(region, get, fixed).items()}

    def rounds(self, region: Region, get: Callable[[str], DataFrame], fixed: dict[str, DataFrame]) -> dict[str, Known]:
        """The same with the tables that do not change in the recursion already written."""
        known = {n: Known(self.compiler.relations[n], get(n).schema, self._operator(region, n)) for n in region.heads()}
        if any(k.operator for k in known.values()) and not all(k.operator for k in known.values()):
            raise RuleError(f"least or greatest values and plain rows recur together in {', '.join(known)}")
        for name, k in known.items():
            rows = get(name)
            path, count = self.store.write(self._reduced(rows, k) if k.operator else rows)
            k.paths = k.latest = [path] if count else []
        for round_ in range(1, self.most_rounds + 1):
            found: dict[str, list[str]] = {}
            for name, k in known.items():
                began = time.perf_counter()
                rows = self._round(region, name, known, fixed)
                if rows is None:
                    continue
                path, count = self.store.write(rows)
                self.note(region=", ".join(known), round=round_, relation=name, rows=count, seconds=time.perf_counter() - began)
                if count:
                    found[name] = [path]
            if not found:
                return known
            for name, k in known.items():
                self._merge(k)
                k.latest = found.get(name, [])
                k.paths = k.paths + k.latest
        raise RuleError(f"no fixed point of {', '.join(known)} after {self.most_rounds} rounds")

    def _fixed(self, region: Region, name: str, rows: DataFrame) -> DataFrame:
        """A table that does not change in the recursion, written once: the columns that a rule names, without duplicates; the others are null."""
        atoms = [x if isinstance(x, Atom) else x.source for r in region.rules for x in r.body if isinstance(x, Atom | Aggregate)]
        named = {i for a in atoms if a.relation == name for i, x in enumerate(a.arguments) if x != WILDCARD}
        kept = [c for i, c in enumerate(rows.columns) if i in named] or rows.columns[:1]
        part = rows.select(*kept).distinct()
        read = self.store.read([self.store.write(part)[0]], part.schema)
        return read.select(*(F.col(f.name) if f.name in kept else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))

    def _merge(self, k: Known) -> None:
        """Joins the tables of MERGED rounds into one, and these again: few tables to list and open
        after many rounds, while a row is written again only once a level."""
        while len(k.paths) >= MERGED and len({k.level.get(p, 0) for p in k.paths[-MERGED:]}) == 1:
            last = k.paths[-MERGED:]
            path, _ = self.store.write(self._read(k, last).coalesce(self._files(last)))
            k.level[path] = k.level.get(last[0], 0) + 1
            k.paths = [*k.paths[:-MERGED], path]

    def _files(self, paths: list[str]) -> int:
        """Enough files for about 128 MB each."""
        return max(1, -(-sum(map(self.store.size, paths)) // (128 << 20)))

    def _operator(self, region: Region, name: str) -> str | None:
        rules = [r for r in region.rules if any(h.relation == name for h in r.heads)]
        heads = set(region.heads())
        found = set()
        for rule in rules:
            inside = [i for i in rule.body if isinstance(i, Aggregate)]
            item = lattice_of(rule)
            if inside and (item is None or item.source.relation in heads):
                raise RuleError(f"only min or max of a relation outside the recursion can be taken in the recursive relation {name}")
            found.add(item.operator if item else None)
        if len(found) > 1:
            raise RuleError(f"the recursive rules of {name} do not agree on one of min and max")
        return found.pop()

    def _round(self, region: Region, name: str, known: dict[str, Known], fixed: dict[str, DataFrame]) -> DataFrame | None:
        parts = []
        for rule in region.rules:
            items = rule.ordered()
            places = [i for i, x in enumerate(items) if isinstance(x, Atom) and x.relation in known]
            for head in rule.heads:
                if head.relation != name:
                    continue
                for at in places:
                    if known[items[at].relation].latest and all(known[items[j].relation].earlier for j in places if j > at):
                        parts.append(self._variant(rule, head, at, places, known, fixed))
        if not parts:
            return None
        k = known[name]
        rows = reduce(DataFrame.unionByName, parts)
        return self._improved(rows, k) if k.operator else self._new(rows, k)

    def _variant(self, rule: Rule, head: Atom, at: int, places: list[int], known: dict[str, Known], fixed: dict[str, DataFrame]) -> DataFrame:
        """The rule with the latest rows at one place, all rows before it and earlier ones after it."""

        def read(i: int, name: str) -> DataFrame:
            if i not in places:
                return fixed[name] if name in fixed else self._read(known[name], known[name].paths)
            k = known[name]
            return self._read(k, k.latest if i == at else k.paths if i < at else k.earlier)

        env = self.compiler.body(rule, [head], read, lattice=lattice_of(rule) is not None)
        return self.compiler.project(env, head)

    def _read(self, k: Known, paths: list[str]) -> DataFrame:
        rows = self.store.read(paths, k.schema)
        # values that have been improved since would only lead to worse ones
        return self._reduced(rows, k) if k.operator and len(paths) > 1 else rows

    def _whole(self, k: Known) -> DataFrame:
        return self._read(k, k.paths)

    def _new(self, rows: DataFrame, k: Known) -> DataFrame:
        names = columns_of(k.relation)
        rows = rows.distinct()
        if not k.paths:
            return rows
        have = self.store.read(k.paths, k.schema).withColumnsRenamed({n: f"have_{n}" for n in names})
        return rows.join(have, all_of([F.col(n).eqNullSafe(F.col(f"have_{n}")) for n in names]), "left_anti")

    def _reduced(self, rows: DataFrame, k: Known) -> DataFrame:
        *keys, value = columns_of(k.relation)
        best = F.min(value) if k.operator == "min" else F.max(value)
        return rows.groupBy(*keys).agg(best.alias(value)) if keys else rows.agg(best.alias(value)).filter(F.col(value).isNotNull())

    def _improved(self, rows: DataFrame, k: Known) -> DataFrame:
        *keys, value = columns_of(k.relation)
        rows = self._reduced(rows, k)
        if not k.paths:
            return rows
        best = self._reduced(self.store.read(k.paths, k.schema), k).withColumnsRenamed({n: f"have_{n}" for n in (*keys, value)})
        agree = all_of([F.col(n).eqNullSafe(F.col(f"have_{n}")) for n in keys]) if keys else F.lit(True)
        have, new = F.col(f"have_{value}"), F.col(value)
        better = have.isNull() | (new < have if k.operator == "min" else new > have)
        return rows.join(best, agree, "left").filter(better).select(*keys, value)
