"""Recursion of which few rows lead to others: it runs over these, and the rules make all rows once after it.

In ``out(x, y) :- up(x, p), out(p, q), up(y, q)`` only rows of two parents lead to others,
while all rows may be far more than fit a disk. So the fixpoint knows only rows whose
values the rule can join, and all rows are a plan without an exchange of them. That needs
no duplicates: a head's values must determine the whole body by keys of the tables
(``up`` has one row for each ``x``), and rows that an earlier rule makes too are told by
conditions on the body. Whether the columns are keys is read from the tables; if
they are not, the fixpoint runs over all rows as for any other program.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from deltarule.ast import WILDCARD, Atom, Condition, Rule, is_variable
from deltarule.operators.fixpoint import Fixpoint
from deltarule.resolve import Region, Resolved

#: Equality of these is the same in joins, groups and conditions.
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType)
_COMPARED = re.compile(r"\s*(\w+)\s*(<>|!=|==|=|<=|>=|<|>)\s*(\w+)\s*")
#: Tables of this many bytes as Parquet are sent to all tasks of the last joins.
SENT_BYTES = 4 << 20
#: Rows of the first table for a task of the last joins, at least.
ROWS_A_TASK = 256

#: Columns of a relation whose values no two rows share.
Key = tuple[str, tuple[int, ...]]


@dataclass(frozen=True)
class Expansion:
    """first: the rules outside the recursion; keys: what the tables must fulfil; needed: the
    rules for rows that the recursion joins, the recursive one last; whole: for all rows, each
    without those of rules before it."""

    relation: str
    first: tuple[Rule, ...]
    keys: frozenset[Key]
    needed: tuple[Rule, ...]
    whole: tuple[Rule, ...]

    def tables(self) -> list[str]:
        return sorted({n for r in self.whole for n in r.reads()} - {self.relation})


def expansion_of(resolved: Resolved, region: Region) -> Expansion | None:
    """For one recursive rule of a relation that no other rule reads, whose head shares no variable with its recursive atom."""
    name, rule = region.heads()[0], region.rules[0]
    rules = [r for r in resolved.program.rules if not r.is_fact]
    first = tuple(r for r in rules if r != rule and any(h.relation == name for h in r.heads))
    if len(region.rules) > 1 or name in resolved.inputs or not first or any(name in r.reads() for r in rules if r != rule):
        return None
    if not all(_plain(resolved, r) for r in (*first, rule)):
        return None
    inner = [x for x in rule.body if isinstance(x, Atom) and x.relation == name]
    if len(inner) != 1 or set(inner[0].arguments) & set(rule.heads[0].arguments):
        return None
    keys: set[Key] = set()
    for r in (*first, rule):
        if not _determines(r, name, keys):
            return None
    whole = []
    for i, r in enumerate((*first, _tables_first(rule, inner[0]))):
        tests = [_outside(r, before, name, keys) for before in first[:i]]
        if None in tests:
            return None
        whole.append(replace(r, body=(*r.ordered(), *map(Condition, tests)), order=None))
    joined = {(k, x.relation, x.arguments.index(v), len(x.arguments)) for k, v in enumerate(inner[0].arguments) for x in rule.body if isinstance(x, Atom) and x.relation != name and v in x.arguments}
    needed = tuple(_joinable(r, sorted(joined)) for r in (*first, rule))
    return Expansion(name, first, frozenset(keys), needed, tuple(whole)) if joined else None


def _plain(resolved: Resolved, rule: Rule) -> bool:
    """Positive atoms of distinct variables and comparisons of two of them; a variable has one plain type."""
    atoms = [x for x in rule.body if isinstance(x, Atom)]
    types: dict[str, set] = {}
    for atom in (*rule.heads, *atoms):
        if atom.negated or not atom.arguments or not all(map(is_variable, atom.arguments)) or len(set(atom.arguments)) < len(atom.arguments):
            return False
        for name, column in zip(atom.arguments, resolved.relations[atom.relation].columns, strict=True):
            if column.nullable or not isinstance(column.spark, _PLAIN):
                return False
            types.setdefault(name, set()).add(column.spark)
    if len(rule.heads) > 1 or any(len(t) > 1 for t in types.values()):
        return False
    for item in rule.body:
        if isinstance(item, Condition):
            found = _COMPARED.fullmatch(item.expression)
            if not found or not {found[1], found[3]} <= set(types) or types[found[1]] != types[found[3]]:
                return False
        elif not isinstance(item, Atom):
            return False
    return True


def _tables_first(rule: Rule, inner: Atom) -> Rule:
    """Begins with a table, whose rows are dealt out, not with the few rows of the recursion."""
    items = rule.ordered()
    if items[0] != inner:
        return replace(rule, body=items, order=None)
    lead = next((x for x in items if isinstance(x, Atom) and x != inner and set(x.arguments) & set(inner.arguments)), inner)
    return replace(rule, body=(lead, *(x for x in items if x is not lead)), order=None)


def _atoms(rule: Rule, name: str) -> list[Atom]:
    return [x for x in rule.ordered() if isinstance(x, Atom) and x.relation != name]


def _determines(rule: Rule, name: str, keys: set[Key]) -> bool:
    """Whether the head's values leave one row of each table, given keys, which are added."""
    bound = set(rule.heads[0].arguments)
    left = _atoms(rule, name)
    while ready := [a for a in left if bound & set(a.arguments)]:
        atom = ready[0]
        left.remove(atom)
        own = tuple(i for i, v in enumerate(atom.arguments) if v in bound)
        if len(own) < len(atom.arguments):
            keys.add((atom.relation, own))
        bound |= set(atom.arguments)
    return not left and all(v in bound for x in rule.body if isinstance(x, Atom) for v in x.arguments)


def _outside(rule: Rule, before: Rule, name: str, keys: set[Key]) -> str | None:
    """The condition on the rule's body that its row is not one of the rule before; None if keys do not tell."""
    term = dict(zip(before.heads[0].arguments, rule.heads[0].arguments, strict=True))
    left, tests = _atoms(before, name), []
    # a null equals nothing in a join, but it is a value of a row
    joins = {v for a in left for v in a.arguments if sum(v in b.arguments for b in left) > 1}
    while left:
        met = next(((a, b) for a in left for b in _atoms(rule, name) if a.relation == b.relation and _same_row(a, b, term, keys)), None)
        if met is None:
            return None
        left.remove(met[0])
        for v, w in zip(met[0].arguments, met[1].arguments, strict=True):
            if term.setdefault(v, w) != w:
                tests.append(f"{term[v]} {'=' if v in joins else '<=>'} {w}")
    tests += [f"isnotnull({term[v]})" for v in sorted(joins)]
    for item in before.body:
        if isinstance(item, Condition):
            a, sign, b = _COMPARED.fullmatch(item.expression).groups()
            tests.append(f"{term[a]} {sign} {term[b]}")
    return f"not coalesce({' and '.join(tests) or 'true'}, false)"


def _same_row(a: Atom, b: Atom, term: dict[str, str], keys: set[Key]) -> bool:
    return any(n == a.relation and all(term.get(a.arguments[i]) == b.arguments[i] for i in own) for n, own in keys)


def _joinable(rule: Rule, joined: list[tuple[int, str, int, int]]) -> Rule:
    """The rule for rows whose values are found in the tables that the recursive atom is joined with."""
    body, waiting = [], list(joined)
    for item in rule.ordered():
        body.append(item)
        names = set(item.names()) if isinstance(item, Atom) else set()
        for test in [t for t in waiting if rule.heads[0].arguments[t[0]] in names]:
            k, table, place, width = test
            waiting.remove(test)
            body.append(Atom(table, tuple(rule.heads[0].arguments[k] if i == place else WILDCARD for i in range(width))))
    return replace(rule, body=tuple(body), order=None)


def expand(e: Expansion, fixpoint: Fixpoint, scan: Callable[[str], DataFrame]) -> DataFrame | None:
    """All rows, without duplicates; None if the tables do not have the keys."""
    compiler, store = fixpoint.compiler, fixpoint.store
    tables: dict[str, DataFrame] = {}
    rows: dict[str, int] = {}
    small: dict[str, bool] = {}
    for name in e.tables():
        part = scan(name).distinct()
        path, rows[name] = store.write(part)
        tables[name], small[name] = store.read([path], part.schema), store.size(path) <= SENT_BYTES
    for name, own in sorted(e.keys):
        if not tables[name].groupBy(*(f"c{i}" for i in own)).count().filter("count > 1").isEmpty():
            return None
    base = reduce(DataFrame.unionByName, [compiler.rows(r, r.heads[0], lambda _, n: tables[n]) for r in e.needed[:-1]]).distinct()
    known = fixpoint.rounds(Region(e.needed[-1:], True), lambda _: base, tables)[e.relation]
    tables[e.relation] = store.read(known.paths, known.schema)
    small[e.relation] = sum(map(store.size, known.paths)) <= SENT_BYTES
    most = int(fixpoint.store.spark.conf.get("spark.sql.shuffle.partitions"))

    def read(place: int, name: str) -> DataFrame:
        if place:
            return tables[name].hint("broadcast") if small[name] else tables[name]
        tasks = min(most, rows.get(name, 0) // ROWS_A_TASK)
        return tables[name].repartition(tasks, *tables[name].columns) if tasks > 1 else tables[name]

    return reduce(DataFrame.unionByName, [compiler.rows(r, r.heads[0], read) for r in e.whole])
