"""Checks a program and sorts its rules into regions.

Regions are the strongly connected components of the graph of rules (a rule depends on
the rules that make what it reads), in topological order. A component is recursive if it
has several rules or one that reads its own head.
"""

from __future__ import annotations

from dataclasses import dataclass

from deltarule.ast import AGGREGATES, WILDCARD, Aggregate, Atom, Condition, Generator, Let, Program, Relation, Rule, is_variable
from deltarule.errors import RuleError
from deltarule.patterns import Pattern
from deltarule.text import variables


@dataclass(frozen=True)
class Region:
    rules: tuple[Rule, ...]
    recursive: bool

    def heads(self) -> list[str]:
        return list(dict.fromkeys(h.relation for r in self.rules for h in r.heads))


@dataclass
class Resolved:
    program: Program
    relations: dict[str, Relation]
    inputs: list[str]
    outputs: list[str]
    facts: list[Rule]
    regions: list[Region]

    def needed(self, outputs: list[str]) -> list[Region]:
        """Regions that the outputs depend on."""
        wanted, kept = set(outputs), []
        for region in reversed(self.regions):
            if wanted & set(region.heads()):
                kept.append(region)
                for rule in region.rules:
                    wanted |= rule.reads()
        return kept[::-1]


def resolve(program: Program) -> Resolved:
    relations: dict[str, Relation] = {}
    for relation in program.relations:
        if relation.name in relations:
            raise RuleError(f"relation {relation.name} is declared twice")
        relations[relation.name] = relation
    for rule in program.rules:
        if not rule.heads:
            raise RuleError("a rule has no head")
        for atom in [*rule.heads, *(i for i in rule.body if isinstance(i, Atom)), *(i.source for i in rule.body if isinstance(i, Aggregate))]:
            if atom.relation not in relations:
                raise RuleError(f"relation {atom.relation} is not declared")
            if len(atom.arguments) != len(relations[atom.relation].columns):
                raise RuleError(f"relation {atom.relation} has {len(relations[atom.relation].columns)} columns, not {len(atom.arguments)}")
        check_rule(rule)
    for name in program.outputs or ():
        if name not in relations:
            raise RuleError(f"output names the undeclared relation {name}")
    rules = [r for r in program.rules if not r.is_fact]
    facts = [r for r in program.rules if r.is_fact]
    made = {h.relation for r in rules for h in r.heads}
    fixed = {h.relation for r in facts for h in r.heads}
    hybrid = {n for n in made if all(n in r.reads(negated=False) for r in rules if n in {h.relation for h in r.heads})}
    inputs = [n for n in relations if n not in made or n in fixed or n in hybrid]
    outputs = [n for n in relations if n in made] if program.outputs is None else list(program.outputs)
    return Resolved(program, relations, inputs, outputs, facts, schedule(rules))


def schedule(rules: list[Rule]) -> list[Region]:
    makers: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for head in rule.heads:
            makers.setdefault(head.relation, []).append(i)
    needs = [sorted({j for name in rule.reads() for j in makers.get(name, ())}) for rule in rules]
    regions: list[Region] = []
    level: dict[int, int] = {}
    flat: dict[int, list[int]] = {}
    for component in _components(needs):
        inside = set(component)
        depth = 1 + max((level[j] for i in component for j in needs[i] if j not in inside), default=-1)
        recursive = len(component) > 1 or component[0] in needs[component[0]]
        level |= dict.fromkeys(component, depth)
        if not recursive:
            flat.setdefault(depth, []).append(component[0])
            continue
        own = tuple(rules[i] for i in sorted(component))
        heads = {h.relation for r in own for h in r.heads}
        for rule in own:
            if bad := rule.reads(negated=True) & heads:
                raise RuleError(f"negation of {sorted(bad)[0]} inside a recursive component")
        regions.append(Region(own, True))
        level |= dict.fromkeys(component, depth)
        flat.setdefault(depth, []).append(-len(regions))
    out = []
    for depth in sorted(flat):
        plain = tuple(rules[i] for i in sorted(flat[depth]) if i >= 0)
        if plain:
            out.append(Region(plain, False))
        out += [regions[-i - 1] for i in flat[depth] if i < 0]
    return out


def _components(needs: list[list[int]]) -> list[list[int]]:
    """Tarjan's algorithm without recursion; dependencies come first."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    held: set[int] = set()
    out = []
    for root in range(len(needs)):
        if root in number:
            continue
        work = [(root, iter(needs[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        held.add(root)
        while work:
            node, edges = work[-1]
            for other in edges:
                if other not in number:
                    number[other] = low[other] = len(number)
                    stack.append(other)
                    held.add(other)
                    work.append((other, iter(needs[other])))
                    break
                if other in held:
                    low[node] = min(low[node], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    component = []
                    while not component or component[-1] != node:
                        component.append(stack.pop())
                        held.discard(component[-1])
                    out.append(component)
    return out


def lattice_of(rule: Rule) -> Aggregate | None:
    """The aggregate of a recursive rule that keeps a least or greatest value: the last head
    column is the binding of its one aggregate, min or max, over a relation outside the component."""
    found = [i for i in rule.body if isinstance(i, Aggregate)]
    if len(found) == 1 and len(rule.heads) == 1 and found[0].operator in ("min", "max") and rule.heads[0].arguments[-1:] == (found[0].binding,):
        return found[0]
    return None


def check_rule(rule: Rule) -> None:
    """Binding rules: what each item may use and bind, from left to right."""
    for head in rule.heads:
        if WILDCARD in head.arguments:
            raise RuleError(f"_ in the head {head.relation}")
    if rule.is_fact:
        for head in rule.heads:
            for argument in head.arguments:
                _bound(argument, set(), f"fact of {head.relation}")
        return
    if rule.order is not None and sorted(rule.order) != list(range(len(rule.body))):
        raise RuleError("the body order is not a permutation of the body")
    body = rule.ordered()
    if not (isinstance(body[0], Aggregate) or isinstance(body[0], Atom) and not body[0].negated):
        raise RuleError("a body must begin with a positive atom or an aggregate")
    bound: set[str] = set()
    grouped = rule.direct_aggregate() is not None or lattice_of(rule) is not None
    for item in body:
        if isinstance(item, Atom) and not item.negated:
            for argument in item.arguments:
                if argument != WILDCARD and not is_variable(argument):
                    _bound(argument, bound | set(item.names()), f"atom {item.relation}")
            bound |= set(item.names())
        elif isinstance(item, Atom):
            for argument in item.arguments:
                if argument != WILDCARD:
                    _bound(argument, bound, f"negated atom {item.relation}")
        elif isinstance(item, Condition):
            _bound(item.expression, bound, "condition")
        elif isinstance(item, Let | Generator):
            _bound(item.expression, bound, "expression")
            _fresh(Pattern.parse(item.pattern).names(), bound)
            bound |= set(Pattern.parse(item.pattern).names())
        else:
            _check_aggregate(item, bound, grouped)
            _fresh([item.binding], bound)
            bound.add(item.binding)
            if grouped:
                bound |= set(item.source.names())
    for head in rule.heads:
        for argument in head.arguments:
            _bound(argument, bound, f"head {head.relation}")


def _check_aggregate(item: Aggregate, bound: set[str], grouped: bool) -> None:
    if item.operator not in AGGREGATES:
        raise RuleError(f"unsupported aggregate {item.operator}")
    if item.operator == "count" and not grouped:
        if item.arguments:
            raise RuleError("count takes no argument unless it is the whole body")
    elif len(item.arguments) != 1:
        raise RuleError(f"{item.operator} takes exactly one argument")
    for argument in item.arguments:
        _bound(argument, bound | set(item.source.names()) if grouped else set(item.source.names()), f"aggregate {item.operator}")
    for argument in item.source.arguments:
        if argument != WILDCARD and not is_variable(argument):
            _bound(argument, bound, f"aggregate source {item.source.relation}")


def _bound(expression: str, bound: set[str], where: str) -> None:
    if missing := variables(expression) - bound - {"None"}:
        raise RuleError(f"{sorted(missing)[0]} is not bound in {where}")


def _fresh(names: list[str], bound: set[str]) -> None:
    if len(names) != len(set(names)):
        raise RuleError("a pattern binds a variable twice")
    if taken := bound & set(names):
        raise RuleError(f"{sorted(taken)[0]} is bound already")
