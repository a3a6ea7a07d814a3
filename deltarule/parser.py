"""The rule language: text to a Program.

    struct Reach;                                  // a name, optional; struct Name<N>; has type parameters
    #![output(reach)]                              // optional; also profile
    enum Shape { Dot, Circle(f64) }                // optional sum types
    relation edge(i32, i32);  relation reach(i32);
    edge(1, 2);                                    // facts
    reach(y) :- reach(x), edge(x, y), if y <> 7;   // rules; heads may be several

Body items are atoms, negated atoms (!), ``if``, ``if let``, ``let``, ``for .. in`` and
``agg b = op(..) in rel(..)``; ``(a, b ; c)`` is a disjunction. Expressions are Spark SQL.
"""

from __future__ import annotations

import re
from itertools import product

from deltarule.ast import Aggregate, Atom, Condition, Generator, Item, Let, Program, Relation, Rule
from deltarule.errors import RuleError
from deltarule.text import NAME, split_top, without_comments
from deltarule.types import ColumnType, enum_type, parse_type

_ATTRIBUTE = re.compile(r"#!?\[\s*(\w+)\s*(?:\(([^)]*)\))?\s*\]")
_CALL = re.compile(r"\s*([A-Za-z_]\w*)\s*\((.*)\)\s*", re.S)


def parse(text: str, types: dict[str, str] | None = None) -> Program:
    """types: what the parameters of ``struct Name<..>`` stand for."""
    program = Program(types={k: parse_type(v) for k, v in (types or {}).items()})
    text = without_comments(text)
    for name, inside in _ATTRIBUTE.findall(text):
        if name == "output":
            if program.outputs is not None:
                raise RuleError("more than one output attribute")
            program.outputs = tuple(x.strip() for x in inside.split(",") if x.strip())
        elif name == "profile":
            program.profile = True
        else:
            raise RuleError(f"unknown program attribute {name}")
    statements = _statements(_ATTRIBUTE.sub(" ", text))
    for statement in statements:
        if m := re.fullmatch(r"(?:pub\s+)?enum\s+(\w+)\s*\{(.*)\}", statement, re.S):
            variants = [x.strip() for x in split_top(m[2], ",") if x.strip()]
            program.enums[m[1]] = {NAME.match(v)[0]: _arguments(v[v.index("(") + 1 : -1], angles=True) if "(" in v else [] for v in variants}
            program.types[m[1]] = enum_type(program.enums[m[1]], program.types)
        elif m := re.fullmatch(r"(?:pub\s+)?struct\s+(\w+)\s*(?:<(.*?)>)?(?:\s*where.*)?", statement, re.S):
            program.name = m[1]
            for parameter in (x.partition(":")[0].strip() for x in split_top(m[2] or "", ",", angles=True)):
                if parameter and parameter not in program.types:
                    raise RuleError(f"no type is given for the parameter {parameter}")
        elif m := re.fullmatch(r"(?:pub\s+)?relation\s+(\w+)\s*\((.*)\)", statement, re.S):
            program.relations.append(Relation(m[1], _columns(m[2], program.types)))
        else:
            program.rules += _rules(statement)
    return program


def _columns(text: str, known: dict[str, ColumnType]) -> tuple[ColumnType, ...]:
    return tuple(parse_type(x, known) for x in _arguments(text, angles=True))


def _statements(text: str) -> list[str]:
    out = []
    for part in split_top(text, ";"):
        part = part.strip()
        while m := re.match(r"(?:pub\s+)?enum\s+\w+\s*\{[^}]*\}", part):  # an enum ends without a semicolon
            out.append(m[0])
            part = part[m.end() :].strip()
        if part:
            out.append(part)
    return out


def _arguments(text: str, angles: bool = False) -> list[str]:
    parts = [x.strip() for x in split_top(text, ",", angles)]
    return parts[:-1] if parts and not parts[-1] else parts


def atom(text: str, negated: bool = False) -> Atom:
    m = _CALL.fullmatch(text)
    if not m:
        raise RuleError(f"expected an atom: {text.strip()[:80]}")
    return Atom(m[1], tuple(_arguments(m[2])), negated)


def _rules(statement: str) -> list[Rule]:
    for arrow in (":-", "<--", "<-"):
        parts = split_top(statement, arrow, most=1)
        if len(parts) == 2:
            break
    if not parts[0].strip():
        raise RuleError("a rule has no head")
    heads = tuple(atom(x) for x in split_top(parts[0], ","))
    if len(parts) == 1:
        return [Rule(heads, ())]
    if not parts[1].strip():
        raise RuleError("a rule has no body after its arrow")
    return [Rule(heads, body) for body in bodies(parts[1])]


def bodies(text: str) -> list[tuple[Item, ...]]:
    """All alternatives of a body; a disjunction multiplies them."""
    choices: list[list[tuple[Item, ...]]] = []
    for part in (x.strip() for x in split_top(text, ",")):
        if part.startswith("(") and part.endswith(")"):
            choices.append([b for x in split_top(part[1:-1], ";") for b in bodies(x)])
        else:
            choices.append([(item(part),)])
    return [tuple(i for group in choice for i in group) for choice in product(*choices)]


def item(text: str) -> Item:
    text = text.strip()
    if m := re.match(r"if\s+let\s+(.*)", text, re.S):
        return Let(*_assignment(m[1]), refutable=True)
    if m := re.match(r"if\b(.*)", text, re.S):
        return Condition(m[1].strip())
    if m := re.match(r"let\s+(.*)", text, re.S):
        return Let(*_assignment(m[1]))
    if m := re.match(r"for\s+(.*?)\s+in\s+(.*)", text, re.S):
        return Generator(m[1].strip(), m[2].strip())
    if m := re.fullmatch(r"agg\s+(\w+)\s*=\s*(\w+)\s*\((.*)\)\s+in\s+(\w+\s*\(.*\))", text, re.S):
        return Aggregate(m[1], m[2], tuple(_arguments(m[3])), atom(m[4]))
    if text.startswith("!"):
        return atom(text[1:], negated=True)
    return atom(text)


def _assignment(text: str) -> tuple[str, str]:
    parts = split_top(text, "=")
    first = 2 if parts[0].rstrip().endswith("..") else 1  # a closed range holds a sign of its own
    pattern, expression = "=".join(parts[:first]).strip(), "=".join(parts[first:]).strip()
    if not pattern or not expression:
        raise RuleError(f"expected pattern = expression: {text[:80]}")
    return pattern, expression


def parse_dl(text: str) -> Program:
    """A second reader: ``.decl R(x: int32)``, ``.input R``, ``.output R``, ``Head(x) :- Body.``"""
    names = {"number": "i32", "int": "i32", "symbol": "String", "string": "String", "unsigned": "u32", "float": "f64"}
    names |= {f"{a}{n}": f"{a[0]}{n}" for a in ("int", "uint", "float") for n in (8, 16, 32, 64)}
    program, outputs = Program(), []
    text = without_comments(text)
    for kind, name, columns in re.findall(r"\.(decl|output)\s+(\w+)\s*(?:\(([^)]*)\))?", text):
        if kind == "output":
            outputs.append(name)
        else:
            declared = [x.partition(":")[2].strip() for x in columns.split(",") if x.strip()]
            program.relations.append(Relation(name, tuple(parse_type(names.get(x, x)) for x in declared)))
    program.outputs = tuple(outputs) or None
    rest = re.sub(r"\.(decl|output|input|printsize)\s+\w+[ \t]*(\([^)]*\))?[^\n]*", " ", text)
    for statement in (x.strip() for x in re.split(r"\.(?=\s|$)", rest)):
        if statement:
            head, arrow, body = statement.partition(":-")
            parts = [x.strip() for x in split_top(body, ",")] if arrow else []
            items = [x if _CALL.fullmatch(x.lstrip("!")) else f"if {x}" for x in parts]
            program.rules += _rules(head + (":- " + ", ".join(items) if arrow else ""))
    return program
