"""Binding patterns: predicates and projections over a column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltarule.errors import RuleError
from deltarule.text import NAME, split_top

Expr = Callable[[str], Column]


@dataclass(frozen=True)
class Pattern:
    """kind: name, any, tuple, some, none, variant, literal, range, slice, fields or bind (name @ part)."""

    kind: str
    text: str = ""
    parts: tuple[Pattern, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Pattern:
        text = text.strip()
        for word in ("&", "ref ", "mut "):
            text = text.removeprefix(word).strip()
        inner = lambda s: tuple(cls.parse(x) for x in split_top(s, ",") if x.strip())
        if text in ("_", ".."):
            return cls("any" if text == "_" else "rest")
        if text == "None":
            return cls("none")
        if text.lower() in ("true", "false"):
            return cls("literal", text)
        if NAME.fullmatch(text):
            return cls("name", text)
        if m := re.fullmatch(r"(\w+)\s*@\s*(.*)", text, re.S):
            return cls("bind", m[1], (cls.parse(m[2]),))
        if m := re.fullmatch(r"(\w+)\s*:\s*(?!:)(.*)", text, re.S):
            return cls("name", m[1])
        if re.fullmatch(r"-?\d[\w.]*|'.*'|\".*\"", text, re.S) and ".." not in text:
            return cls("literal", text)
        if m := re.fullmatch(r"(-?\w*)\.\.(=?)(-?\w*)", text):
            return cls("range", text, (cls("literal", m[1]), cls("literal", m[2]), cls("literal", m[3])))
        if text.startswith("(") and text.endswith(")"):
            parts = inner(text[1:-1])
            return parts[0] if len(parts) == 1 and not text[1:-1].rstrip().endswith(",") else cls("tuple", "", parts)
        if text.startswith("[") and text.endswith("]"):
            return cls("slice", "", inner(text[1:-1]))
        if m := re.fullmatch(r"Some\s*\((.*)\)", text, re.S):
            return cls("some", "", inner(m[1]))
        if m := re.fullmatch(r"(?:\w+::)?([A-Z]\w*)\s*(?:\((.*)\))?", text, re.S):
            return cls("variant" if "::" in text else "tuple", m[1], inner(m[2] or ""))
        if m := re.fullmatch(r"(?:\w+::)*[A-Z]\w*\s*\{(.*)\}", text, re.S):
            fields = [x.partition(":") for x in split_top(m[1], ",") if x.strip() and x.strip() != ".."]
            return cls("fields", ",".join(f[0].strip() for f in fields), tuple(cls.parse(f[2] or f[0]) for f in fields))
        raise RuleError(f"unsupported binding pattern {text}")

    def names(self) -> list[str]:
        own = [self.text] if self.kind in ("name", "bind") else []
        return own + [n for p in self.parts for n in p.names()]

    def bind(self, value: Column, expr: Expr) -> tuple[list[Column], dict[str, Column]]:
        """Tests that must hold, and the columns of the names."""
        if self.kind in ("any", "rest"):
            return [], {}
        if self.kind == "name":
            return [], {self.text: value}
        if self.kind == "bind":
            tests, found = self.parts[0].bind(value, expr)
            return tests, {self.text: value} | found
        if self.kind == "none":
            return [value.isNull()], {}
        if self.kind == "literal":
            return [value.eqNullSafe(expr(self.text))], {}
        if self.kind == "range":
            low, closed, high = (p.text for p in self.parts)
            tests = [value >= expr(low)] if low else []
            return tests + ([(value <= expr(high)) if closed else (value < expr(high))] if high else []), {}
        tests: list[Column] = []
        found: dict[str, Column] = {}
        if self.kind == "some":
            tests, at = [value.isNotNull()], [value]
        elif self.kind == "variant":
            tests, at = [value.getField("tag").eqNullSafe(F.lit(self.text))], [value.getField(self.text).getField(f"_{i}") for i in range(len(self.parts))]
        elif self.kind == "tuple":
            at = [value.getField(f"_{i}") for i in range(len(self.parts))]
        elif self.kind == "fields":
            at = [value.getField(n) for n in self.text.split(",")]
        else:
            rest = [i for i, p in enumerate(self.parts) if p.kind == "rest"]
            fixed = len(self.parts) - len(rest)
            tests = [F.size(value) >= fixed if rest else F.size(value) == fixed]
            at = [F.get(value, F.lit(i) if not rest or i <= rest[0] else F.size(value) - (len(self.parts) - i)) for i in range(len(self.parts))]
        for part, column in zip(self.parts, at, strict=True):
            more, names = part.bind(column, expr)
            tests += more
            found |= names
        return tests, found
