"""Host expressions: Spark SQL with rule variables, tuples, variants and a few short names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltarule.ast import Program
from deltarule.errors import RuleError
from deltarule.text import WORDS, split_top, tokens

#: Function names of rule programs that Spark calls otherwise.
RENAMED = {"strlen": "length", "cat": "concat", "to_string": "string", "to_number": "int", "ord": "ascii", "len": "size", "starts_with": "startswith", "min": "least", "max": "greatest"}
#: Functions that are more than another name: parameters and the SQL for them. wrapping_abs keeps the least integer.
WRITTEN = {
    "clamp": ("greatest({1}, least({2}, {0}))", 3),
    "wrapping_abs": ("if({0} < 0, coalesce(try_subtract({0} - {0}, {0}), {0}), {0})", 1),
}
_RISKY = ("/", "%", " div ", "cast(", "element_at(", "[", "int(", "mod(")


class Expressions:
    def __init__(self, program: Program):
        self.program = program

    def column(self, text: str, guards: tuple[Column, ...] = ()) -> Column:
        """guards: conditions that hold where the expression may be evaluated. Filters can be
        moved by the optimizer, so an expression that can fail is put behind them again."""
        column = F.expr(self.sql(text))
        if guards and any(sign in text for sign in _RISKY):
            condition = guards[0]
            for guard in guards[1:]:
                condition = condition & guard
            column = F.when(condition, column)
        return column

    def sql(self, text: str) -> str:
        parts = tokens(text)
        out: list[str] = []
        i = 0
        while i < len(parts):
            kind, value = parts[i]
            after = self._next(parts, i + 1)
            before = self._last(out)
            if kind == "string":
                out.append("'" + value[1:-1].replace("'", "\\'") + "'" if value[0] == '"' else value)
            elif kind == "path":
                i = self._variant(parts, i, out)
            elif kind == "number" and before == ".":
                out.append("._".join(("_" + value).split(".")))
            elif kind == "name" and value == "None":
                out.append("NULL")
            elif kind == "name" and value == "Some" and after == "(":
                pass
            elif kind == "name" and before == ".":
                out.append(value)
            elif kind == "name" and after == "(" and value in WRITTEN:
                i = self._written(parts, i, out)
            elif kind == "name" and after == "(":
                out.append(RENAMED.get(value, value))
            elif kind == "name" and value.lower() not in WORDS:
                out.append(f"`{value}`" if after != "->" else value)
            elif value in "([" and len(value) == 1:
                end = self._close(parts, i)
                inside = "".join(v for _, v in parts[i + 1 : end])
                if value == "[" and not (before[-1:].isalnum() or before[-1:] in ("`", ")", "]", "_")):
                    out.append("array(" + ", ".join(self.sql(x) for x in split_top(inside, ",") if x.strip()) + ")")
                elif value == "(" and not self._call(out) and len(split_top(inside, ",")) > 1:
                    fields = [x for x in split_top(inside, ",") if x.strip()]
                    out.append("named_struct(" + ", ".join(f"'_{k}', {self.sql(x)}" for k, x in enumerate(fields)) + ")")
                else:
                    out.append(value + self.sql(inside) + parts[end][1])
                i = end
            elif value == "&" and after == "&":
                out.append(" AND ")
                i += 1
            else:
                out.append(value)
            i += 1
        return "".join(out)

    def _variant(self, parts: list[tuple[str, str]], i: int, out: list[str]) -> int:
        enum, _, variant = parts[i][1].rpartition("::")
        known = self.program.enums.get(enum)
        if known is None or variant not in known:
            raise RuleError(f"unknown variant {parts[i][1]}")
        end, given = i, []
        if i + 1 < len(parts) and parts[i + 1][1] == "(":
            end = self._close(parts, i + 1)
            given = [x for x in split_top("".join(v for _, v in parts[i + 2 : end]), ",") if x.strip()]
        if len(given) != len(known[variant]):
            raise RuleError(f"{parts[i][1]} takes {len(known[variant])} values")
        payload = "named_struct(" + ", ".join(f"'_{k}', {self.sql(x)}" for k, x in enumerate(given)) + ")"
        fields = [f"'tag', '{variant}'"] + [f"'{v}', {payload if v == variant else 'NULL'}" for v, types in known.items() if types]
        out.append(f"cast(named_struct({', '.join(fields)}) as {self.program.types[enum].name})")
        return end

    def _written(self, parts: list[tuple[str, str]], i: int, out: list[str]) -> int:
        form, count = WRITTEN[parts[i][1]]
        begin = next(j for j in range(i + 1, len(parts)) if parts[j][1] == "(")
        end = self._close(parts, begin)
        given = [x for x in split_top("".join(v for _, v in parts[begin + 1 : end]), ",") if x.strip()]
        if len(given) != count:
            raise RuleError(f"{parts[i][1]} takes {count} values")
        out.append(form.format(*(f"({self.sql(x)})" for x in given)))
        return end

    @staticmethod
    def _next(parts: list[tuple[str, str]], i: int) -> str:
        while i < len(parts) and parts[i][1].isspace():
            i += 1
        return parts[i][1] if i < len(parts) else ""

    @staticmethod
    def _last(out: list[str]) -> str:
        return next((x.strip() for x in reversed(out) if x.strip()), "")

    def _call(self, out: list[str]) -> bool:
        last = out[-1] if out else ""
        return last[-1:].isalnum() and not last.isdigit() and last.lower() not in ("and", "or", "not", "then", "else", "when", "case") or last.lower() == "in"

    @staticmethod
    def _close(parts: list[tuple[str, str]], i: int) -> int:
        depth = 0
        for j in range(i, len(parts)):
            if parts[j][0] == "other":
                depth += (parts[j][1] in "([") - (parts[j][1] in ")]")
                if not depth:
                    return j
        raise RuleError("a bracket is not closed")
