"""Cutting rule text: comments, quotes and brackets."""

from __future__ import annotations

import re

from deltarule.errors import RuleError

_OPEN, _CLOSE = "([{", ")]}"
_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"")


def without_comments(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] in "'\"" and (m := _STRING.match(text, i)):
            out.append(m[0])
            i = m.end()
        elif text.startswith("//", i):
            i = (text + "\n").index("\n", i)
        elif text.startswith("/*", i):
            if (end := text.find("*/", i)) < 0:
                raise RuleError("a comment has no end")
            i = end + 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def split_top(text: str, sign: str, angles: bool = False, most: int = -1) -> list[str]:
    """Splits at ``sign`` outside quotes and brackets (with angles, outside < > too)."""
    opening, closing = (_OPEN + "<", _CLOSE + ">") if angles else (_OPEN, _CLOSE)
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "'\"" and (m := _STRING.match(text, i)):
            i = m.end()
            continue
        if c in opening:
            depth += 1
        elif c in closing:
            depth -= 1
            if depth < 0:
                raise RuleError(f"a bracket is closed that was not opened: {text.strip()[:60]}")
        elif depth == 0 and text.startswith(sign, i) and most != 0:
            out.append(text[start:i])
            i += len(sign)
            start, most = i, most - 1
            continue
        i += 1
    if depth:
        raise RuleError(f"a bracket is not closed: {text.strip()[:60]}")
    return [*out, text[start:]]


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_TOKEN = re.compile(r"(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")|(?P<quoted>`[^`]*`)|(?P<number>\d[\w.]*)|(?P<path>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)+)|(?P<name>[A-Za-z_]\w*)|(?P<arrow>->)|(?P<other>\s+|.)", re.S)
#: Words of Spark SQL expressions that are never variables.
WORDS = frozenset(
    "and or not in is null true false case when then else end between like rlike ilike regexp div cast try_cast as distinct interval date timestamp "
    "none string int integer bigint smallint tinyint double float boolean decimal binary array map struct escape any all some exists from for".split()
)


def tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup or "other", m[0]) for m in _TOKEN.finditer(text)]


def variables(text: str) -> set[str]:
    """Names in an expression that are neither functions, fields, words nor lambda arguments."""
    found, bound = set(), set()
    parts = [t for t in tokens(text) if not t[1].isspace()]
    for i, (kind, value) in enumerate(parts):
        if kind != "name":
            continue
        before, after = parts[i - 1][1] if i else "", parts[i + 1][1] if i + 1 < len(parts) else ""
        if after == "->":
            bound.add(value)
        elif before == "." or after == "(" or value.lower() in WORDS:
            continue
        else:
            found.add(value)
    return found - bound
