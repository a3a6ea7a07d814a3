"""Texts of well-known recursive programs."""

from __future__ import annotations

REACH = "relation edge(i64, i64); relation source(i64); relation reach(i64); reach(x) :- source(x); reach(y) :- reach(x), edge(x, y);"
TC = "relation edge(i64, i64); relation path(i64, i64); path(x, y) :- edge(x, y); path(x, z) :- path(x, y), edge(y, z);"
SAME_GENERATION = "relation parent(i64, i64); relation same(i64, i64); same(x, y) :- parent(p, x), parent(p, y), if x <> y; same(x, y) :- parent(p, x), same(p, q), parent(q, y);"
BALANCED = (
    "relation edge(i64, i64, i32); relation open(i32, i32); relation match(i64, i64);"
    "match(x, y) :- edge(x, m, a), edge(m, y, b), open(a, b); match(x, y) :- edge(x, u, a), match(u, v), edge(v, y, b), open(a, b); match(x, z) :- match(x, y), match(y, z);"
)
COMPONENTS = "relation edge(i64, i64); relation label(i64, i64); label(x, m) :- agg m = min(x) in edge(x, _); label(y, m) :- label(x, l), agg m = min(l) in edge(x, y);"
#: Needs a relation edge(from, to, weight); fill in relation, seed and step.
SHORTEST = "relation {relation}(i64, i64); {relation}({seed}, 0); {relation}(y, m) :- {relation}(x, d), agg m = min({step}) in edge(x, y, w);"
#: Inclusion-based points-to: address of, copy, load and store.
POINTS_TO = (
    "relation addr(i64, i64); relation assign(i64, i64); relation load(i64, i64); relation store(i64, i64); relation points(i64, i64);"
    "points(x, o) :- addr(x, o); points(x, o) :- assign(x, y), points(y, o);"
    "points(x, o) :- load(x, y), points(y, p), points(p, o); points(p, o) :- store(x, y), points(x, p), points(y, o);"
)
#: Value flow and aliases: a copy or an aliased place passes a value on; dereferences of aliased pointers are one place.
ALIASES = (
    "relation copies(i64, i64); relation deref(i64, i64); relation flow(i64, i64); relation same_place(i64, i64); relation same_value(i64, i64);"
    "flow(x, x), flow(y, y) :- copies(x, y); flow(x, x), flow(y, y) :- deref(x, y); flow(x, y) :- copies(x, y); flow(x, z) :- flow(x, y), flow(y, z); flow(x, z) :- copies(x, y), same_place(y, z);"
    "same_place(a, b) :- deref(p, a), same_value(p, q), deref(q, b);"
    "same_value(x, y) :- flow(x, z), flow(y, z); same_value(x, y) :- flow(x, a), same_place(a, b), flow(y, b);"
)
PROGRAMS = {"reach": REACH, "tc": TC, "same_generation": SAME_GENERATION, "balanced": BALANCED, "components": COMPONENTS, "points_to": POINTS_TO, "aliases": ALIASES}


def closure(result: str, step: str, columns: str) -> str:
    """Transitive closure of step(key.., a, b) into result(key.., a, b)."""
    name, arguments = result.rstrip(")").split("(")
    *keys, _, _ = (x.strip() for x in arguments.split(","))
    prefix = "".join(f"{k}, " for k in keys)
    edge = step.split("(")[0]
    return f"relation {name}({columns}); {result} :- {step}; {name}({prefix}a, b) :- {name}({prefix}a, m), {edge}({prefix}m, b);"
