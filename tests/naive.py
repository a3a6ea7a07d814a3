"""A naive evaluator of plain rules (atoms, negation, Python conditions) for comparison."""

from __future__ import annotations


def evaluate(facts: dict[str, set[tuple]], rules: list[tuple]) -> dict[str, set[tuple]]:
    """rules: (head, arguments, body, test); body: (relation, arguments, negated). One stratum at a time, as listed in groups."""
    known = {k: set(v) for k, v in facts.items()}
    changed = True
    while changed:
        changed = False
        for head, arguments, body, test in rules:
            for env in _matches(body, known, {}):
                if test is None or test(env):
                    row = tuple(env.get(a, a) for a in arguments)
                    if row not in known.setdefault(head, set()):
                        known[head].add(row)
                        changed = True
    return known


def _matches(body, known, env):
    if not body:
        yield env
        return
    (relation, arguments, negated), *rest = body
    if negated:
        wanted = [(i, env.get(a, a)) for i, a in enumerate(arguments) if a != "_"]
        if not any(all(row[i] == v for i, v in wanted) for row in known.get(relation, ())):
            yield from _matches(rest, known, env)
        return
    for row in list(known.get(relation, ())):
        new = dict(env)
        if all(a == "_" or (new.setdefault(a, v) == v if isinstance(a, str) else a == v) for a, v in zip(arguments, row)):
            yield from _matches(rest, known, new)
