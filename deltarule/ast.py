"""Programs as data: what every front end produces."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from deltarule.text import NAME, variables
from deltarule.types import ColumnType

WILDCARD = "_"
AGGREGATES = ("count", "min", "max", "sum", "mean")


def is_variable(argument: str) -> bool:
    return bool(NAME.fullmatch(argument)) and argument != WILDCARD and argument.lower() not in ("true", "false", "null", "none")


@dataclass(frozen=True)
class Atom:
    relation: str
    arguments: tuple[str, ...]
    negated: bool = False

    def names(self) -> list[str]:
        """Variables in argument places, in order, repeats included."""
        return [x for x in self.arguments if is_variable(x)]


@dataclass(frozen=True)
class Condition:
    expression: str


@dataclass(frozen=True)
class Let:
    """pattern = expression; refutable: rows that do not match are dropped (``if let``)."""

    pattern: str
    expression: str
    refutable: bool = False


@dataclass(frozen=True)
class Generator:
    pattern: str
    expression: str


@dataclass(frozen=True)
class Aggregate:
    binding: str
    operator: str
    arguments: tuple[str, ...]
    source: Atom


Item = Atom | Condition | Let | Generator | Aggregate


@dataclass(frozen=True)
class Rule:
    heads: tuple[Atom, ...]
    body: tuple[Item, ...]
    order: tuple[int, ...] | None = None

    @property
    def is_fact(self) -> bool:
        return not self.body

    def ordered(self) -> tuple[Item, ...]:
        return self.body if self.order is None else tuple(self.body[i] for i in self.order)

    def reads(self, negated: bool | None = None) -> set[str]:
        """Relations in the body: all, positive ones only, or negated ones only."""
        out = set()
        for item in self.body:
            if isinstance(item, Aggregate) and not negated:
                out.add(item.source.relation)
            elif isinstance(item, Atom) and (negated is None or item.negated == negated):
                out.add(item.relation)
        return out

    def one_head(self, head: Atom) -> Rule:
        return replace(self, heads=(head,))

    def direct_aggregate(self) -> Aggregate | None:
        """The aggregate of a rule that groups by its head: the only body item, with one
        argument, plain and distinct source variables, its binding in the last head column alone."""
        if len(self.heads) != 1 or len(self.body) != 1 or not isinstance(self.body[0], Aggregate):
            return None
        agg, head = self.body[0], self.heads[0]
        names = agg.source.names()
        plain = all(x == WILDCARD or is_variable(x) for x in agg.source.arguments) and len(names) == len(set(names))
        uses = [i for i, x in enumerate(head.arguments) if agg.binding in variables(x)]
        return agg if plain and len(agg.arguments) == 1 and uses == [len(head.arguments) - 1] else None


@dataclass(frozen=True)
class Relation:
    name: str
    columns: tuple[ColumnType, ...]


@dataclass
class Program:
    name: str = "Program"
    relations: list[Relation] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    outputs: tuple[str, ...] | None = None
    profile: bool = False
    enums: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    types: dict[str, ColumnType] = field(default_factory=dict)
