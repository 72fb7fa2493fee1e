"""The syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    #: the expression as it was written
    text: str = field(default="", compare=False, kw_only=True)
    at: int = field(default=0, compare=False, kw_only=True)


@dataclass(frozen=True)
class Literal(Node):
    value: object
    kind: str  # int float str bool null dur


@dataclass(frozen=True)
class Ref(Node):
    """A field and the steps into it: keys are str, indices int."""

    name: str
    path: tuple = ()


@dataclass(frozen=True)
class Not(Node):
    of: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class If(Node):
    test: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple


# --- search


@dataclass(frozen=True)
class Keyword:
    text: str
    wildcard: bool


@dataclass(frozen=True)
class All:
    of: tuple


@dataclass(frozen=True)
class Any_:
    of: tuple


@dataclass(frozen=True)
class None_:
    of: object


# --- operators


@dataclass(frozen=True)
class Json:
    source: Node | None


@dataclass(frozen=True)
class Logfmt:
    source: Node | None


@dataclass(frozen=True)
class Parse:
    pattern: str
    regex: bool
    source: Node | None
    names: tuple
    nodrop: bool
    noconvert: bool
    at: int = 0


@dataclass(frozen=True)
class Split:
    source: Node | None
    separator: str
    to: Ref | None


@dataclass(frozen=True)
class Fields:
    keep: bool
    names: tuple


@dataclass(frozen=True)
class Where:
    test: Node | None
    at: int = 0


@dataclass(frozen=True)
class Limit:
    count: float
    at: int = 0


@dataclass(frozen=True)
class Total:
    of: Node
    name: str


@dataclass(frozen=True)
class Timeslice:
    of: Node
    step: int | None  # nanoseconds
    name: str
    at: int = 0


@dataclass(frozen=True)
class Let:
    expr: Node
    name: str


@dataclass(frozen=True)
class Agg:
    func: str
    arg: Node | None
    name: str
    share: float = 0.0


@dataclass(frozen=True)
class Aggregate:
    aggs: tuple
    keys: tuple


@dataclass(frozen=True)
class Sort:
    keys: tuple
    descending: bool


@dataclass(frozen=True)
class Alias:
    name: str
    at: int = 0


@dataclass(frozen=True)
class Query:
    search: object
    operators: tuple


def refs(node) -> set[str]:
    """Names of all fields that an expression or an operator reads."""
    if isinstance(node, Ref):
        return {node.name}
    if isinstance(node, (tuple, list)):
        return set().union(*map(refs, node))
    if hasattr(node, "__dataclass_fields__"):
        return set().union(*(refs(getattr(node, f)) for f in node.__dataclass_fields__ if f not in ("text", "at")))
    return set()
