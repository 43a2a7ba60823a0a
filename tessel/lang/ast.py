"""Syntax tree of the filter language. Nodes are immutable and compare by content."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any, Iterator


@dataclass(frozen=True)
class Node:
    def __getstate__(self) -> dict:
        """Fields only: what an evaluator notes on a node stays in its process."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))


def _nodes(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _nodes(v)


@dataclass(frozen=True)
class Identity(Node):
    """."""


@dataclass(frozen=True)
class RecurseAll(Node):
    """.."""


@dataclass(frozen=True)
class Literal(Node):
    """null, booleans, numbers (always float) and plain strings."""

    value: Any

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Literal) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))


@dataclass(frozen=True)
class Template(Node):
    """A string with interpolations: parts are str or Node. fmt names the @format applied to interpolated values."""

    parts: tuple
    fmt: str | None = None


@dataclass(frozen=True)
class Format(Node):
    name: str


@dataclass(frozen=True)
class Index(Node):
    """target[key]; key is evaluated against the input of the whole term."""

    target: Node
    key: Node


@dataclass(frozen=True)
class Slice(Node):
    target: Node
    low: Node | None
    high: Node | None


@dataclass(frozen=True)
class Iterate(Node):
    target: Node


@dataclass(frozen=True)
class ArrayOf(Node):
    body: Node | None


@dataclass(frozen=True)
class ObjectOf(Node):
    """Entries are (key node, value node)."""

    entries: tuple


@dataclass(frozen=True)
class Negate(Node):
    body: Node


@dataclass(frozen=True)
class Pipe(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Comma(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Binary(Node):
    """Arithmetic and comparison."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Logic(Node):
    """and, or."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Alternative(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Assign(Node):
    op: str
    target: Node
    value: Node


@dataclass(frozen=True)
class If(Node):
    condition: Node
    then: Node
    otherwise: Node


@dataclass(frozen=True)
class Try(Node):
    body: Node
    handler: Node | None = None


@dataclass(frozen=True)
class Pattern(Node):
    """kind: var (name), array (items), object (entries of (key node, variable or None, pattern or None))."""

    kind: str
    name: str = ""
    items: tuple = ()


@dataclass(frozen=True)
class Bind(Node):
    source: Node
    patterns: tuple
    body: Node


@dataclass(frozen=True)
class Reduce(Node):
    source: Node
    pattern: Pattern
    init: Node
    update: Node


@dataclass(frozen=True)
class Foreach(Node):
    source: Node
    pattern: Pattern
    init: Node
    update: Node
    extract: Node


@dataclass(frozen=True)
class Define(Node):
    """def name(params): body; rest. A parameter that starts with $ is bound to each value of its argument."""

    name: str
    params: tuple
    body: Node
    rest: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Label(Node):
    name: str
    body: Node


@dataclass(frozen=True)
class Break(Node):
    name: str


@dataclass(frozen=True)
class Hole(Node):
    """A part of the program that isn't written yet."""
