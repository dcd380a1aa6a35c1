"""Syntax tree of the query language. Every node is a value; equal texts and builder calls give equal trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Roots of a chain, and the names that count as aggregates and as window functions.
ROOTS = ("object", "association", "evidence", "projection", "table", "node", "edge", "path", "in", "out", "either")
AGGREGATES = ("count", "sum", "avg", "min", "max", "distinct_count", "exists")
WINDOW_ONLY = ("row_number", "rank", "dense_rank", "lag", "lead", "first_value", "last_value")
ONCE = ("select", "asOf", "branch", "history", "changes", "includeTombstones", "groupBy", "window")


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Literal:
    value: Any
    kind: str = "plain"


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Arg:
    value: Any
    label: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Arg, ...] = ()
    alias: str | None = None

    def plain(self) -> list:
        return [a.value for a in self.args if a.label is None]

    def named(self) -> dict[str, Any]:
        return {a.label: a.value for a in self.args if a.label is not None}


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Within:
    value: Any
    choices: tuple


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Query:
    root: Call
    methods: tuple[Call, ...] = ()
    directives: tuple[tuple[str, str], ...] = ()
    explain: str | None = field(default=None)


def walk(node):
    """The node and all below it."""
    yield node
    if isinstance(node, Call):
        below = [a.value for a in node.args]
    elif isinstance(node, Compare):
        below = [node.left, node.right]
    elif isinstance(node, Within):
        below = [node.value]
    elif isinstance(node, Both | Either):
        below = list(node.parts)
    elif isinstance(node, Not):
        below = [node.part]
    else:
        below = []
    for x in below:
        yield from walk(x)


def render(node) -> str:
    """Canonical text of a tree."""
    import json

    if isinstance(node, Query):
        head = "".join(f"# {k}: {v}\n" for k, v in node.directives)
        mode = f"EXPLAIN {node.explain} " if node.explain else ""
        return head + mode + ".".join([render(node.root), *map(render, node.methods)])
    if isinstance(node, Call):
        inside = ", ".join((f"{a.label}: " if a.label else "") + render(a.value) for a in node.args)
        return f"{node.name}({inside})" + (f" as {node.alias}" if node.alias else "")
    if isinstance(node, Path):
        return ".".join(p if p.isidentifier() else f"`{p}`" for p in node.parts)
    if isinstance(node, Literal):
        if node.kind == "uuid":
            return f'uuid"{node.value}"'
        if node.kind == "binary":
            return f'x"{node.value.hex()}"'
        return json.dumps(node.value, ensure_ascii=False) if not hasattr(node.value, "as_tuple") else str(node.value)
    if isinstance(node, Star):
        return "*"
    if isinstance(node, Compare):
        return f"{render(node.left)} {node.op} {render(node.right)}"
    if isinstance(node, Within):
        return f"{render(node.value)} in [{', '.join(map(render, node.choices))}]"
    if isinstance(node, Not):
        return f"!({render(node.part)})"
    return "(" + (" && " if isinstance(node, Both) else " || ").join(map(render, node.parts)) + ")"
