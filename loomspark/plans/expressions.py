"""Expressions of the query language to Spark columns, against a scope of named inputs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..errors import QueryError
from ..functions import scalar
from ..lang.tree import AGGREGATES, WINDOW_ONLY, Both, Call, Compare, Either, Literal, Not, Path, Star, Within

TIMESTAMP = re.compile(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|\+00:00)?)?")


@dataclass
class Scope:
    """A frame and how its columns are addressed: bare names, and names behind an alias."""

    df: DataFrame
    bare: dict[str, str] = field(default_factory=dict)
    qualified: dict[str, dict[str, str]] = field(default_factory=dict)
    window: WindowSpec | None = None
    frame: WindowSpec | None = None
    grouped: bool = False
    keyed: WindowSpec | None = None

    @classmethod
    def of(cls, df: DataFrame, *aliases: str | None) -> Scope:
        names = {c: c for c in df.columns}
        return cls(df, dict(names), {a: dict(names) for a in aliases if a})

    def column(self, path: Path) -> tuple[Column, str]:
        parts = path.parts
        if len(parts) > 1 and parts[0] in self.qualified:
            names, rest = self.qualified[parts[0]], parts[1:]
        else:
            names, rest = self.bare, parts
        if rest[0] not in names:
            raise QueryError("E_UNKNOWN_PATH", path.name)
        physical = names[rest[0]]
        kind = dict(self.df.dtypes)[physical]
        out = F.col(f"`{physical}`")
        for step in rest[1:]:
            out, kind = out[step], "string"
        return out, kind

    def with_right(self, joined: DataFrame, right: DataFrame, alias: str, name: str, added: dict[str, str]) -> Scope:
        """After a join: the left's names stay, and the right's are new where they are free."""
        bare = dict(self.bare)
        for column, physical in added.items():
            bare.setdefault(column, physical)
        qualified = dict(self.qualified)
        for q in {alias, name} - {None}:
            qualified.setdefault(q, added)
        return Scope(joined, bare, qualified)


def literal(node: Literal) -> tuple[Column, str]:
    v = node.value
    if v is None:
        return F.lit(None), "void"
    if isinstance(v, bool):
        return F.lit(v), "boolean"
    if isinstance(v, int):
        return (F.lit(v).cast("bigint"), "bigint") if -(1 << 63) <= v < 1 << 63 else (F.lit(Decimal(v)).cast("decimal(20,0)"), "decimal(20,0)")
    if isinstance(v, Decimal):
        return F.lit(v), "decimal(38,10)"
    if isinstance(v, bytes):
        return F.lit(bytearray(v)), "binary"
    return F.lit(v), "string"


def value(node, scope: Scope) -> tuple[Column, str]:
    """(column, type) of an expression."""
    if isinstance(node, Literal):
        return literal(node)
    if isinstance(node, Path):
        return scope.column(node)
    if isinstance(node, Call):
        return call(node, scope)
    return predicate(node, scope), "boolean"


def call(node: Call, scope: Scope) -> tuple[Column, str]:
    name, args = node.name, node.plain()
    if name == "if":
        if len(args) != 3:
            raise QueryError("E_UNSUPPORTED_FUNCTION", "if takes 3 arguments")
        (a, ka), (b, kb) = value(args[1], scope), value(args[2], scope)
        a, b = scalar.promoted([a, b], [ka, kb])
        return F.when(predicate(args[0], scope), a).otherwise(b), ka if kb == "void" else kb
    if name in WINDOW_ONLY or name in AGGREGATES and scope.window is not None and not scope.grouped:
        return windowed(node, scope)
    if name in AGGREGATES and not (name == "exists" and args and not isinstance(args[0], Star) and not scope.grouped):
        return aggregate(node, scope)
    if name in scalar.NAMES:
        target = None
        if name == "cast":
            target = args[1].value if isinstance(args[1], Literal) else args[1].name
            args = args[:1]
        built = [value(a, scope) for a in args]
        out = scalar.call(name, [c for c, _ in built], [k for _, k in built], target)
        kind = scope.df.select(out.alias("x")).dtypes[0][1]
        return out, kind
    raise QueryError("E_UNSUPPORTED_FUNCTION", name)


def aggregate(node: Call, scope: Scope) -> tuple[Column, str]:
    """sum of integers stays exact and avg of exact numbers is a decimal division; empty gives null."""
    name, args = node.name, node.plain()
    if name == "count":
        if not args or isinstance(args[0], Star):
            return F.count(F.lit(1)), "bigint"
        return F.count(value(args[0], scope)[0]), "bigint"
    if name == "exists" and (not args or isinstance(args[0], Star)):
        return F.count(F.lit(1)) > 0, "boolean"
    x, kind = value(args[0], scope)
    if name == "exists":
        return F.count(x) > 0, "boolean"
    if name == "distinct_count":
        return F.count_distinct(x), "bigint"
    exact = kind in ("tinyint", "smallint", "int", "bigint")
    if name == "sum":
        return F.sum(x), "bigint" if exact else kind
    if name == "avg":
        return F.avg(x.cast("decimal(38,6)") if exact else x), "double"
    return (F.min(x) if name == "min" else F.max(x)), kind


def windowed(node: Call, scope: Scope) -> tuple[Column, str]:
    if scope.window is None:
        raise QueryError("E_WINDOW", f"{node.name} without window()")
    name, args = node.name, node.plain()
    if name == "row_number":
        return F.row_number().over(scope.window).cast("bigint"), "bigint"
    if name in ("rank", "dense_rank"):
        return getattr(F, name)().over(scope.keyed).cast("bigint"), "bigint"
    if name == "count" and (not args or isinstance(args[0], Star)):
        return F.count(F.lit(1)).over(scope.frame), "bigint"
    x, kind = value(args[0], scope)
    if name in ("lag", "lead"):
        n = args[1].value if len(args) > 1 else 1
        if not isinstance(n, int) or n < 0:
            raise QueryError("E_WINDOW", "the offset must be a literal of at least 0")
        return getattr(F, name)(x, n).over(scope.window), kind
    if name in ("first_value", "last_value"):
        return (F.first(x) if name == "first_value" else F.last(x)).over(scope.frame), kind
    if name not in ("count", "sum", "avg", "min", "max"):
        raise QueryError("E_WINDOW", name)
    return aggregate(node, Scope(scope.df, scope.bare, scope.qualified))[0].over(scope.frame), kind


def predicate(node, scope: Scope) -> Column:
    """Three-valued: null operands make unknown."""
    if isinstance(node, Both | Either):
        parts = [predicate(p, scope) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node, Both) else out | p
        return out
    if isinstance(node, Not):
        return ~predicate(node.part, scope)
    if isinstance(node, Within):
        x, kind = value(node.value, scope)
        known = [typed(c, kind) for c in node.choices if c.value is not None]
        hit = x.isin(*known) if known else F.lit(False)
        # with a null in the list what is not found is unknown
        out = F.when(hit, True).otherwise(F.lit(None).cast("boolean")) if len(known) < len(node.choices) else hit
        return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(out)
    if isinstance(node, Compare):
        (a, ka), (b, kb) = value(node.left, scope), value(node.right, scope)
        if isinstance(node.right, Literal):
            b = typed(node.right, ka)
        elif isinstance(node.left, Literal):
            a = typed(node.left, kb)
        if isinstance(node.right, Literal) and kb == "string" and ka not in ("string", "binary", "void") and not ka.startswith(("timestamp", "date")):
            return F.when(a.isNotNull(), F.lit(False if node.op == "==" else True if node.op == "!=" else None).cast("boolean"))
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.op]
    out, kind = value(node, scope)
    if kind not in ("boolean", "void"):
        raise QueryError("E_EXPRESSION", f"a predicate of type {kind}")
    return out


def typed(node: Literal, kind: str) -> Column:
    """A literal for comparison with a column: texts become times beside times, and dates may end with Z."""
    if isinstance(node.value, str) and kind.startswith(("timestamp", "date")) and TIMESTAMP.fullmatch(node.value):
        plain = node.value.replace("Z", "").replace("+00:00", "").replace("T", " ")
        return F.lit(plain).cast("timestamp_ntz" if kind == "timestamp_ntz" else kind)
    return literal(node)[0]


def window_of(node: Call, scope: Scope) -> Scope:
    """The scope with the query's one window: a single ascending key, nulls last, ties by the whole row."""
    named = [(a.label, a.value) for a in node.args]
    by = [value(v, scope)[0] for k, v in named if k == "partitionBy"]
    keys = [value(v, scope)[0] for k, v in named if k == "orderBy"]
    if len(keys) > 1:
        raise QueryError("E_WINDOW", "one orderBy")
    options = {k: v.name for k, v in named if k in ("frame", "start", "end")}
    if options.get("frame", "rows") not in ("rows", "range"):
        raise QueryError("E_WINDOW", options["frame"])
    bounds = {"unbounded_preceding": Window.unboundedPreceding, "current_row": 0, "unbounded_following": Window.unboundedFollowing}
    start, end = options.get("start", "unbounded_preceding"), options.get("end", "current_row")
    if start not in ("unbounded_preceding", "current_row") or end not in ("current_row", "unbounded_following"):
        raise QueryError("E_WINDOW", f"{start} to {end}")
    ties = [F.col(f"`{c}`").asc_nulls_last() for c, k in scope.df.dtypes if not k.startswith("map")]
    base = Window.partitionBy(*by)
    out = Scope(scope.df, scope.bare, scope.qualified)
    out.window = base.orderBy(*[k.asc_nulls_last() for k in keys], *ties)
    out.frame = out.window.rowsBetween(bounds[start], bounds[end])
    # ranks see the key alone; without one every row is distinct
    out.keyed = base.orderBy(*[k.asc_nulls_last() for k in keys]) if keys else out.window
    return out
