"""Scalar functions of the query language: name -> (least and most arguments, Column builder)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

UNICODE_SPACE = r"(?U)^\s+|\s+$"

#: Cast targets and their Spark types; text forms keep their text.
CAST_TYPES = {
    "bool": "boolean",
    "utf8": "string",
    "string": "string",
    "json": "string",
    "int64": "bigint",
    "uint64": "decimal(20,0)",
    "decimal128": "decimal(38,10)",
    "timestamp_micros": "timestamp_ntz",
    "uuid": "string",
    "binary": "binary",
}


def trim(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), UNICODE_SPACE, "")


def length(x: Column, kind: str) -> Column:
    return F.size(x).cast("long") if kind.startswith(("array", "map")) else F.char_length(x).cast("long")


def exists(x: Column, kind: str) -> Column:
    return (x.isNotNull() & (F.size(x) > 0)) if kind.startswith("array") else x.isNotNull()


def cast(x: Column, target: str, kind: str) -> Column:
    if target not in CAST_TYPES:
        raise QueryError("E_UNSUPPORTED_FUNCTION", f"cast to {target}")
    if target == "uint64":  # strict: a negative number is an error
        number = x.cast("decimal(20,0)")
        return F.when(number < 0, F.raise_error(F.lit("E_EXPRESSION: negative for uint64")).cast("decimal(20,0)")).otherwise(number)
    if target == "bool" and kind == "string":
        return F.when(x == "true", True).when(x == "false", False).when(x.isNotNull(), F.raise_error(F.lit("E_EXPRESSION: not a boolean")).cast("boolean"))
    return x.cast(CAST_TYPES[target])


#: One-argument and plain functions; those that need the type of an argument are dispatched in ``call``.
SIMPLE = {
    "identity": (1, lambda x: x),
    "trim": (1, trim),
    "lower": (1, F.lower),
    "lowercase": (1, F.lower),
    "upper": (1, F.upper),
    "uppercase": (1, F.upper),
    "startsWith": (2, lambda x, p: x.startswith(p)),
    "contains": (2, lambda x, p: x.contains(p)),
    "isNaN": (1, lambda x: F.isnan(x) & x.isNotNull()),
    "isFinite": (1, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))),
    "isNull": (1, lambda x: x.isNull()),
    "isNotNull": (1, lambda x: x.isNotNull()),
}
TYPED = {"length": length, "exists": exists}
NAMES = (*SIMPLE, *TYPED, "cast", "coalesce")


def call(name: str, columns: list[Column], kinds: list[str], literal: str | None = None) -> Column:
    """``literal``: the text of a second argument that must be a literal, for cast."""
    if name in SIMPLE:
        count, build = SIMPLE[name]
        if len(columns) != count:
            raise QueryError("E_UNSUPPORTED_FUNCTION", f"{name} takes {count} arguments")
        return build(*columns)
    if name in TYPED:
        return TYPED[name](columns[0], kinds[0])
    if name == "cast":
        return cast(columns[0], literal or "", kinds[0])
    if name == "coalesce":
        return F.coalesce(*promoted(columns, kinds))
    raise QueryError("E_UNSUPPORTED_FUNCTION", name)


def promoted(columns: list[Column], kinds: list[str]) -> list[Column]:
    """Columns of one type: decimal over float over integer; other kinds must agree."""
    known = [k for k in kinds if k not in ("void", "null")]
    number = lambda k: k.startswith(("decimal", "double", "float")) or k in ("bigint", "int", "smallint", "tinyint")
    if len(set(known)) <= 1:
        return columns
    if not all(map(number, known)):
        raise QueryError("E_EXPRESSION", f"incompatible types {sorted(set(known))}")
    if any(k.startswith("decimal") for k in known):
        target = "decimal(38,10)"
    elif any(k in ("double", "float") for k in known):
        target = "double"
    else:
        target = "bigint"
    return [c.cast(target) for c in columns]
