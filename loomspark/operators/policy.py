"""Policies on rows and values: visibility, redaction, disclosure, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from .relational import fails


def redacted(df: DataFrame, columns: list[str], secret: Column, marker: str = "<redacted>", refuse: bool = False) -> DataFrame:
    """Values of ``columns`` in rows where ``secret`` holds give way to a marker (null for other types than text), or
    the query fails where they are refused."""
    if refuse:
        return df.where(fails(F.coalesce(secret, F.lit(True)), "E_AGGREGATE_DISCLOSURE_FORBIDDEN"))
    kinds = dict(df.dtypes)
    shown = F.coalesce(secret, F.lit(True))
    return df.withColumns({c: F.when(~shown, F.col(c)).otherwise(F.lit(marker) if kinds[c] == "string" else F.lit(None).cast(kinds[c])) for c in columns})


def disclosed(df: DataFrame, keys: list[str], aggregates: dict[str, Column], policy: str = "allow", least: int = 1) -> DataFrame:
    """Aggregates by key under a disclosure policy: allow, thresholded, redacted or reject."""
    if policy == "reject":
        raise QueryError("E_AGGREGATE_DISCLOSURE_FORBIDDEN", ", ".join(aggregates))
    hidden = {"allow": F.lit(False), "thresholded": F.count(F.lit(1)) < least, "redacted": F.lit(True)}
    if policy not in hidden:
        raise QueryError("E_AGGREGATE_DISCLOSURE_FORBIDDEN", policy)
    columns = [F.when(~hidden[policy], x).alias(name) for name, x in aggregates.items()]
    return df.groupBy(*keys).agg(*columns, hidden[policy].alias("suppressed"))


def row_budget(df: DataFrame, most: int) -> DataFrame:
    """``df``, after a check that it has at most ``most`` rows; no more than one above that are counted."""
    if df.limit(most + 1).count() > most:
        raise QueryError("E_RESOURCE_LIMIT", f"more than {most} rows")
    return df
