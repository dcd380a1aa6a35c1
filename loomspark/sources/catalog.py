"""The catalogue that queries are resolved against: tables, the object log, associations, evidence and projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError

#: The tables that a data folder may hold.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Contract:
    """What a surface promises: the columns that identify a row, and who is its authority."""

    identity: tuple[str, ...] = ()
    authority: str = "raw"


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    contracts: dict[str, Contract] = field(default_factory=dict)
    records: DataFrame | None = None
    edges: DataFrame | None = None
    #: A log of associations, like ``records``: object_type is the association's type, and props hold its ends.
    edge_records: DataFrame | None = None
    edge_types: set[str] | None = None
    evidence: DataFrame | None = None
    projections: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    hidden: DataFrame | None = None
    branches: dict[str, int] = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)
    #: Pairs of names, such as (object type, table), whose profiles may be joined.
    bridges: set[tuple[str, str]] = field(default_factory=set)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str) -> Catalog:
        out = cls(spark)
        for name in TABLES:
            out.tables[name] = lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet")
        return out

    def add(self, name: str, df: DataFrame, identity: tuple[str, ...] = (), authority: str = "raw") -> Catalog:
        self.tables[name], self.contracts[name] = (lambda: df), Contract(identity, authority)
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise QueryError("E_UNKNOWN_TABLE_SURFACE", name)
        return self.tables[name]()

    def projection(self, name: str) -> DataFrame:
        if name not in self.projections:
            raise QueryError("E_UNKNOWN_PROJECTION", name)
        return self.projections[name]()

    def register_views(self, names: list[str] | None = None) -> None:
        """Tables and projections (all, or those named) as temporary views of the session."""
        for kind, find in ((self.tables, self.table), (self.projections, self.projection)):
            for name in kind:
                if names is None or name in names:
                    find(name).createOrReplaceTempView(name)

    def describe(self) -> list[dict]:
        """The queryable roots with their columns, for discovery."""
        out = [{"root": f"table({n})", "columns": self.table(n).dtypes, "identity": list(self.contracts.get(n, Contract()).identity)} for n in sorted(self.tables)]
        return out + [{"root": f"projection({n})", "columns": self.projection(n).dtypes, "identity": []} for n in sorted(self.projections)]
