"""Registration of the queries of one area, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import TABLES, Catalog
from .chain import query


def tidy(df: DataFrame) -> DataFrame:
    """Decimals as doubles of four places, and integers as longs, for comparison with other engines."""
    columns = []
    for name, kind in df.dtypes:
        x = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            x = F.round(x.cast("double"), 4)
        elif kind in ("int", "smallint", "tinyint"):
            x = x.cast("long")
        columns.append(x.alias(name))
    return df.select(*columns)


class Area:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def chain(self, name: str, text: str, sql: str | None, catalog: Callable[[SparkSession, str], Catalog] = Catalog.of_folder) -> None:
        """A query in the query language."""
        self.queries[name] = lambda spark, folder: tidy(query(catalog(spark, folder), text))
        if sql:
            self.sql[name] = sql

    def frame(self, name: str, function: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
        """A query that calls operators."""
        self.queries[name] = lambda spark, folder: tidy(function(spark, folder))
        if sql:
            self.sql[name] = sql

    def statement(self, name: str, spark_sql: str, sql: str | None = None) -> None:
        """A query on the SQL surface, over the folder's tables as views."""

        def run(spark: SparkSession, folder: str) -> DataFrame:
            Catalog.of_folder(spark, folder).register_views([t for t in TABLES if re.search(rf"\b{t}\b", spark_sql)])
            return tidy(spark.sql(spark_sql))

        self.queries[name] = run
        self.sql[name] = sql or spark_sql


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
