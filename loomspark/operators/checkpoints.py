"""Lineage cuts: tables written into the shared checkpoint folder that the session names.

A written table survives the loss of executors, has a known size for the planner, and carries no constraints of earlier
plans, which would grow with every round of a loop. The JVM deletes the tables when the session ends; ``drop`` deletes
one earlier, and ``scratch`` all that were made within it but those that are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError

ROWS_A_FILE, ROWS_KEYED = 100_000, 2_000_000
_SCOPES: list[list[DataFrame]] = []
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the folder that was given to setCheckpointDir. Only a local session, as
    in tests, gets a folder of its own; on a cluster a folder of one machine would lose the tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise QueryError("E_REF_INVALID", "set spark.checkpoint.dir to a folder that all machines share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return _LOCAL["folder"]


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as a table and read back: its plan, constraints and lineage start anew. Where a bound of its narrow
    ``rows`` is known, it is written by one task for each ``ROWS_A_FILE`` of them at most, so that the many small tables
    of a loop are few small files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{folder(spark)}/loomspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def keyed(table: DataFrame, column: str) -> DataFrame:
    """A table of ``cut`` written again, dealt by ``column`` and sorted by it: joins and aggregates by it then move only
    their other side, in every round of a loop. A small table, which costs nothing to move, stays as it is."""
    spark = table.sparkSession
    if table.count() < ROWS_KEYED:
        return table
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"loomspark_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    table.repartition(parts, column).write.format("parquet").option("path", path).bucketBy(parts, column).sortBy(column).saveAsTable(name)
    delete_at_end(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay for those that read them
    out._cut_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The JVM deletes ``path`` when the session ends."""
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)


def drop(*tables: DataFrame) -> None:
    """Delete the tables of ``cut`` that are read by ``tables``; nothing may read them any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            where, fs = _path(df.sparkSession, path)
            fs.delete(where, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes at its end every table that ``cut`` made within it, but those put into the list that it gives."""
    kept: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield kept
    finally:
        safe = {getattr(df, "_cut_path", None) for df in kept}
        made = _SCOPES.pop()
        drop(*[df for df in made if df._cut_path not in safe])
        if _SCOPES:
            _SCOPES[-1].extend(df for df in made if df._cut_path in safe)
