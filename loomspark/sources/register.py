"""Tables, datasets, projections and overlays as views of a SQL session; manifests; and forms of results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from .catalog import Catalog
from .files import detect_format, overlay, read, read_dataset


def register_file(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    df = read(spark, path, detect_format(path), **options)
    df.createOrReplaceTempView(name)
    return df


def register_dataset(spark: SparkSession, name: str, paths: list[str], trusted: bool = True, digests: dict[str, str] | None = None) -> DataFrame:
    """Files of a manifest as one view; an untrusted manifest must carry the SHA-256 of every file, and it must be right."""
    if not trusted:
        if any(p not in (digests or {}) for p in paths):
            raise QueryError("E_REF_INVALID", "a file without a digest")
        wrong = [p for p in paths if file_digest(spark, p) != digests[p]]
        if wrong:
            raise QueryError("E_REF_INVALID", f"{wrong[0]} has another digest")
    df = read_dataset(spark, paths)
    df.createOrReplaceTempView(name)
    return df


def file_digest(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file; of a folder, that of its data files' digests in the order of their names. Files are read by
    the executors, and only digests come back."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest")).orderBy("path").collect()
    if not files:
        raise QueryError("E_REF_INVALID", f"no file at {path}")
    if len(files) == 1:
        return files[0]["digest"]
    return hashlib.sha256("".join(f["digest"] for f in files).encode()).hexdigest()


def register_projections(catalog: Catalog) -> list[str]:
    for name in catalog.projections:
        catalog.projection(name).createOrReplaceTempView(name)
    return sorted(catalog.projections)


def register_overlay(spark: SparkSession, name: str, df: DataFrame, hidden: DataFrame | None, key: str) -> DataFrame:
    out = overlay(df, hidden, key)
    out.createOrReplaceTempView(name)
    return out


def mount(catalog: Catalog, name: str, path: str, **options) -> Catalog:
    """An external CSV, JSON or JSONL file as a table, with types inferred from all rows."""
    return catalog.add(name, read(catalog.spark, path, **options), authority="external")


def publish(spark: SparkSession, path: str, entries: list[dict]) -> str:
    """Write a manifest beside its place and rename it over the old one in one step, so that readers see the old one or
    the new one at any time; its digest."""
    text = json.dumps({"entries": entries}, sort_keys=True)
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options
    overwrite = spark.sparkContext._gateway.new_array(options.Rename, 1)
    overwrite[0] = getattr(options, "Rename").OVERWRITE
    to, aside = fs.makeQualified(to), fs.makeQualified(aside)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, to, overwrite)
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> list[dict]:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))["entries"]


def result(df: DataFrame, mode: str = "rows"):
    """A result as rows, arrow, json, or an iterator of rows that holds one partition at a time."""
    if mode == "rows":
        return df
    if mode == "arrow":
        return df.toArrow()
    if mode == "json":
        return df.toJSON()
    if mode == "iterator":
        return stream(df)
    raise QueryError("E_PARSE", f"mode {mode}")


def stream(df: DataFrame) -> Iterator[dict]:
    for row in df.toLocalIterator(prefetchPartitions=False):
        yield row.asDict(recursive=True)


def blocking_reason(methods: list[str]) -> str | None:
    """Why a chain cannot give rows before it has read everything."""
    return next((m for m in methods if m in ("groupBy", "orderBy", "skip", "window", "intersect", "except")), None)
