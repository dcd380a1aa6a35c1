"""File sources and sinks: detection by extension, mounts, conversion reports, and exports."""

from __future__ import annotations

import io
import json
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError

#: Extension -> format.
FORMATS = {"parquet": "parquet", "arrow": "arrow", "ipc": "arrow", "feather": "arrow", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl"}


def detect_format(path: str) -> str:
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension not in FORMATS:
        raise QueryError("E_PARSE", f"no format for {path}")
    return FORMATS[extension]


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    kind = kind or detect_format(path)
    if kind == "csv":
        return spark.read.csv(path, **({"header": True, "inferSchema": True} | options))
    if kind == "json":
        return spark.read.json(path, multiLine=True, **options)
    if kind == "jsonl":
        return spark.read.json(path, **options)
    if kind == "orc":
        return spark.read.orc(path, **options)
    if kind == "arrow":  # each file is read by one task, as record batches
        return read_arrow(spark, path)
    return spark.read.parquet(path, **options)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, each read by one task; a task also finds the schema, so no file's content reaches the driver."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)

    def opened(data: bytes):
        try:
            return pa.ipc.open_file(io.BytesIO(data))
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(io.BytesIO(data))

    def schemas(it):
        for part in it:
            for content in part.column("content"):
                yield pa.RecordBatch.from_arrays([pa.array([opened(content.as_py()).schema.serialize().to_pybytes()])], names=["schema"])

    first = files.select("content").mapInArrow(schemas, "schema binary").first()
    if first is None:
        raise QueryError("E_PARSE", f"no file at {path}")
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(first["schema"])))

    def batches(it):
        for part in it:
            for content in part.column("content"):
                yield from opened(content.as_py()).read_all().to_batches()

    return files.select("content").mapInArrow(batches, from_arrow_schema(schema))


def read_dataset(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several Parquet files as one dataset, each row with the ordinal of its file."""
    out = None
    for ordinal, path in enumerate(paths):
        part = spark.read.parquet(path).withColumn("file_ordinal", F.lit(ordinal).cast("long"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write(df: DataFrame, path: str, kind: str | None = None, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    kind = kind or detect_format(path)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "csv":
        writer.csv(path, header=True)
    elif kind == "orc":
        writer.orc(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise QueryError("E_PARSE", f"no sink for {kind}; export_arrow writes a file of record batches")


#: What the targets of a conversion cannot hold, by the start of a type's name.
LOSSY = {
    "archive": {"timestamp": "the time zone is dropped", "void": "a column without a type", "interval": "no intervals", "map": "kept as pairs", "variant": "kept as JSON text", "char": "the length is dropped", "varchar": "the length is dropped"},
    "csv": {"array": "no nested values", "map": "no nested values", "struct": "no nested values", "binary": "bytes become text", "timestamp": "the time zone is dropped", "void": "a column without a type", "string": "null and empty text are alike"},
    "json": {"binary": "bytes become text in base 64", "decimal": "read back as a double", "timestamp": "read back as text", "date": "read back as text", "void": "left out", "tinyint": "read back as bigint", "smallint": "read back as bigint", "int": "read back as bigint", "float": "read back as a double"},
    "arrow": {"void": "a column without a type", "interval": "months and days are apart"},
}
LOSSY["jsonl"] = LOSSY["json"]
LOSSY["parquet"] = {k: LOSSY["archive"][k] for k in ("void", "char", "varchar")}
LOSSY["orc"] = {"void": "a column without a type", "interval": "no intervals", "variant": "no variants"}


def conversion_report(df: DataFrame, kind: str = "archive") -> list[dict]:
    """What a conversion to the archive's types or to another format loses, by column."""
    if kind not in LOSSY:
        raise QueryError("E_PARSE", f"no format {kind}")
    out = []
    for name, type_name in df.dtypes:
        note = next((note for start, note in LOSSY[kind].items() if type_name.startswith(start) and type_name != "timestamp_ntz"), None)
        out.append({"column": name, "type": type_name, "lossy": note is not None, "note": note or ""})
    return out


def export_arrow(df: DataFrame, path: str) -> dict:
    """A result as one Arrow IPC file on the driver, and a report of it. Executors make the record batches, and the driver
    holds those of one partition at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    def packed(it):
        for batch in it:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    rows, schema = 0, to_arrow_schema(df.schema)
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, schema) as writer:
        for row in df.mapInArrow(packed, "content binary").toLocalIterator():
            for batch in pa.ipc.open_stream(bytes(row["content"])):
                writer.write_table(pa.Table.from_batches([batch]).cast(schema))
                rows += batch.num_rows
    return {"path": path, "rows": rows, "columns": conversion_report(df, "arrow")}


def rendered(df: DataFrame, kind: str = "table", most: int = 1000) -> str:
    """Up to ``most`` rows as text: table, json, jsonl or csv."""
    rows = [r.asDict(recursive=True) for r in df.limit(most).collect()]
    if kind == "json":
        return json.dumps(rows, default=str)
    if kind == "jsonl":
        return "\n".join(json.dumps(r, default=str) for r in rows)
    if kind == "csv":
        import csv

        out = io.StringIO()
        writer = csv.DictWriter(out, df.columns)
        writer.writeheader()
        writer.writerows(rows)
        return out.getvalue()
    widths = {c: max([len(c), *(len(str(r[c])) for r in rows)]) for c in df.columns}
    line = lambda r: " | ".join(str(r[c]).ljust(widths[c]) for c in df.columns)
    return "\n".join([line({c: c for c in df.columns}), *map(line, rows)])


def tar_shards(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """WebDataset shards: ``(shard, content)`` rows, each content a tar of bounded size with one member for a row."""

    def pack(it):
        import pyarrow as pa

        for batch in it:
            data = io.BytesIO()
            with tarfile.open(fileobj=data, mode="w") as tar:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    body = (t or "").encode()
                    info = tarfile.TarInfo(f"{k}.txt")
                    info.size = len(body)
                    tar.addfile(info, io.BytesIO(body))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([data.getvalue()], pa.binary())], names=["members", "content"])

    dealt = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).repartition(shards, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(pack, "members long, content binary")


def overlay(df: DataFrame, hidden: DataFrame | None, key: str) -> DataFrame:
    """Rows that the overlay does not hide; without overlay data nothing is visible."""
    if hidden is None:
        raise QueryError("E_VISIBILITY_OVERLAY_UNAVAILABLE", key)
    return df.join(hidden.select(key).distinct(), key, "left_anti")
