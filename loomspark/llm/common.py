"""Shared helpers of the training-data operators: table access, lineage cuts, Arrow maps, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.checkpoints import cut, drop, scratch

__all__ = ["append", "components", "cut", "drop", "packed", "released", "scratch", "slices", "table", "unpacked"]

#: Rows of an Arrow batch are also bounded in bytes, so that very long texts cannot fill a Python worker.
ARROW_BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the input folder; the path is only ever opened by Spark."""
    for key, most in (("maxBytesPerBatch", 2 * ARROW_BATCH_BYTES), ("maxRecordsPerBatch", 2048)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))  # batches are bounded in bytes, whatever the rows
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append(df: DataFrame, inputs: list[str], function: Callable, added: str, done: Callable | None = None) -> DataFrame:
    """``df`` with the columns of ``added`` (a DDL string) after its own; ``function`` maps the Arrow columns
    ``inputs`` of a batch to one Arrow array for each. A column of ``df`` with one of the new names gives way.
    ``done`` runs at the end of each task, and memory that is free then goes back to the system, as the worker that a
    task leaves behind waits for the next one beside others."""
    new = _parse_datatype_string(added)
    old = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new.names])
    kinds = to_arrow_schema(new)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch):
                made = function(*[part.column(n) for n in inputs])
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *kinds.names])
        if done is not None:
            done()
        released()

    return old.mapInArrow(batches, StructType([*old.schema.fields, *new.fields]))


def released() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def packed(docs: DataFrame, *needed) -> DataFrame:
    """The whole rows of ``docs`` as one struct ``_row``, beside the columns that an operator needs: whatever names the
    operator adds, no other column of the input is touched."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *needed)


def unpacked(df: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs`` again; ``text`` names the column that replaces the text, and n_chars follows it."""
    made = {}
    if text:
        made["text"] = F.col(text)
        if "n_chars" in docs.columns:
            made["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return df.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of a bounded number of bytes, whole rows each."""
    n = max(1, -(-batch.nbytes // ARROW_BATCH_BYTES))
    step = max(1, -(-batch.num_rows // n))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs: ``(node, label)``, label = smallest node.

    Each round takes the least label among the neighbours and then the label's own label (pointer jumping), so the
    number of rounds grows with the logarithm of the diameter. All steps are joins on one key with map-side
    combined minima: no adjacency list is ever gathered, and a node with very many neighbours is split by AQE."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a <> b").distinct())
    rows = both.count()
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), rows)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        last, labels = labels, cut(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old").select("node", "label", (F.col("label") != F.col("old")).alias("changed")), rows)
        drop(last)
        if labels.where("changed").isEmpty():
            drop(both)
            return labels.select("node", "label")
