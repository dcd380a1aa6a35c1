"""Projections for machine-learning corpora: chunks, samples, splits, packs, imports, audits and diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError

MILLION, SEGMENT = 1_000_000, 100_000


def key_number(key: Column) -> Column:
    """The first 8 bytes of the key's SHA-256, little-endian, as decimal(20,0)."""
    digest = F.sha2(key.cast("string"), 256)
    swapped = F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def sample_id(key: Column) -> Column:
    number = key_number(key)
    return F.greatest(number, F.lit(1).cast("decimal(20,0)"))


def split_of(key: Column) -> Column:
    """train, validation or test with 98, 1 and 1 per cent, from the key alone."""
    part = (key_number(key) % MILLION).cast("long")
    return F.when(part < 980_000, "train").when(part < 990_000, "validation").otherwise("test")


def chunks(docs: DataFrame, key: str, text: str, size: int, payload: bool = True) -> DataFrame:
    """(key, chunk, start, length, scalar_start, scalars, sha256[, payload]): consecutive spans of about ``size`` bytes of
    the text in UTF-8, with their offsets in bytes and in characters. A character that crosses a multiple of ``size``
    belongs to the span behind it, so a span is whole characters and at most 3 bytes longer."""
    many = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / size))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.encode(F.col(text), "UTF-8").alias("_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("chunk"))
    inside = lambda at: F.hex(F.substring("_bytes", at + 1, F.lit(1))).between("80", "BF")

    def edge(number):
        """Where the character begins that holds the byte at a multiple of ``size``."""
        at = (number * size).cast("int")
        moved = F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)
        return F.when(at >= F.octet_length("_bytes"), F.octet_length("_bytes")).when(at == 0, 0).otherwise(moved)

    rows = rows.withColumns({"start": edge(F.col("chunk")), "_end": edge(F.col("chunk") + 1)})
    span = F.decode(F.substring("_bytes", F.col("start") + 1, F.col("_end") - F.col("start")), "UTF-8")
    before = F.char_length(F.decode(F.substring("_bytes", F.lit(1), F.col("start")), "UTF-8"))
    out = rows.select(key, "chunk", F.col("start").cast("long").alias("start"), (F.col("_end") - F.col("start")).cast("long").alias("length"), before.cast("long").alias("scalar_start"), F.char_length(span).cast("long").alias("scalars"), F.sha2(span, 256).alias("sha256"), span.alias("payload"))
    return out if payload else out.drop("payload")


def context(chunked: DataFrame, allowed: bool = True) -> DataFrame:
    """Chunks as context rows; payloads are withheld unless they may be seen."""
    text = F.col("payload") if allowed else F.lit(None).cast("string")
    return chunked.drop("payload").withColumn("context", F.struct(text.alias("text"), F.lit(not allowed).alias("withheld")))


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, token_hash): white-space tokens of each text."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    return docs.select(key, F.size(words).cast("long").alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("token_hash"))


def token_spans(docs: DataFrame, key: str, text: str, block: int = 128) -> DataFrame:
    """(key, token, start, length, block): the white-space tokens of each text with their places in characters, and the
    block of ``block`` tokens that each is in."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"\s*\S+"), F.lit(0))
    rows = docs.select(F.col(key), F.posexplode(pieces).alias("token", "_piece"))
    end = F.sum(F.char_length("_piece")).over(Window.partitionBy(key).orderBy("token").rowsBetween(Window.unboundedPreceding, 0))
    length = F.char_length(F.regexp_replace("_piece", r"^\s+", ""))
    return rows.select(key, F.col("token").cast("long").alias("token"), (end - length).cast("long").alias("start"), length.cast("long").alias("length"), F.floor(F.col("token") / block).cast("long").alias("block"))


def packs(sized: DataFrame, key: str, size: str, limit: int, by: list[str]) -> DataFrame:
    """(by, key, size, segment, pack, offset): consecutive rows of each group of ``by`` filled into packs of at most
    ``limit``; a row that does not fit any more opens the next pack, and one that is larger has a pack of its own. Packs
    are filled within segments of ``SEGMENT`` rows, one task each, so that a large group is many tasks."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1
    rows = sized.select(*by, key, F.col(size).cast("long").alias(size), turn.alias("_turn")).withColumn("segment", F.floor(F.col("_turn") / SEGMENT).cast("long"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_turn")
        places, offsets, pack, used = [], [], 0, 0
        for x in part[size].fillna(0).astype("int64"):
            if used and used + x > limit:
                pack, used = pack + 1, 0
            places.append(pack)
            offsets.append(used)
            used += int(x)
        return part.assign(pack=places, offset=offsets).drop(columns="_turn")

    kinds = dict(rows.dtypes)
    return rows.groupBy(*by, "segment").applyInPandas(fill, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, key, size, "segment")), "pack long", "offset long"]))


def samples(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sample descriptors: id, split, dedup group by text digest, quality and weight in millionths."""
    joined = docs.join(labels, key, "left")
    quality = (F.coalesce(F.col("quality"), F.lit(1)) * MILLION).cast("long")
    return joined.select(key, sample_id(F.col(key)).alias("sample_id"), split_of(F.col(key)).alias("split"), F.sha2(F.col("text"), 256).alias("dedup_group"), quality.alias("quality_ppm"), F.lit(MILLION).cast("long").alias("weight_ppm"), "source")


def split_counts(described: DataFrame) -> DataFrame:
    return described.groupBy("split").agg(F.count("*").alias("samples"))


def contamination(described: DataFrame) -> DataFrame:
    """Dedup groups that span training and another split."""
    groups = described.groupBy("dedup_group").agg(F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") != "train").alias("in_other"), F.count("*").alias("samples"))
    return groups.where("in_train and in_other").select("dedup_group", "samples")


def replayable(plans: DataFrame) -> DataFrame:
    """Whether all epoch plans name their hash and generator."""
    return plans.agg(F.coalesce(F.bool_and(F.col("hash").isNotNull() & F.col("rng").isNotNull()), F.lit(True)).alias("replayable"))


def archive_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows."""
    columns = sorted(set(old.columns) - {key})
    digest = lambda df: F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    both = old.select(key, digest(old).alias("_old")).join(new.select(key, digest(new).alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def import_rows(rows: DataFrame, schema: str) -> DataFrame:
    """(input, target, schema) of instruction, pretrain, preference and rag rows."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if schema == "instruction":
        joined = F.when(text("input") == "", F.col("instruction")).otherwise(F.concat_ws("\n", "instruction", "input"))
        return rows.select(joined.alias("input"), F.col("output").alias("target"), F.lit(schema).alias("schema"))
    if schema == "pretrain":
        return rows.select(F.col("text").alias("input"), F.lit(None).cast("string").alias("target"), F.lit(schema).alias("schema"))
    if schema == "preference":
        return rows.select(F.col("prompt").alias("input"), F.to_json(F.struct("chosen", "rejected")).alias("target"), F.lit(schema).alias("schema"))
    if schema == "rag":
        return rows.select(F.to_json(F.struct("query", "context")).alias("input"), F.col("answer").alias("target"), F.lit(schema).alias("schema"))
    raise QueryError("E_AI_ARGUMENT_REQUIRED", schema)


ROLES = ("system", "user", "assistant", "tool")


def import_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, target, messages, valid) from (conv_id, turn, role, text): the target is the last assistant turn."""
    message = F.struct("turn", "role", "text")
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"), F.count("*").alias("n_turns"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("target"), F.bool_and(F.col("role").isin(*ROLES)).alias("roles_known"))
    last = F.element_at("m", -1)["role"] == "assistant"
    return listed.select("conv_id", "n_turns", "target", F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"), (F.col("roles_known") & last).alias("valid"))


def generator_audit(rows: DataFrame, **filters) -> DataFrame:
    for column, value in filters.items():
        rows = rows.where(F.col(column) == value)
    return rows


def verify(described: DataFrame) -> DataFrame:
    return described.agg(F.count("*").alias("samples"), F.count_distinct("sample_id").alias("ids"), F.count_if(F.col("split").isNull()).alias("without_split"), F.count_if(F.col("quality_ppm") < 0).alias("bad_quality"))


def sample_at(described: DataFrame, index: int) -> DataFrame:
    """The sample at a place in the order of the ids: a top-k of each task, whose size is the place."""
    return described.orderBy("sample_id").limit(index + 1).orderBy(F.col("sample_id").desc()).limit(1 if described.limit(index + 1).count() > index else 0)


def withheld(df: DataFrame, column: str, allowed: Column, marker: str = "<withheld>") -> DataFrame:
    return df.withColumn(column, F.when(allowed, F.col(column)).otherwise(F.lit(marker)))


def multimodal(elements: DataFrame) -> DataFrame:
    """(sequence_id, n_elements, kinds, shape) of elements (sequence_id, place, kind, asset)."""
    listed = F.sort_array(F.collect_list(F.struct("place", "kind", "asset")))
    out = elements.groupBy("sequence_id").agg(listed.alias("e"), F.count("*").alias("n_elements"))
    return out.select("sequence_id", "n_elements", F.array_join(F.transform("e", lambda x: x["kind"]), ",").alias("kinds"), F.transform("e", lambda x: x["asset"]).alias("assets"))


def iterate(described: DataFrame, split: str | None = None):
    """Samples as dicts, in the order of their ids, one partition in memory at a time."""
    rows = described if split is None else described.where(F.col("split") == split)
    for row in rows.orderBy("sample_id").toLocalIterator():
        yield row.asDict(recursive=True)


def mapped(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Import by a mapping of fields: target name -> column; missing columns become null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(target) for target, c in names.items()])


def export(rows: DataFrame, path: str, kind: str, split: str | None = None) -> None:
    """json, jsonl, hf-jsonl, parquet, arrow (one IPC file on the driver), or a webdataset of tar shards (as binary rows
    of a Parquet table)."""
    from ..sources.files import export_arrow, tar_shards, write

    rows = rows if split is None else rows.where(F.col("split") == split)
    if kind == "webdataset":
        write(tar_shards(rows, rows.columns[0], rows.columns[-1], 8), path, "parquet")
    elif kind == "arrow":
        export_arrow(rows, path)
    else:
        write(rows, path, {"hf-jsonl": "jsonl"}.get(kind, kind))
