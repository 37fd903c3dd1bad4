"""Folders of files, JSON documents and DAV listings as tables, and sharded writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import basename, href_path, is_audio_path, parse_size, shard


def list_files(spark: SparkSession, root: str, audio: bool = True) -> DataFrame:
    """(rel_path, size_bytes, modified_at) of the files below root, without temporary and hidden ones; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    out = files.select(F.expr("1").alias("_"), F.replace(rel, F.lit(base), F.lit("")).alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")).drop("_")
    name = basename("rel_path")
    out = out.where(~(name.endswith(".tmp") | name.endswith(".part") | name.startswith(".")))
    return out if audio else out.where(~F.array_contains(F.split("rel_path", "/"), "audio") & ~is_audio_path("rel_path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, etag, size_bytes, synced_at, origin, deleted_at) of JSON manifests {files: {path: entry}}.

    A mark of byte order is skipped; a damaged manifest counts as an empty one.
    """
    entry = "struct<etag: string, size: long, synced_at: long, origin: string, deleted_at: long>"
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    parsed = text.select(F.from_json("value", f"files map<string, {entry}>", {"mode": "PERMISSIVE"}).alias("m"))
    rows = parsed.where("m.files is not null").select(F.explode("m.files").alias("rel_path", "e"))
    return rows.select("rel_path", "e.etag", F.col("e.size").alias("size_bytes"), "e.synced_at", "e.origin", "e.deleted_at")


def write_sharded(df: DataFrame, path: str, key: str, mode: str = "overwrite", kind: str = "parquet") -> None:
    """Write df in folders by the first two characters of key, so that a lookup of a key reads one folder."""
    df.withColumn("shard", shard(key)).repartition("shard").write.partitionBy("shard").mode(mode).format(kind).save(path)


def read_sharded(spark: SparkSession, path: str, key: str, value: str, kind: str = "parquet") -> DataFrame:
    """The rows of one key of a table written by write_sharded."""
    return spark.read.format(kind).load(path).where((F.col("shard") == value[:2]) & (F.col(key) == value)).drop("shard")


_PLACE = "transcription array<struct<offsets: struct<`from`: long, `to`: long>, text: string, chunk_id: long>>, result struct<language: string>"


def recognised_segments(json: str | Column, offset_ms: str | Column = "0") -> Column:
    """The segments (pos, start_ms, end_ms, text, chunk_id) in a recogniser's JSON, moved by offset_ms; absent fields are 0, blank texts left out, an end is not before its start."""
    shift = F.expr(offset_ms) if isinstance(offset_ms, str) else offset_ms
    found = F.from_json(F.col(json) if isinstance(json, str) else json, _PLACE)["transcription"]

    def place(x: Column, i: Column) -> Column:
        start, end = F.coalesce(x["offsets"]["from"], F.lit(0)), F.coalesce(x["offsets"]["to"], F.lit(0))
        return F.struct(i.alias("pos"), (start + shift).alias("start_ms"), (F.greatest(end, start) + shift).alias("end_ms"), F.trim(x["text"]).alias("text"), x["chunk_id"].alias("chunk_id"))

    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<struct<offsets: struct<`from`: long, `to`: long>, text: string, chunk_id: long>>")), place), lambda x: x["text"] != "")


def dav_listing(df: DataFrame, xml: str, root: str = "") -> DataFrame:
    """A row (rel_path, is_dir, size_bytes, etag) per node in DAV multistatus texts, whatever their prefixes.

    Texts are cut into responses and parsed one by one; paths outside root, the
    root itself and damaged responses are left out. Folders have no size.
    """
    plain = F.regexp_replace(F.col(xml), r"<(/?)[A-Za-z0-9_]+:", "<$1")
    parts = F.regexp_extract_all(plain, F.lit(r"(?s)<response(?:\s[^>]*)?>.*?</response>"), F.lit(0))
    rows = df.select(F.explode(parts).alias("_r"))
    field = lambda name: unescaped(F.trim(F.regexp_extract("_r", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)))
    is_dir = F.col("_r").rlike(r"<collection(?:\s[^>]*)?/?>")
    out = rows.select(href_path(field("href"), root).alias("rel_path"), is_dir.alias("is_dir"), F.when(~is_dir, parse_size(field("getcontentlength"))).alias("size_bytes"), F.nullif(field("getetag"), F.lit("")).alias("etag"))
    return out.where(F.col("rel_path").isNotNull() & (F.col("rel_path") != ""))


def first_etag(xml: str | Column) -> Column:
    """The first getetag that isn't blank in a DAV text, whatever its prefix; null without one."""
    plain = F.regexp_replace(F.col(xml) if isinstance(xml, str) else xml, r"<(/?)[A-Za-z0-9_]+:", "<$1")
    found = F.filter(F.transform(F.regexp_extract_all(plain, F.lit(r"(?s)<getetag(?:\s[^>]*)?>(.*?)</getetag>"), F.lit(1)), lambda t: unescaped(F.trim(t))), lambda t: t != "")
    return F.get(found, F.lit(0))


def unescaped(x: Column) -> Column:
    """With the five entities of XML resolved."""
    for entity, sign in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return x


def even_segments(total: str, step: int) -> Column:
    """Segments (start_ms, end_ms) of step that cover [0, total), the last one cut off; none for a total of 0 or less."""
    t = F.col(total)
    return F.when(t > 0, F.transform(F.sequence(F.lit(0).cast("long"), t - 1, F.lit(step).cast("long")), lambda s: F.struct(s.alias("start_ms"), F.least(s + step, t).alias("end_ms")))).otherwise(F.array().cast("array<struct<start_ms: long, end_ms: long>>"))
