"""Documents of a file store as columns and tables: labels, registries, manifests and states as JSON, and writers of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import shard

_LABEL = "struct<display_name: string, color: string, profile_id: string>"


def _json(x: str | Column) -> Column:
    """The text without a mark of byte order."""
    return F.regexp_replace(F.col(x) if isinstance(x, str) else x, "^﻿", "")


def labels_json(labels: DataFrame) -> DataFrame:
    """(session_id, json): a document a session, with its labels by speaker; labels: (session_id, labels_version, speaker_id, display_name, color, profile_id), one version a session."""
    entry = F.struct(F.col("speaker_id").cast("string").alias("k"), F.struct("display_name", "color", "profile_id").alias("v"))
    rows = labels.where("session_id is not null and speaker_id is not null").groupBy("session_id").agg(F.max("labels_version").alias("labels_version"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("labels"))
    return rows.select("session_id", F.to_json(F.struct("session_id", "labels_version", "labels")).alias("json"))


def labels_of(json: str | Column) -> Column:
    """The labels (session_id, labels_version, speaker_id, display_name, color, profile_id) of a document, as an array; entries whose key is no number are left out."""
    x = F.from_json(_json(json), f"session_id string, labels_version long, labels map<string, {_LABEL}>")
    number = lambda e: F.when(e["key"].rlike("^[0-9]{1,9}$"), e["key"].cast("long"))
    entries = F.filter(F.map_entries(x["labels"]), lambda e: number(e).isNotNull())
    return F.coalesce(
        F.transform(entries, lambda e: F.struct(x["session_id"].alias("session_id"), x["labels_version"].alias("labels_version"), number(e).alias("speaker_id"), e["value"]["display_name"].alias("display_name"), e["value"]["color"].alias("color"), e["value"]["profile_id"].alias("profile_id"))),
        F.array().cast("array<struct<session_id: string, labels_version: long, speaker_id: long, display_name: string, color: string, profile_id: string>>"),
    )


def registry_json(profiles: DataFrame) -> DataFrame:
    """(json): one document of all profiles' names by id, without their vectors; profiles: (profile_id, display_name)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("profile_id", "display_name"))))
    return profiles.select("profile_id", "display_name").where("profile_id is not null").agg(F.to_json(F.struct(F.lit(1).alias("version"), entries.alias("profiles"))).alias("json"))


def registry_of(json: str | Column) -> Column:
    """The entries (profile_id, display_name) of a registry, as a map; an empty one for a damaged document."""
    return F.coalesce(F.from_json(_json(json), "version int, profiles map<string, string>")["profiles"], F.create_map().cast("map<string, string>"))


def state_of(json: str | Column) -> Column:
    """The records (rel_path, last_synced_at, etag, size_bytes) of a state of synchronisation, as an array; empty for a damaged document."""
    x = F.from_json(_json(json), "version int, files map<string, struct<last_synced_at: long, etag: string, size: long>>")
    found = F.transform(F.map_entries(x["files"]), lambda e: F.struct(e["key"].alias("rel_path"), e["value"]["last_synced_at"].alias("last_synced_at"), e["value"]["etag"].alias("etag"), e["value"]["size"].alias("size_bytes")))
    return F.coalesce(found, F.array().cast("array<struct<rel_path: string, last_synced_at: long, etag: string, size_bytes: long>>"))


def write_documents(df: DataFrame, path: str, key: str, text: str, mode: str = "overwrite") -> None:
    """Write a JSON or other text of each key in folders by its first two characters, keys beside texts, so that a lookup reads one folder."""
    df.select(F.col(key).alias("key"), F.col(text).alias("text"), shard(key).alias("shard")).repartition("shard").write.partitionBy("shard").mode(mode).parquet(path)


def read_document(spark: SparkSession, path: str, key: str) -> str | None:
    """The text of one key of documents written by write_documents; None if there is none."""
    rows = spark.read.parquet(path).where((F.col("shard").cast("string") == key[:2]) & (F.col("key") == key)).select("text").head(1)
    return rows[0][0] if rows else None


def write_artifacts(parts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write files of projects: parts (project, name, text) as tables by project and name, blank texts left out; a part of a project is one row."""
    parts.where(F.coalesce(F.trim("text") != "", F.lit(False))).repartition("project").write.partitionBy("project").mode(mode).parquet(path)
