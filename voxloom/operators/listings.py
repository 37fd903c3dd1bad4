"""Listings of files: merging of manifests, plans, trees and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.diff import folders_of
from voxloom.operators.replay import instant_ns


def merge_manifests(local: DataFrame, remote: DataFrame, key: str = "rel_path", at: str = "synced_at") -> DataFrame:
    """One entry per path: the latest by at, of equal ones the remote; columns of both sides are those of local.

    Null paths are left out, a null time is earliest. A maximum combined before
    the shuffle, so hot paths are no burden.
    """
    columns = [c for c in local.columns if c != key]
    rows = local.select(key, *columns, F.lit(0).alias("_side")).unionByName(remote.select(key, *columns, F.lit(1).alias("_side")))
    order = F.struct(instant_ns(at).alias("t"), F.col("_side").alias("s"), *[F.col(c) for c in columns])
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_x"))
    return best.select(key, *[F.col(f"_x.{c}").alias(c) for c in columns])


def upsert(current: DataFrame, changes: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """current with the rows of changes put in by key; columns in keep stay as they are in rows that exist."""
    kept = set(keep or [])
    a, b = current.alias("a"), changes.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    new, old = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    return joined.select(*[F.when(new & ~(old & F.lit(c in kept)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in current.columns])


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def exists(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(key, found): of each of keys whether df has it."""
    have = df.select(key).distinct().withColumn("_found", F.lit(True))
    return keys.select(key).join(have, key, "left").select(key, F.coalesce("_found", F.lit(False)).alias("found"))


def update(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with the columns of changes, one row a key, set where the key is among them; nothing is added."""
    new = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    rows = current.join(new, key, "left")
    return rows.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c != key and c in changes.columns else F.col(c) for c in current.columns])


def insert_missing(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """current and those of rows whose keys it lacks, each key once."""
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(*current.columns))


def tree_totals(files: DataFrame, size: str) -> DataFrame:
    """(folder, files, bytes): files below each folder, the root as an empty text; counts are combined before the shuffle."""
    rows = files.where(F.col("rel_path").isNotNull()).select(F.explode(folders_of("rel_path")).alias("folder"), F.coalesce(size, F.lit(0)).alias("_n"))
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("_n").alias("bytes"))


def size_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(rel_path, status): local_only, remote_only, same or differing by size, an unknown remote size being differing; each path once a side."""
    j = local.select("rel_path", F.col("local_size").alias("a"), F.lit(1).alias("l")).join(remote.select("rel_path", F.col("remote_size").alias("b"), F.lit(1).alias("r")), "rel_path", "full")
    status = F.when(F.col("r").isNull(), F.lit("local_only")).when(F.col("l").isNull(), F.lit("remote_only")).when(F.col("a") == F.col("b"), F.lit("same")).otherwise(F.lit("differing"))
    return j.select("rel_path", status.alias("status"))


def tree_rollup(statuses: DataFrame) -> DataFrame:
    """(folder, attention, differing, local_only, remote_only): counts of statuses below each folder."""
    rows = statuses.select(F.explode(folders_of("rel_path")).alias("folder"), "status")
    return rows.groupBy("folder").agg(
        F.count_if(F.col("status") != "same").alias("attention"), *[F.count_if(F.col("status") == s).alias(s) for s in ("differing", "local_only", "remote_only")]
    )
