"""Queries over file listings and manifests, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import basename, decode_path, depth, encode_path, glob_match, human_size, is_audio_path, parent, selected, shard
from voxloom.operators.diff import plain_digest
from voxloom.operators.listings import merge_manifests, size_diff, tree_rollup, tree_totals
from voxloom.operators.replay import replay
from voxloom.sources import table

ENTRY = ["rel_path", "etag", "size_bytes", "synced_at", "origin", "deleted_at"]


def _files(spark: SparkSession, d: str, side: str) -> DataFrame:
    rows = table(spark, d, f"{side}_files").groupBy("rel_path").agg(F.max_by(F.struct("is_dir", f"{side}_size"), F.struct("listed_at", f"{side}_size")).alias("x"))
    return rows.where("not x.is_dir").select("rel_path", f"x.{side}_size")


def w12_merge_manifests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest_feed").select(*ENTRY)
    own = F.coalesce(F.col("origin") == "dev-atrium", F.lit(False))
    return merge_manifests(rows.where(own), rows.where(~own))


def mf_live_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = w12_merge_manifests(spark, d)
    return rows.groupBy("origin").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("tombstones"))


def u1_all_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select("rel_path").union(table(spark, d, "remote_files").select("rel_path"))
    return rows.union(table(spark, d, "manifest_feed").select("rel_path")).where("rel_path is not null").distinct()


def u5_local_without_remote(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "local_files").select("rel_path").exceptAll(table(spark, d, "remote_files").select("rel_path")).distinct()


def j7_size_diff(spark: SparkSession, d: str) -> DataFrame:
    return size_diff(_files(spark, d, "local"), _files(spark, d, "remote"))


def a13_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tree_rollup(j7_size_diff(spark, d))


def a14_totals(spark: SparkSession, d: str) -> DataFrame:
    return tree_totals(_files(spark, d, "local"), "local_size")


def f13_path_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select("rel_path").distinct()
    return rows.select("rel_path", basename("rel_path").alias("name"), parent("rel_path").alias("folder"), depth("rel_path").alias("depth"), shard(basename("rel_path")).alias("shard"), is_audio_path("rel_path").alias("audio"))


def f8_path_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select("rel_path").distinct()
    return rows.select("rel_path", encode_path("rel_path").alias("encoded"), decode_path(encode_path("rel_path")).alias("decoded"))


def sel_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select("rel_path").distinct()
    chosen = selected("rel_path", ["projects/*", "audio/2026-0?-*"], ["*standup*"], ["projects/2026-01-16 plan #2"], False)
    return rows.select("rel_path", chosen.alias("chosen"), glob_match("rel_path", "*notes*").alias("notes"))


def f60_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "local_files").select("local_size").where("local_size is not null").distinct().select("local_size", human_size("local_size").alias("size"))


def j12_shared_content(spark: SparkSession, d: str) -> DataFrame:
    """Local files whose content is also at another path, here or remotely."""
    own = table(spark, d, "local_files").where("content_hash is not null and not is_dir").select("rel_path", plain_digest("content_hash").alias("content_hash"), F.lit(1).alias("here"))
    other = table(spark, d, "remote_files").where("content_hash is not null and not is_dir").select("rel_path", plain_digest("content_hash").alias("content_hash"), F.lit(0).alias("here"))
    rows = own.unionByName(other).groupBy("content_hash", "rel_path").agg(F.max("here").alias("here"))
    shared = rows.groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.where("here = 1").join(shared, "content_hash").select("rel_path", "content_hash", "copies")


_NAMES = "w12_merge_manifests mf_live_entries u1_all_paths u5_local_without_remote j7_size_diff a13_rollup a14_totals f13_path_parts f8_path_codec sel_selection f60_sizes j12_shared_content"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_NS = "case when abs({c}) < 100000000000 then {c}::hugeint * 1000000000 when abs({c}) < 100000000000000 then {c}::hugeint * 1000000 else {c}::hugeint * 1000 end"
_MERGED = f"""m as (select {", ".join(ENTRY)} from (select *, row_number() over (partition by rel_path order by {_NS.format(c="synced_at")} desc nulls last,
  (origin is null or origin <> 'dev-atrium') desc, etag desc nulls last, size_bytes desc nulls last, synced_at desc, origin desc nulls last, deleted_at desc nulls last) as k from manifest_feed where rel_path is not null) where k = 1)"""
_LATEST = """lf as (select rel_path, local_size from (select *, row_number() over (partition by rel_path order by listed_at desc, local_size desc nulls last) as k from local_files) where k = 1 and not is_dir)"""
_BOTH = _LATEST + """, rf as (select rel_path, remote_size from (select *, row_number() over (partition by rel_path order by listed_at desc, remote_size desc nulls last) as k from remote_files) where k = 1 and not is_dir),
s as (select coalesce(lf.rel_path, rf.rel_path) as rel_path, case when rf.rel_path is null then 'local_only' when lf.rel_path is null then 'remote_only' when local_size = remote_size then 'same' else 'differing' end as status
  from lf full join rf on lf.rel_path = rf.rel_path)"""
_FOLDERS = "unnest(list_transform(range(0, len(string_split(rel_path, '/'))), lambda n: array_to_string(string_split(rel_path, '/')[1:n], '/')))"
_PARENT = "regexp_replace(rel_path, '/?[^/]*$', '')"
_AUDIO = r"regexp_matches(lower(rel_path), '[^/]\.(wav|mp3|m4a|aac|flac|ogg|opus|wma)$')"

ORACLE = {
    "w12_merge_manifests": f"with {_MERGED} select * from m",
    "mf_live_entries": f"with {_MERGED} select origin, count(*) filter (deleted_at is null) as live, count(*) filter (deleted_at is not null) as tombstones from m group by 1",
    "u1_all_paths": "select rel_path from local_files where rel_path is not null union select rel_path from remote_files where rel_path is not null union select rel_path from manifest_feed where rel_path is not null",
    "u5_local_without_remote": "select distinct rel_path from (select rel_path from local_files except all select rel_path from remote_files)",
    "j7_size_diff": f"with {_BOTH} select * from s",
    "a13_rollup": f"with {_BOTH} select folder, count(*) filter (status <> 'same') as attention, count(*) filter (status = 'differing') as differing, count(*) filter (status = 'local_only') as local_only, count(*) filter (status = 'remote_only') as remote_only from (select {_FOLDERS} as folder, status from s) group by 1",
    "a14_totals": f"with {_LATEST} select folder, count(*) as files, sum(n)::bigint as bytes from (select {_FOLDERS} as folder, coalesce(local_size, 0) as n from lf) group by 1",
    "f13_path_parts": f"select distinct rel_path, string_split(rel_path, '/')[-1] as name, {_PARENT} as folder, len(string_split(rel_path, '/')) as depth, left(string_split(rel_path, '/')[-1], 2) as shard, {_AUDIO} as audio from local_files",
    "f8_path_codec": "select distinct rel_path, replace(url_encode(rel_path), '%2F', '/') as encoded, rel_path as decoded from local_files",
    "sel_selection": f"select distinct rel_path, not (rel_path = 'projects/2026-01-16 plan #2' or starts_with(rel_path, 'projects/2026-01-16 plan #2/')) and not contains(rel_path, 'standup') and not {_AUDIO} and (starts_with(rel_path, 'projects/') or regexp_matches(rel_path, '^audio/2026-0.-')) as chosen, contains(rel_path, 'notes') as notes from local_files",
    "f60_sizes": "select distinct local_size, case when local_size < 1024 then local_size || ' B' when local_size < 1048576 then printf('%.1f KB', local_size / 1024.0) when local_size < 1073741824 then printf('%.1f MB', local_size / 1048576.0) else printf('%.1f GB', local_size / 1073741824.0) end as size from local_files where local_size is not null",
    "j12_shared_content": """with x as (select rel_path, lower(trim(content_hash)) as content_hash, 1 as here from local_files where content_hash is not null and not is_dir
  union all select rel_path, lower(regexp_replace(trim(content_hash), '^W/|"', '', 'g')), 0 from remote_files where content_hash is not null and not is_dir),
y as (select rel_path, content_hash, max(here) as here, count(*) over (partition by content_hash) as copies from x group by rel_path, content_hash)
select rel_path, content_hash, copies from y where here = 1 and copies > 1""",
}
