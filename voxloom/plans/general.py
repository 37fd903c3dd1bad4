"""Queries p3, p4 and p6 over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.diff import listing_diff, only_per_folder, presence
from voxloom.operators.periods import periods_and_gaps
from voxloom.operators.replay import replay
from voxloom.sources import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return listing_diff(table(spark, d, "local_files"), table(spark, d, "remote_files"))


def p3_remote_only_by_folder(spark: SparkSession, d: str) -> DataFrame:
    side = presence(table(spark, d, "local_files"), table(spark, d, "remote_files"))
    return only_per_folder(side.select(F.col("path").alias("rel_path"), F.col("side").alias("diff")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "manifest_feed")).select("rel_path", "change_id")


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "manifest_feed")).select("rel_path", "change_id", "etag", "size_bytes", "synced_at", "origin", "after_gap")


def p4_by_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Changes that one device made at one time, as one transaction."""
    made = F.when(F.col("synced_at").isNotNull(), F.concat_ws("@", F.coalesce("origin", F.lit("")), F.col("synced_at").cast("string")))
    feed = table(spark, d, "manifest_feed").select("rel_path", "change_id", "etag", "synced_at", "origin", "deleted_at", made.alias("made"))
    return replay(feed, transaction="made").select("rel_path", "change_id", "etag", "origin")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    spoken = table(spark, d, "speaker_intervals").select("session_id", "speaker_id", "start_ms", "end_ms")
    chunks = table(spark, d, "audio_chunks").select("session_id", F.lit(-1).cast("long").alias("speaker_id"), "start_ms", "end_ms")
    return periods_and_gaps(spoken.unionByName(chunks), ["session_id", "speaker_id"])


QUERIES = {f.__name__: f for f in (p3_found, p3_remote_only_by_folder, p4_found, p4_state, p4_by_transactions, p6_found)}

_NS = "case when abs({c}) < 100000000000 then {c}::hugeint * 1000000000 when abs({c}) < 100000000000000 then {c}::hugeint * 1000000 when abs({c}) < 100000000000000000 then {c}::hugeint * 1000 else {c}::hugeint end"
_LAST = f"""
select *, row_number() over (partition by rel_path order by {_NS.format(c="synced_at")} desc nulls last, change_id desc) as rn
from manifest_feed where rel_path is not null and change_id is not null"""

_DIFF = r"""
with l0 as (
  select trim(regexp_replace(regexp_replace(replace(nfc_normalize(rel_path), '\', '/'), '/+', '/', 'g'), '^(\./|/)+', ''), '/') as p, *
  from local_files where rel_path is not null),
r0 as (
  select trim(regexp_replace(regexp_replace(replace(nfc_normalize(url_decode(replace(rel_path, '+', '%2B'))), '\', '/'), '/+', '/', 'g'), '^(\./|/)+', ''), '/') as p, *,
    trim(remote_modified) as m
  from remote_files where rel_path is not null),
l as (
  select p, local_size as size, lower(content_hash) as h, epoch(date_trunc('second', modified_at))::bigint as t, is_dir
  from (select *, row_number() over (partition by p order by listed_at desc, is_dir desc, local_size desc nulls last, content_hash desc nulls last) as rn from l0) where rn = 1),
r as (
  select p, remote_size as size, lower(regexp_replace(content_hash, '^W/|"', '', 'g')) as h,
    case when regexp_matches(m, '^\d+$') then m::bigint
      when m like '%, %' then epoch(strptime(regexp_replace(replace(m, ' GMT', ' +0000'), '^[A-Za-z]+, ', ''), '%d %b %Y %H:%M:%S %z'))::bigint
      when m like '____-%' then epoch(strptime(regexp_replace(replace(m, 'Z', '+0000'), '([+-]\d\d):(\d\d)$', '\1\2'), '%Y-%m-%dT%H:%M:%S%z'))::bigint end as t, is_dir
  from (select *, row_number() over (partition by p order by listed_at desc, is_dir desc) as rn from r0) where rn = 1),
lf as (select * from l where not is_dir), rf as (select * from r where not is_dir),
j as (select coalesce(lf.p, rf.p) as rel_path, lf.p as lp, rf.p as rp, lf.size as ls, rf.size as rs, lf.h as lh, rf.h as rh, lf.t as lt, rf.t as rt
  from lf full join rf on lf.p = rf.p)
, diff as (
select rel_path, 'local_only' as diff from j where rp is null
union all select rel_path, 'remote_only' from j where lp is null
union all select rel_path, 'size' from j where lp = rp and ls is distinct from rs
union all select rel_path, 'hash' from j where lp = rp and lh is distinct from rh
union all select rel_path, 'local_newer' from j where lp = rp and lt > rt
union all select rel_path, 'remote_newer' from j where lp = rp and rt > lt)
"""

ORACLE = {
    "p3_found": _DIFF + "select rel_path, diff from diff",
    "p3_remote_only_by_folder": _DIFF
    + """select folder, count(*) as files from (
  select unnest(list_transform(range(0, len(string_split(rel_path, '/'))), lambda n: array_to_string(string_split(rel_path, '/')[1:n], '/'))) as folder
  from diff where diff = 'remote_only') group by folder""",
    "p4_found": f"select rel_path, change_id from ({_LAST}) where rn = 1 and deleted_at is null",
    "p4_by_transactions": f"select distinct rel_path, change_id, etag, origin from ({_LAST}) where rn = 1 and deleted_at is null",
    "p4_state": f"""select distinct rel_path, change_id, etag, size_bytes, synced_at, origin,
  change_id > (select min(c) from (select distinct change_id as c from manifest_feed) x where not exists (select 1 from manifest_feed y where y.change_id = x.c + 1)) as after_gap
from ({_LAST}) where rn = 1 and deleted_at is null""",
    "p6_found": """
with v as (
  select session_id, speaker_id, start_ms, end_ms from speaker_intervals
  union all select session_id, -1, start_ms, end_ms from audio_chunks),
o as (
  select *, max(end_ms) over (partition by session_id, speaker_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as before
  from v where session_id is not null and speaker_id is not null and end_ms > start_ms),
g as (
  select *, sum(case when before is null or start_ms > before then 1 else 0 end) over (partition by session_id, speaker_id order by start_ms, end_ms rows unbounded preceding) as island
  from o),
p as (select session_id, speaker_id, island, min(start_ms) as start_ms, max(end_ms) as end_ms from g group by all),
n as (select *, lag(end_ms) over (partition by session_id, speaker_id order by start_ms) as before from p)
select session_id, speaker_id, 'period' as kind, start_ms, end_ms from p
union all
select session_id, speaker_id, 'gap', before, start_ms from n where before is not null and start_ms - before < 3600000""",
}
