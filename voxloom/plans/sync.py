"""Queries over plans, statuses, inventories and projects of a synchronised store, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import basename, dated, is_placeholder, title_of
from voxloom.operators import sync
from voxloom.operators.listings import merge_manifests
from voxloom.operators.replay import replay
from voxloom.operators.sync import Selection
from voxloom.sources import table

DEVICE = "dev-atrium"
CHOSEN = Selection(exclude=("*interview*",), excluded=("summary/0b", "speaker_labels/"), deletion="text")


ENTRY = ["rel_path", "etag", "size_bytes", "synced_at", "origin", "deleted_at"]


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_feed").where("rel_path is not null")


def _merged(feed: DataFrame) -> DataFrame:
    return merge_manifests(feed.select(*ENTRY), feed.select(*ENTRY).limit(0))


def _own(spark: SparkSession, d: str) -> DataFrame:
    """What this device knows: the last entries that it made itself."""
    return _merged(_feed(spark, d).where(F.col("origin") == DEVICE))


def _local(spark: SparkSession, d: str) -> DataFrame:
    rows = _feed(spark, d).where("origin in ('dev-atrium', 'dev-kite') and deleted_at is null")
    return rows.groupBy("rel_path").agg(F.max("size_bytes").alias("size_bytes"))


def _remote(spark: SparkSession, d: str) -> DataFrame:
    return replay(_feed(spark, d)).select("rel_path", "etag")


def _plan(spark: SparkSession, d: str, selection: Selection, online: bool = True) -> DataFrame:
    return sync.plan(_local(spark, d), _own(spark, d), _remote(spark, d) if online else None, DEVICE, selection)


def j8_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, sync.MIRROR)


def j8_plan_offline(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, sync.MIRROR, False)


def j8_plan_chosen(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, CHOSEN)


def j8_plan_download(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, Selection(direction="download", deletion="mirror", audio=False))


def j8_plan_upload(spark: SparkSession, d: str) -> DataFrame:
    """Of projects whose folders have an underscore behind the date."""
    rows = [x.withColumn("rel_path", F.regexp_replace("rel_path", r"^(projects/\d{4}-\d\d-\d\d) ", "$1_")) for x in (_local(spark, d), _own(spark, d), _remote(spark, d))]
    return sync.plan(*rows, DEVICE, Selection(direction="upload", deletion="text", projects=("2026-02-01", "2026-03-03", "2026-01-2", "2026-01-16_p", "2026-02-24_interview")))


def a16_report(spark: SparkSession, d: str) -> DataFrame:
    return j8_plan(spark, d).groupBy("action").agg(F.count("*").alias("files"), F.sum("local_size").alias("bytes"))


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    state = _own(spark, d).select("rel_path", "size_bytes", F.when(F.col("etag").isNotNull(), F.col("synced_at")).alias("last_synced_at"))
    rows = sync.known_files(_local(spark, d), state, _merged(_feed(spark, d)))
    rows = rows.join(_remote(spark, d).select("rel_path", F.lit(True).alias("_there")), "rel_path", "left")
    unknown = F.col("rel_path").startswith("transcript/")  # was not asked for
    rows = rows.withColumn("remote_exists", F.when(~unknown, F.coalesce("_there", F.lit(False))))
    return sync.status(rows.drop("_there"), CHOSEN)


def s1_status(spark: SparkSession, d: str) -> DataFrame:
    return _statuses(spark, d).select("rel_path", "local_size", "remote_exists", "in_scope", "status")


def a10_folder_state(spark: SparkSession, d: str) -> DataFrame:
    rows = _statuses(spark, d).select(F.regexp_replace("rel_path", "/?[^/]*$", "").alias("folder"), "status", sync.attention_rank("status").alias("rank"))
    return rows.groupBy("folder").agg(F.min_by("status", "rank").alias("status"), F.bool_or(sync.needs_attention("status")).alias("attention"))


def a12_counts(spark: SparkSession, d: str) -> DataFrame:
    state = _own(spark, d).select(F.when(F.col("etag").isNotNull(), F.col("synced_at")).alias("last_synced_at"))
    return state.agg(F.count("last_synced_at").alias("synced"), F.count_if(F.col("last_synced_at").isNull()).alias("never"))


def _tidy(column: str) -> Column:
    """Files of projects by the names that tell their group: the data have them behind a number, and summaries as one kind."""
    x = F.regexp_replace(column, r"/[^/-]+-(?=(?:transcript\.json|summary\.md|r.sum.\.md|mind map\.mmd)$)", "/")
    x = F.regexp_replace(F.regexp_replace(x, r"/summary\.md$", "/summary-brief.md"), r"/r.sum.\.md$", "/summary-detailed.md")
    x = F.regexp_replace(x, r"/mind map\.mmd$", "/mindmap.mmd")
    return F.regexp_replace(x, r"^(projects/[^/]+)/(?:.*/)?(transcript\.json|summary-[a-z]+\.md|mindmap\.mmd)$", "$1/$2")


def a15_inventory(spark: SparkSession, d: str) -> DataFrame:
    return sync.inventory(_statuses(spark, d).withColumn("rel_path", _tidy("rel_path")))


def p21_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select("rel_path").distinct()
    return rows.select("rel_path", sync.file_group(_tidy("rel_path")).alias("file_group"))


def p22_missing_parts(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace(_tidy("rel_path"), r"^(projects/[^/]+)/(?:.*/)?[^/]+-(audio\.[a-z0-9]+)$", "$1/audio/$2")
    name = F.regexp_replace(name, r"^(projects/[^/]+)/transcript\.json$", "$1/transcript.md")
    rows = table(spark, d, "local_files").where("not is_dir").select(name.alias("rel_path"))
    return sync.missing_artifacts(rows).select("project", F.array_join("missing", ",").alias("missing"))


def p10_projects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select(F.replace(sync.project_of("rel_path"), F.lit(" "), F.lit("_")).alias("folder")).where("folder is not null").distinct()
    chosen = {"by_date": "2026-01-06", "by_half_date": "2026-01-0", "by_title": "2026-02-24_i", "by_name": "2026-01-22_field-notes"}
    return rows.select("folder", *[sync.project_matches("folder", s).alias(n) for n, s in chosen.items()])


def f5_titles(spark: SparkSession, d: str) -> DataFrame:
    folder = F.replace(sync.project_of("rel_path"), F.lit(" "), F.lit("_"))
    rows = table(spark, d, "local_files").select(folder.alias("folder")).where("folder is not null").distinct()
    number = F.concat("folder", F.when(F.length("folder") % 3 == 0, "_2").when(F.length("folder") % 3 == 1, "_123").otherwise(""))
    return rows.select(number.alias("folder")).select("folder", dated("folder").alias("day"), title_of("folder").alias("title"), is_placeholder(title_of("folder")).alias("says_nothing"))


def w15_unique_names(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "local_files").where("not is_dir").select(basename("rel_path").alias("name"), "rel_path").distinct()
    wanted = taken.select(F.regexp_replace("name", "^[^-]*-", "").alias("stem"), F.col("rel_path").alias("id"))
    wanted = wanted.groupBy("stem").agg(F.count("*").alias("_n")).select("stem", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("id"))
    names = taken.select("name").union(taken.select(F.concat(F.regexp_replace("name", "^[^-]*-", ""), F.when(F.length("rel_path") % 5 == 0, "_2").when(F.length("rel_path") % 5 == 1, "_5").otherwise(""))))
    return sync.unique_names(wanted, names)


def t2_projects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select(sync.project_of("rel_path").alias("project"), "modified_at", "rel_path").where("project is not null")
    return rows.groupBy("project").agg(F.max(F.unix_micros("modified_at")).alias("updated_us"), F.count_distinct("rel_path").alias("paths")).orderBy(F.desc("updated_us"), "project")


def u3_state_of_live_files(spark: SparkSession, d: str) -> DataFrame:
    alive = _merged(_feed(spark, d)).where("deleted_at is null")
    return _own(spark, d).select("rel_path").join(alive.select("rel_path"), "rel_path", "left_semi")


_NAMES = "j8_plan j8_plan_offline j8_plan_chosen j8_plan_download j8_plan_upload a16_report s1_status a10_folder_state a12_counts a15_inventory p21_groups p22_missing_parts p10_projects f5_titles w15_unique_names t2_projects u3_state_of_live_files"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_NS = "case when abs(synced_at) < 100000000000 then synced_at::hugeint * 1000000000 when abs(synced_at) < 100000000000000 then synced_at::hugeint * 1000000 else synced_at::hugeint * 1000 end"
_KEYS = f"{_NS} desc nulls last, etag desc nulls last, size_bytes desc nulls last, synced_at desc, origin desc nulls last, deleted_at desc nulls last"
_BASE = f"""
feed as (select * from manifest_feed where rel_path is not null),
l as (select rel_path, max(size_bytes) as size from feed where origin in ('dev-atrium', 'dev-kite') and deleted_at is null group by 1),
m as (select * from (select *, row_number() over (partition by rel_path order by {_KEYS}) as k from feed where origin = 'dev-atrium') where k = 1),
a as (select * from (select *, row_number() over (partition by rel_path order by {_KEYS}) as k from feed) where k = 1),
r as (select rel_path, etag from (select *, row_number() over (partition by rel_path order by {_NS} desc, change_id desc) as k from feed) where k = 1 and deleted_at is null)"""
_AUDIO = r"regexp_matches(lower(rel_path), '[^/]\.(wav|mp3|m4a|aac|flac|ogg|opus|wma)$')"
_WANTS = "not (rel_path = 'summary/0b' or starts_with(rel_path, 'summary/0b/') or rel_path = 'speaker_labels' or starts_with(rel_path, 'speaker_labels/')) and not contains(rel_path, 'interview')"


def _plan_sql(wants: str, up: str, down: str, delete: str, offline: bool = False) -> str:
    seen = "null::varchar" if offline else "r.etag"
    return f"""with {_BASE},
x as (select coalesce(l.rel_path, m.rel_path) as rel_path, l.rel_path is not null as here, coalesce(l.size, 0) as size, m.etag as known, {seen} as seen, m.deleted_at is not null as dead, m.rel_path is not null as listed
  from l full join m on l.rel_path = m.rel_path left join r on r.rel_path = coalesce(l.rel_path, m.rel_path)),
p as (select rel_path, size, seen, known, case
    when here and dead then '{up}' when here and seen is null then '{up}' when here and known is null then 'skip' when here and known = seen then 'skip' when here then '{down}'
    when dead then null when {delete} then 'delete_remote' when '{down}' = 'download' and seen is not null then 'download' end as action from x where {wants})
select rel_path, action, size as local_size, case when action = 'delete_remote' then known else seen end as remote_etag from p where action is not null"""


_MIRROR = _plan_sql("true", "upload", "download", "true")
_STATUS = f"""with {_BASE},
x as (select coalesce(l.rel_path, m.rel_path) as rel_path, l.rel_path is not null as here, l.size as local_size, m.size_bytes as was, case when m.etag is not null then m.synced_at end as upto,
    case when not starts_with(coalesce(l.rel_path, m.rel_path), 'transcript/') then r.rel_path is not null end as seen
  from l full join m on l.rel_path = m.rel_path left join r on r.rel_path = coalesce(l.rel_path, m.rel_path)
  where l.size is not null or exists (select 1 from a where a.rel_path = coalesce(l.rel_path, m.rel_path) and a.deleted_at is null)),
s as (select rel_path, local_size, seen as remote_exists, {_WANTS} as in_scope, case
    when not ({_WANTS}) then case when local_size is not null then 'excluded' else 'deleted_local_kept_remote' end
    when local_size is null then case when upto is null then 'never_synced' when not seen then 'synced' when not {_AUDIO} then 'pending_delete' else 'deleted_local_kept_remote' end
    when upto is null then 'never_synced' when seen = false then 'pending_upload' when local_size <> was then 'pending_upload' else 'synced' end as status from x)"""
_RANK = "list_position(['conflict', 'pending_delete', 'pending_download', 'pending_upload', 'excluded', 'deleted_local_kept_remote', 'never_synced', 'synced'], status)"
_NEEDS = "status not in ('synced', 'never_synced', 'deleted_local_kept_remote')"
_PROJECT = "nullif(regexp_extract(rel_path, '^projects/([^/]+)', 1), '')"
_NAME = "string_split(rel_path, '/')[-1]"
_GROUP = f"""case when {_AUDIO} then 'audio' when regexp_matches({_NAME}, '^[^/-]+-transcript\\.json$') then 'transcript' when regexp_matches({_NAME}, '^[^/-]+-summary\\.md$') then 'brief'
  when regexp_matches({_NAME}, '^[^/-]+-r.sum.\\.md$') then 'detailed' when regexp_matches({_NAME}, '^[^/-]+-mind map\\.mmd$') then 'mindmap' else 'meta' end"""
_FOLDER = f"select distinct replace({_PROJECT}, ' ', '_') as folder from local_files where {_PROJECT} is not null"

ORACLE = {
    "j8_plan": _MIRROR,
    "j8_plan_offline": _plan_sql("true", "upload", "download", "true", True),
    "j8_plan_chosen": _plan_sql(_WANTS, "upload", "download", f"not {_AUDIO}"),
    "j8_plan_download": _plan_sql(f"not {_AUDIO}", "skip", "download", "false"),
    "j8_plan_upload": _plan_sql(r"regexp_matches(rel_path, '^projects/(2026-02-01_|2026-03-03_|2026-01-16_p|2026-02-24_interview)')", "upload", "skip", f"not {_AUDIO}").replace("select * from manifest_feed where", r"select * replace (regexp_replace(rel_path, '^(projects/\d{4}-\d\d-\d\d) ', '\1_') as rel_path) from manifest_feed where"),
    "a16_report": f"select action, count(*) as files, sum(local_size)::bigint as bytes from ({_MIRROR}) group by 1",
    "s1_status": _STATUS + " select * from s",
    "a10_folder_state": _STATUS + f" select regexp_replace(rel_path, '/?[^/]*$', '') as folder, arg_min(status, {_RANK}) as status, bool_or({_NEEDS}) as attention from s group by 1",
    "a12_counts": f"with {_BASE} select count(*) filter (etag is not null) as synced, count(*) filter (etag is null) as never from m",
    "a15_inventory": _STATUS + f""", g as (select coalesce({_PROJECT}, '') as project, {_GROUP} as file_group, * from s)
select project, file_group, count(*) as files, coalesce(sum(local_size), 0)::bigint as bytes, bool_or(in_scope) as in_scope, count(*) filter ({_NEEDS}) as attention, arg_min(status, {_RANK}) as status from g group by rollup (project, file_group)""",
    "p21_groups": f"select distinct rel_path, {_GROUP} as file_group from local_files",
    "p22_missing_parts": f"""with f as (select {_PROJECT} as project, {_NAME} as name, regexp_matches({_NAME}, '^[^/]+-audio\\.[a-z0-9]+$') as audio from local_files where not is_dir and {_PROJECT} is not null),
g as (select project, bool_or(audio) as a, bool_or(regexp_matches(name, '^[^/-]+-transcript\\.json$')) as t, bool_or(regexp_matches(name, '^[^/-]+-r.sum.\\.md$')) as s, bool_or(regexp_matches(name, '^[^/-]+-summary\\.md$')) as b, bool_or(regexp_matches(name, '^[^/-]+-mind map\\.mmd$')) as m from f group by 1)
select project, concat_ws(',', case when not a then 'audio' end, case when not t then 'transcript' end, case when not s then 'detailed' end, case when not b then 'brief' end, case when not m then 'mindmap' end) as missing from g""",
    "p10_projects": f"select folder, starts_with(folder, '2026-01-06_') or folder = '2026-01-06' as by_date, folder = '2026-01-0' as by_half_date, starts_with(folder, '2026-02-24_i') as by_title, starts_with(folder, '2026-01-22_field-notes') as by_name from ({_FOLDER})",
    "f5_titles": f"""with x as (select folder || case length(folder) % 3 when 0 then '_2' when 1 then '_123' else '' end as folder, folder as was from ({_FOLDER})),
y as (select folder, nullif(regexp_extract(folder, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})_', 1), '') as day, case when regexp_matches(folder, '^[^_]{{10}}_') and length(string_split(folder, '_')[1]) - length(replace(string_split(folder, '_')[1], '-', '')) = 2 then folder[12:] else folder end as rest from x),
z as (select folder, day, case when regexp_matches(rest, '^.+_[0-9]{{0,2}}$') then regexp_replace(rest, '_[0-9]{{0,2}}$', '') else rest end as title from y)
select folder, day, case when trim(title) = '' then folder else title end as title, regexp_matches(lower(trim(title)), '^(|[0-9]+|(recording|audio|input|output|untitled)([ (_-].*)?)$') as says_nothing from z""",
    "w15_unique_names": f"""with t as (select distinct {_NAME} as name, rel_path from local_files where not is_dir),
n as (select name from t union select regexp_replace(name, '^[^-]*-', '') || case length(rel_path) % 5 when 0 then '_2' when 1 then '_5' else '' end from t),
w as (select regexp_replace(name, '^[^-]*-', '') as stem, count(*) as many from t group by 1),
c as (select stem, many, k, case when k = 1 then stem else stem || '_' || k end as name from w, (select unnest(range(1, 1000)) as k)),
f as (select stem, many, name, row_number() over (partition by stem order by k) as id from c where name not in (select name from n)),
i as (select stem, unnest(range(1, many + 1)) as id from w)
select i.stem, i.id, f.name from i left join f on f.stem = i.stem and f.id = i.id""",
    "t2_projects": f"select {_PROJECT} as project, max(epoch_us(modified_at)) as updated_us, count(distinct rel_path) as paths from local_files where {_PROJECT} is not null group by 1 order by updated_us desc nulls last, project",
    "u3_state_of_live_files": f"with {_BASE} select m.rel_path from m join a on a.rel_path = m.rel_path where a.deleted_at is null",
}
