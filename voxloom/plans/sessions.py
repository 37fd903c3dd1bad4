"""Queries over sessions, projects, stored documents and summaries, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import diagrams
from voxloom.functions.text import guessed_scene, is_placeholder, sample_key
from voxloom.operators import summaries, sync
from voxloom.operators.listings import merge_manifests
from voxloom.operators.recognition import in_chunk_order, in_list_order, resume_points, transcribe
from voxloom.operators.scan import running_sum, sliced
from voxloom.operators.utterances import documents_of, newest_labels
from voxloom.sources import stores, table
from voxloom.sources.files import first_etag
from voxloom.streaming.streams import finished_chunks


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_labels")
    newest = rows.groupBy("session_id").agg(F.max("labels_version").alias("labels_version"))
    return rows.join(newest, ["session_id", "labels_version"]).groupBy("session_id", "labels_version", "speaker_id").agg(*[F.max(c).alias(c) for c in ("display_name", "color", "profile_id")])


def j11_session_detail(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the talk time of their speaker, 0 if silent."""
    rows = table(spark, d, "segments").where("speaker_id is not null").groupBy("seg_id", "session_id", "speaker_id").agg(F.max(F.greatest(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(0))).alias("ms"))
    talk = rows.groupBy("session_id", "speaker_id").agg(F.sum("ms").alias("talk_time_ms"), F.count("*").alias("segment_count"))
    out = newest_labels(table(spark, d, "speaker_labels")).join(talk, ["session_id", "speaker_id"], "left")
    return out.fillna(0, ["talk_time_ms", "segment_count"])


def p4_stale_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries made with the first version of a session's labels, and whether the labels have changed since."""
    rows = table(spark, d, "speaker_labels").groupBy("session_id").agg(F.min("labels_version").alias("made_with"), F.max("labels_version").alias("labels_version"))
    return rows.withColumn("stale", F.col("made_with") < F.col("labels_version"))


def j3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals from vectors and their clusters, by emb_id."""
    rows = table(spark, d, "voice_embeddings").select("emb_id", "session_id", "start_ms", "end_ms").distinct()
    clusters = rows.select("emb_id", (F.col("emb_id") % 4).alias("speaker_id"))
    return rows.join(clusters, "emb_id").select("emb_id", "session_id", "start_ms", "end_ms", "speaker_id")


def t4_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Intervals given in seconds, as whole milliseconds without empty ones."""
    rows = table(spark, d, "speaker_intervals").select("interval_id", "session_id", (F.col("start_ms") / 1000.0 - 0.25).alias("s"), (F.col("end_ms") / 1000.0).alias("e"), "speaker_id").distinct()
    ms = lambda c: F.floor(F.greatest(F.col(c), F.lit(0.0)) * 1000 + 0.5).cast("long")
    rows = rows.where("s is not null and e is not null").select("interval_id", "session_id", ms("s").alias("start_ms"), ms("e").alias("end_ms"), F.greatest("speaker_id", F.lit(0)).alias("speaker_id"))
    return rows.where("end_ms > start_ms")


def a8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Units read, written and taken from a cache, summed by source."""
    rows = table(spark, d, "documents").select("source", (F.col("n_chars") / 4).cast("long").alias("input"), F.floor(F.col("n_chars") / 40).alias("output"), F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("n_chars") / 8)).otherwise(0).alias("cached"))
    return rows.groupBy("source").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cached")])


def a11_partly_in_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").where("rel_path is not null").select(F.regexp_extract("rel_path", "^[^/]*", 0).alias("top"), sync.Selection(exclude=("*standup*",), audio=False).wants("rel_path").alias("wanted"))
    return rows.groupBy("top").agg((F.bool_or("wanted") & F.bool_or(~F.col("wanted"))).alias("partly"), F.count_if("wanted").alias("rows"))


def a21_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes here, and what deleting all of one project would free."""
    rows = table(spark, d, "local_files").groupBy("rel_path").agg(F.max_by(F.struct("is_dir", "local_size"), F.struct("listed_at", "local_size")).alias("x")).select("rel_path", "x.*")
    gone = F.coalesce(sync.project_of("rel_path") == "2026-01-06 40% draft", F.lit(False))
    size = F.coalesce("local_size", F.lit(0))
    file = ~F.col("is_dir")
    return rows.agg(
        F.count_if(file).alias("files"), F.sum(F.when(file, size)).alias("bytes"), F.count_if(file & gone).alias("gone_files"), F.count_if(~file & gone).alias("gone_folders"),
        F.coalesce(F.sum(F.when(file & gone, size)), F.lit(0)).alias("gone_bytes"),
    )


def u4_profile_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of two manifests together: what is here stays, and the version is the larger one."""
    rows = table(spark, d, "speaker_labels").where("profile_id is not null")
    here = rows.where("labels_version = 0").groupBy("profile_id").agg(F.max("display_name").alias("name"), F.max("labels_version").alias("version"))
    there = rows.where("labels_version > 0").groupBy("profile_id").agg(F.min("display_name").alias("other"), F.max("labels_version").alias("newer"))
    out = here.join(there, "profile_id", "full")
    return out.select("profile_id", F.coalesce("name", "other").alias("name"), F.greatest("version", "newer").alias("version"))


def w11_progress(spark: SparkSession, d: str) -> DataFrame:
    """The share of a session's chunks that is done when half of a chunk is."""
    rows = table(spark, d, "audio_chunks").where("session_id is not null and start_ms is not null and idx is not null").groupBy("session_id", "idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    rows = rows.withColumn("ms", F.greatest(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(0)))
    total = rows.groupBy("session_id").agg(F.sum("ms").alias("total"))
    out = running_sum(sliced(rows, ["session_id"], "start_ms"), ["session_id"], ["start_ms", "idx"], "ms", "upto").join(total, "session_id")
    share = F.least((F.col("upto") - F.col("ms") + 0.5 * F.col("ms")) / F.nullif("total", F.lit(0)), F.lit(1.0))
    return out.select("session_id", "idx", F.round(share, 6).alias("share"))


def m3_repaired_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id of a recording: the recorded hash, else that of its content."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.substring("url", 1, 20)).alias("recorded"), "raw_bytes")
    return rows.select("doc_id", F.coalesce("recorded", F.sha2("raw_bytes", 256)).alias("id"))


def m4_opened_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects opened again: a title that says nothing gives way to a new one, any other stays; what is new is added."""
    have = table(spark, d, "transcripts").groupBy("session_id").agg(F.max("model").alias("m"))
    have = have.where("session_id < 'c'").select("session_id", F.when(F.col("session_id") < "4", "recording_2").when(F.col("session_id") < "6", F.col("m")).otherwise("Choir").alias("title"))
    new = table(spark, d, "transcripts").where("session_id >= '3'").groupBy("session_id").agg(F.lit("New name").alias("new_title"))
    out = have.join(new, "session_id", "full")
    return out.select("session_id", F.when(F.col("title").isNull() & F.col("new_title").isNull(), F.lit(None)).when(F.col("new_title").isNotNull() & is_placeholder("title"), F.col("new_title")).otherwise(F.coalesce("title", "new_title")).alias("title"))


def j13_cloud_copies(spark: SparkSession, d: str) -> DataFrame:
    """Folder names that an alive remote path has below projects: an equi-join on the parts of paths."""
    feed = table(spark, d, "manifest_feed").where("rel_path is not null").select("rel_path", "etag", "synced_at", "deleted_at", "origin")
    alive = merge_manifests(feed, feed.limit(0)).where("deleted_at is null and rel_path like 'projects/%'")
    inner = F.slice(F.split("rel_path", "/"), 2, F.greatest(F.size(F.split("rel_path", "/")) - 2, F.lit(0)))
    parts = alive.select(F.explode(inner).alias("name")).distinct()
    wanted = table(spark, d, "manifest_feed").where("rel_path is not null").select(F.explode(F.split("rel_path", "/")).alias("name")).distinct()
    return wanted.join(parts, "name", "left_semi")


def j15_to_repair(spark: SparkSession, d: str) -> DataFrame:
    """Projects to repair: those of a list that have no transcript."""
    rows = table(spark, d, "local_files").where("not is_dir").select(sync.project_of("rel_path").alias("project"), "rel_path").where("project is not null")
    listed = rows.select("project").distinct().where("project like '%n%'")
    good = rows.where("rel_path like '%transcript.json'").select("project").distinct()
    return rows.select("project").distinct().join(listed, "project", "left_semi").join(good, "project", "left_anti")


def m6_recordings(spark: SparkSession, d: str) -> DataFrame:
    """The recording of each project: the first path."""
    rows = table(spark, d, "local_files").where("not is_dir and rel_path rlike '[.](m4a|wav|flac)$'").select(sync.project_of("rel_path").alias("project"), "rel_path").where("project is not null")
    return rows.groupBy("project").agg(F.min("rel_path").alias("recording"))


def s10_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as documents, one entry with a key that is no number added, and read back."""
    docs = stores.labels_json(_labels(spark, d)).withColumn("json", F.regexp_replace("json", '"labels":\\{', '"labels":{"x1":{"display_name":"no"},'))
    return docs.select(F.inline(stores.labels_of("json")))


def s11_registry(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "speaker_labels").where("profile_id is not null").groupBy("profile_id").agg(F.max("display_name").alias("display_name"))
    return stores.registry_json(people).select(F.explode(stores.registry_of("json")).alias("profile_id", "display_name"))


def s18_states(spark: SparkSession, d: str) -> DataFrame:
    """States written as documents, one for each first letter of an origin, some of them damaged, and read back."""
    feed = table(spark, d, "manifest_feed").where("rel_path is not null and origin is not null")
    last = feed.groupBy("origin", "rel_path").agg(F.max(F.struct("change_id", "synced_at", "etag", "size_bytes")).alias("x"))
    entry = F.struct("rel_path", F.struct(F.col("x.synced_at").alias("last_synced_at"), F.col("x.etag").alias("etag"), F.col("x.size_bytes").alias("size")).alias("v"))
    docs = last.groupBy("origin").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files"))).alias("json"))
    docs = docs.withColumn("json", F.when(F.col("origin") == "dev-kite", F.left("json", F.length("json") - 3)).when(F.col("origin") == "dev-porch", F.concat(F.lit("﻿"), "json")).otherwise(F.col("json")))
    return docs.select("origin", F.inline(stores.state_of("json")))


def f75_sample_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "voice_embeddings").where("start_ms is not null").select("emb_id", "session_id", "start_ms").distinct()
    return rows.select("emb_id", sample_key(F.lit("p1"), "session_id", "start_ms").alias("sample_id"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").where("start_ms is not null and text is not null").select("session_id", F.col("seg_id").alias("first_seg"), "start_ms", F.col("text").alias("block")).distinct()
    return documents_of(rows, "\n")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Of each session with segments: how many, its seconds, the names of its speakers, and what it sounds like."""
    segments = table(spark, d, "segments").groupBy("session_id").agg(F.count_distinct("seg_id").alias("segments"))
    heads = table(spark, d, "transcripts").groupBy("session_id").agg(F.max(F.coalesce("duration_ms", F.lit(0))).alias("ms"), F.max("raw_text").alias("t"))
    names = newest_labels(table(spark, d, "speaker_labels")).where("display_name is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("speaker_id", "display_name"))).alias("names"))
    rows = segments.join(heads, "session_id").join(names, "session_id", "left")
    scene = guessed_scene(F.coalesce("t", F.lit("")), ("chapter", "garden"), ("folder", "signal"))["scene"]
    return rows.select("session_id", "segments", F.expr("ms div 1000").alias("seconds"), F.array_join(F.transform("names", lambda n: n["display_name"]), ", ").alias("names"), scene.alias("scene"))


def l5_mock_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a session as a stand-in for a model's: (session_id, detailed, brief)."""
    rows = _facts(spark, d)
    who = F.when(F.coalesce(F.col("names"), F.lit("")) != "", F.concat(F.lit("- speakers: "), "names", F.lit("\n"))).otherwise("")
    detailed = F.concat(F.lit("# (mock) "), "scene", F.lit("\n\n- segments: "), F.col("segments").cast("string"), F.lit("\n- seconds: "), F.col("seconds").cast("string"), F.lit("\n"), who)
    points = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.greatest("segments", F.lit(1)), F.lit(3)).cast("int")), lambda n: F.concat(F.lit("- point "), n.cast("string"))), "\n")
    return rows.select("session_id", detailed.alias("detailed"), F.concat(F.lit("# (mock) "), "scene", F.lit("\n"), points).alias("brief"))


def l2_mock_mindmaps(spark: SparkSession, d: str) -> DataFrame:
    """A diagram of a session as a stand-in for a model's, with its outline and its issues."""
    rows = _facts(spark, d)
    part = lambda n: F.concat(F.lit("    part "), n.cast("string"), F.lit("\n      [["), n.cast("string"), F.lit("]]"))
    text = F.concat(F.lit("mindmap\n  root(("), "scene", F.lit("))\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.greatest("segments", F.lit(1)), F.lit(4)).cast("int")), part), "\n"))
    rows = rows.select("session_id", text.alias("text"))
    return rows.select("session_id", F.size(diagrams.issues_of("text")).alias("issues"), F.size(diagrams.issues_of(diagrams.repaired("text"))).alias("after"), diagrams.outline_of(diagrams.repaired("text")).alias("outline"))


def l1_summary_plan(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summary_plan(_documents(spark, d), 4000)


def l1_summaries(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summarise(_documents(spark, d), map_from=4000)


def st3_resume_points(spark: SparkSession, d: str) -> DataFrame:
    """Where sessions go on whose chunks with sound are done."""
    return resume_points(finished_chunks(table(spark, d, "audio_chunks").where("samples is not null or idx % 3 = 0"), "ingested_at"))


def s20_chunk_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("session_id", F.col("seg_id").alias("pos"), F.when((F.col("seg_id") % 500 != 7) | (F.left("session_id", F.lit(1)) < "9"), F.expr("99 - start_ms div 60000 % 100")).alias("chunk_id")).where("pos < 4294967296").distinct()
    return in_chunk_order(rows).select("session_id", "pos", "order")


def s3_transcribed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audio_chunks").where("size(samples) > 0").dropDuplicates(["session_id", "idx"])
    return transcribe(rows)


def t5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files and folders by folder, and in it folders first, then by name."""
    rows = table(spark, d, "local_files").groupBy("rel_path").agg(F.max_by("is_dir", F.struct("listed_at", "local_size")).alias("is_dir"))
    rows = rows.select(F.regexp_replace("rel_path", "/?[^/]*$", "").alias("folder"), "is_dir", F.element_at(F.split("rel_path", "/"), -1).alias("name"))
    return rows.orderBy("folder", *in_list_order("is_dir", "name"))


def s23_etags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest_feed").select("change_id", "etag").distinct()
    xml = F.concat(F.lit('<a:prop xmlns:a="DAV:"><a:getetag> </a:getetag><b:getetag x="1">&quot;'), F.coalesce("etag", F.lit("")), F.lit("&amp;&quot;</b:getetag><a:getetag>no</a:getetag></a:prop>"))
    return rows.select("change_id", first_etag(xml).alias("found"))


_NAMES = "l5_mock_summaries l2_mock_mindmaps st3_resume_points s20_chunk_order s3_transcribed t5_nodes s23_etags j11_session_detail p4_stale_summaries j3_intervals t4_seconds a8_usage a11_partly_in_scope a21_totals u4_profile_names w11_progress m3_repaired_ids m4_opened_projects j13_cloud_copies j15_to_repair m6_recordings s10_labels s11_registry s18_states f75_sample_keys l1_summary_plan l1_summaries"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_NEWEST = "n as (select session_id, v as labels_version, speaker_id, max(display_name) as display_name, max(color) as color, max(profile_id) as profile_id from (select *, max(labels_version) over (partition by session_id) as v from speaker_labels) where labels_version = v group by 1, 2, 3)"
_NS = "case when abs(synced_at) < 100000000000 then synced_at::hugeint * 1000000000 when abs(synced_at) < 100000000000000 then synced_at::hugeint * 1000000 else synced_at::hugeint * 1000 end"
_PROJECT = "nullif(regexp_extract(rel_path, '^projects/([^/]+)', 1), '')"
_AUDIO = r"regexp_matches(lower(rel_path), '[^/]\.(wav|mp3|m4a|aac|flac|ogg|opus|wma)$')"
_TEXTS = "d as (select session_id, string_agg(text, chr(10) order by start_ms, seg_id) as t from (select distinct session_id, seg_id, start_ms, text from segments where start_ms is not null and text is not null) group by 1)"

_FACTS = f"""with {_NEWEST}, g as (select session_id, count(distinct seg_id) as n from segments group by 1), h as (select session_id, max(coalesce(duration_ms, 0)) // 1000 as s, coalesce(max(raw_text), '') as t from transcripts group by 1),
m as (select session_id, string_agg(display_name, ', ' order by speaker_id) as names from n where display_name is not null group by 1),
k as (select g.*, h.s, m.names, contains(t, 'chapter')::int + contains(t, 'garden')::int as a, contains(t, 'folder')::int + contains(t, 'signal')::int as b from g join h on h.session_id = g.session_id left join m on m.session_id = g.session_id),
f as (select *, case when a = 0 and b = 0 then 'other' when a >= b then 'lecture' else 'meeting' end as scene from k) """

ORACLE = {
    "j11_session_detail": f"with {_NEWEST}, t as (select session_id, speaker_id, sum(greatest(coalesce(end_ms - start_ms, 0), 0)) as ms, count(*) as c from (select distinct seg_id, session_id, speaker_id, start_ms, end_ms from segments where speaker_id is not null) group by 1, 2) select n.session_id, n.speaker_id, n.display_name, coalesce(t.ms, 0)::bigint as talk_time_ms, coalesce(t.c, 0) as segment_count from n left join t on t.session_id = n.session_id and t.speaker_id = n.speaker_id",
    "p4_stale_summaries": "select session_id, min(labels_version) as made_with, max(labels_version) as labels_version, min(labels_version) < max(labels_version) as stale from speaker_labels group by 1",
    "j3_intervals": "select distinct emb_id, session_id, start_ms, end_ms, emb_id % 4 as speaker_id from voice_embeddings",
    "t4_seconds": "select interval_id, session_id, s as start_ms, e as end_ms, greatest(speaker_id, 0) as speaker_id from (select distinct interval_id, session_id, speaker_id, greatest(start_ms - 250, 0) as s, greatest(end_ms, 0) as e from speaker_intervals where start_ms is not null and end_ms is not null) where e > s",
    "a8_usage": "select source, coalesce(sum(n_chars // 4), 0)::bigint as input, coalesce(sum(n_chars // 40), 0)::bigint as output, coalesce(sum(case when doc_id % 3 = 0 then n_chars // 8 else 0 end), 0)::bigint as cached from documents group by 1",
    "a11_partly_in_scope": f"with w as (select regexp_extract(rel_path, '^[^/]*') as top, not contains(rel_path, 'standup') and not {_AUDIO} as wanted from local_files where rel_path is not null) select top, bool_or(wanted) and bool_or(not wanted) as partly, count(*) filter (wanted) as rows from w group by 1",
    "a21_totals": f"with l as (select *, coalesce({_PROJECT} = '2026-01-06 40% draft', false) as gone from (select *, row_number() over (partition by rel_path order by listed_at desc, local_size desc nulls last) as k from local_files) where k = 1) select count(*) filter (not is_dir) as files, (sum(coalesce(local_size, 0)) filter (not is_dir))::bigint as bytes, count(*) filter (not is_dir and gone) as gone_files, count(*) filter (is_dir and gone) as gone_folders, coalesce(sum(local_size) filter (not is_dir and gone), 0)::bigint as gone_bytes from l",
    "u4_profile_names": "with h as (select profile_id, max(display_name) as name, max(labels_version) as version from speaker_labels where profile_id is not null and labels_version = 0 group by 1), t as (select profile_id, min(display_name) as other, max(labels_version) as newer from speaker_labels where profile_id is not null and labels_version > 0 group by 1) select coalesce(h.profile_id, t.profile_id) as profile_id, coalesce(name, other) as name, greatest(version, newer) as version from h full join t on h.profile_id = t.profile_id",
    "w11_progress": "with c as (select session_id, idx, min(start_ms) as s, greatest(coalesce(max(end_ms) - min(start_ms), 0), 0) as ms from audio_chunks where session_id is not null and start_ms is not null and idx is not null group by 1, 2), r as (select *, sum(ms) over (partition by session_id order by s, idx) as upto, sum(ms) over (partition by session_id) as total from c) select session_id, idx, round(least((upto - ms + 0.5 * ms)::double / nullif(total, 0), 1.0), 6) as share from r",
    "m3_repaired_ids": "select doc_id, coalesce(case when doc_id % 2 = 0 then substring(url, 1, 20) end, sha256(raw_bytes)) as id from documents",
    "m4_opened_projects": "with t as (select session_id, max(model) as m from transcripts group by 1), h as (select session_id, case when session_id < '4' then 'recording_2' when session_id < '6' then m else 'Choir' end as title from t where session_id < 'c'), n as (select session_id from t where session_id >= '3') select coalesce(h.session_id, n.session_id) as session_id, case when n.session_id is not null and (title is null or title = 'recording_2') then 'New name' else title end as title from h full join n on h.session_id = n.session_id",
    "j13_cloud_copies": f"with a as (select * from (select *, row_number() over (partition by rel_path order by {_NS} desc nulls last, etag desc nulls last, synced_at desc nulls last, deleted_at desc nulls last, origin desc nulls last) as k from manifest_feed where rel_path is not null) where k = 1 and deleted_at is null and rel_path like 'projects/%'), p as (select distinct unnest(string_split(rel_path, '/')[2:-2]) as name from a) select distinct name from (select unnest(string_split(rel_path, '/')) as name from manifest_feed where rel_path is not null) where name in (select name from p)",
    "j15_to_repair": f"select distinct p as project from (select {_PROJECT} as p from local_files where not is_dir) where p like '%n%' and p not in (select {_PROJECT} from local_files where not is_dir and rel_path like '%transcript.json' and {_PROJECT} is not null)",
    "m6_recordings": f"select {_PROJECT} as project, min(rel_path) as recording from local_files where not is_dir and regexp_matches(rel_path, '[.](m4a|wav|flac)$') and {_PROJECT} is not null group by 1",
    "s10_labels": f"with {_NEWEST} select * from n where speaker_id is not null",
    "s11_registry": "select profile_id, max(display_name) as display_name from speaker_labels where profile_id is not null group by 1",
    "s18_states": "select origin, rel_path, synced_at as last_synced_at, etag, size_bytes from (select *, row_number() over (partition by origin, rel_path order by change_id desc) as k from manifest_feed where rel_path is not null and origin is not null and origin <> 'dev-kite') where k = 1",
    "f75_sample_keys": "select distinct emb_id, 'p1-' || session_id || '-' || start_ms as sample_id from voice_embeddings where start_ms is not null",
    "l1_summary_plan": r"with " + _TEXTS + r", w as (select session_id, length(t) as n, length(t) - length(regexp_replace(t, '[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]', '', 'g')) as w from d) select session_id, w + ceil((n - w) / 4.0)::bigint as tokens, w + ceil((n - w) / 4.0)::bigint > 4000 as in_pieces from w",
    "st3_resume_points": "with c as (select distinct session_id, idx from audio_chunks where idx is not null and session_id is not null and (samples is not null or idx % 3 = 0)), r as (select *, row_number() over (partition by session_id order by idx) - 1 as n from c where idx >= 0) select c.session_id, count(*) as completed, coalesce((select max(idx) + 1 from r where r.session_id = c.session_id and r.idx = r.n), 0) as next from c group by 1",
    "s20_chunk_order": """with r as (select distinct session_id, seg_id as pos, case when seg_id % 500 <> 7 or left(session_id, 1) < '9' then 99 - start_ms // 60000 % 100 end as chunk_id from segments) select session_id, pos, case when bool_and(chunk_id is not null) over (partition by session_id) then chunk_id * 4294967296 else 0 end + pos as "order" from r""",
    "s3_transcribed": "with c as (select *, case when sample_rate > 0 and channels > 0 then len(samples) // channels * 1000 // sample_rate else 0 end as total from (select distinct on (session_id, idx) * from audio_chunks where len(samples) > 0)), s as (select session_id, idx, coalesce(start_ms, 0) as at_ms, total, unnest(range(0, total, 5000)) as a from c where total > 0) select session_id, idx, a // 5000 as pos, at_ms + a as start_ms, at_ms + least(a + 5000, total) as end_ms, 'segment ' || (a // 5000 + 1) as text from s",
    "t5_nodes": "with l as (select * from (select *, row_number() over (partition by rel_path order by listed_at desc, local_size desc nulls last) as k from local_files) where k = 1), n as (select regexp_replace(rel_path, '/?[^/]*$', '') as folder, is_dir, string_split(rel_path, '/')[-1] as name from l) select * from n",
    "s23_etags": """select distinct change_id, '"' || coalesce(etag, '') || '&"' as found from manifest_feed""",
    "l5_mock_summaries": _FACTS + """select session_id, '# (mock) ' || scene || chr(10) || chr(10) || '- segments: ' || n || chr(10) || '- seconds: ' || s || chr(10) || case when coalesce(names, '') <> '' then '- speakers: ' || names || chr(10) else '' end as detailed,
  '# (mock) ' || scene || chr(10) || array_to_string(list_transform(range(1, least(n, 3) + 1), lambda i: '- point ' || i), chr(10)) as brief from f""",
    "l2_mock_mindmaps": _FACTS + "select session_id, least(n, 4) as issues, 0 as after, '- ' || scene || chr(10) || array_to_string(list_transform(range(1, least(n, 4) + 1), lambda i: '  - part ' || i || chr(10) || '    - [' || i || ']'), chr(10)) as outline from f",
}
