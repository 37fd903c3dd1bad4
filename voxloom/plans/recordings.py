"""Queries over segments, intervals, labels, vectors and sound, with SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.packing import pack_lines
from voxloom.functions.text import blank, estimate_tokens, format_srt, format_time, format_time_short, slugify
from voxloom.operators.listings import insert_missing, upsert
from voxloom.operators.overlap import annotate_segments, assign_speaker
from voxloom.operators.utterances import merge_utterances, numbered, render_dialogue, render_plain, render_srt, render_timeline, repair_timeline, with_names
from voxloom.operators.vectors import centroids, cluster_sessions, cluster_stats, cosine, identify
from voxloom.sources import table
from voxloom.sources.files import even_segments
from voxloom.sources.wav import duration_ms, peak, rms
from voxloom.streaming.streams import speech_sessions, talk_time

REFERENCE_VECTOR = [0.5, -0.5, 0.25, 0.25, -0.25, 0.5, 0.125, 0.125]


def w1_utterances(spark: SparkSession, d: str) -> DataFrame:
    return merge_utterances(table(spark, d, "segments"))


def w9_numbered(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered(w1_utterances(spark, d))
    return rows.select("session_id", "first_seg", "utt_no", F.floor((F.col("utt_no") - 1) / 20).alias("batch_no"))


def r1_dialogue(spark: SparkSession, d: str) -> DataFrame:
    return render_dialogue(w1_utterances(spark, d), table(spark, d, "speaker_labels")).drop("start_ms")


def r2_timeline(spark: SparkSession, d: str) -> DataFrame:
    return render_timeline(table(spark, d, "segments"), table(spark, d, "speaker_labels"))


def r3_plain(spark: SparkSession, d: str) -> DataFrame:
    return render_plain(w1_utterances(spark, d), table(spark, d, "speaker_labels")).drop("start_ms")


def r4_srt(spark: SparkSession, d: str) -> DataFrame:
    return render_srt(w1_utterances(spark, d), table(spark, d, "speaker_labels")).drop("start_ms")


def j1_assign_speaker(spark: SparkSession, d: str) -> DataFrame:
    return assign_speaker(table(spark, d, "segments"), table(spark, d, "speaker_intervals"))


def j2_annotate_segments(spark: SparkSession, d: str) -> DataFrame:
    return annotate_segments(table(spark, d, "segments"), table(spark, d, "speaker_intervals")).select("seg_id", "session_id", "start_ms", "speaker_id", "overlapped")


def j5_display_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").groupBy("session_id", "speaker_id").agg(F.count_distinct("seg_id").alias("segments"))
    return with_names(rows, table(spark, d, "speaker_labels"), unknown="—")


def j6_missing_labels(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "speaker_labels").select("session_id", "speaker_id", "display_name").groupBy("session_id", "speaker_id").agg(F.max("display_name").alias("display_name"))
    heard = table(spark, d, "segments").where("speaker_id is not null").select("session_id", "speaker_id")
    heard = heard.withColumn("display_name", F.concat(F.lit("Speaker "), (F.col("speaker_id") + 1).cast("string")))
    return insert_missing(have, heard, ["session_id", "speaker_id"])


def j10_sessions(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "transcripts").groupBy("session_id").agg(F.max("duration_ms").alias("duration_ms"), F.max(~blank("raw_text")).alias("has_text"))
    segments = table(spark, d, "segments").groupBy("session_id").agg(F.count_distinct("seg_id").alias("segments"), F.bool_or(F.col("speaker_id").isNotNull()).alias("has_speakers"))
    labels = table(spark, d, "speaker_labels").groupBy("session_id").agg(F.count_distinct("speaker_id").alias("labels"), F.max("labels_version").alias("labels_version"))
    out = heads.join(segments, "session_id", "left").join(labels, "session_id", "left")
    return out.fillna(0, ["segments", "labels"]).withColumn("has_speakers", F.coalesce("has_speakers", F.lit(False)))


def a1_speaker_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_intervals").where("speaker_id is not null").select("interval_id", "session_id", "speaker_id", "start_ms", "end_ms").distinct()
    spent = F.greatest(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(0))
    return rows.groupBy("session_id", "speaker_id").agg(F.sum(spent).alias("talk_time_ms"), F.count("*").alias("segment_count"))


def a3_talk_time(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").where("speaker_id is not null").select("seg_id", "session_id", "speaker_id", "start_ms", "end_ms", "overlapped").distinct()
    spent = F.greatest(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(0))
    return rows.groupBy("session_id", "speaker_id").agg(F.sum(spent).alias("talk_time_ms"), F.count("*").alias("segment_count"), F.count_if("overlapped").alias("overlapped_count"))


def a4_speaker_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_intervals").where("speaker_id is not null")
    return rows.groupBy("session_id").agg((F.max("speaker_id") + 1).alias("by_largest"), F.count_distinct("speaker_id").alias("by_distinct"))


def a5_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"), F.lit(0).cast("long").alias("start_ms"), (1000 + F.col("vec_id") % 20 * 500).alias("end_ms"), ((1 + F.col("vec_id") % 10) / 10).alias("quality"))
    out = centroids(rows, ["label"], "vec_id", 8)
    return out.select("label", "used", F.posexplode("centroid").alias("place", "x")).select("label", "used", "place", F.round("x", 5).alias("x"))


def j4_identify(spark: SparkSession, d: str) -> DataFrame:
    voices = table(spark, d, "voice_embeddings").dropDuplicates(["emb_id"]).select("session_id", "emb_id", "vector", "start_ms", "end_ms", "quality")
    sessions = centroids(voices, ["session_id"], "emb_id", 8)
    profiles = centroids(voices.withColumn("profile", F.left("session_id", F.lit(1))), ["profile"], "emb_id", 0, weighted=False)
    return identify(sessions, profiles, "session_id", "profile").select("session_id", "profile", F.round("similarity", 5).alias("similarity"), "confidence")


def f50_cosine(spark: SparkSession, d: str) -> DataFrame:
    other = F.array(*[F.lit(x) for x in REFERENCE_VECTOR])
    return table(spark, d, "voice_embeddings").select("emb_id", "vector").distinct().select("emb_id", (F.round(cosine("vector", other), 6) + 0.0).alias("similarity"))


def k2_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cluster_sessions(table(spark, d, "voice_embeddings"), 3)


def k1_auto(spark: SparkSession, d: str) -> DataFrame:
    return cluster_sessions(table(spark, d, "voice_embeddings"))


def a2_cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    """Talk time per cluster of the vectors, by an assignment as a table: here that of the first value's sign."""
    rows = table(spark, d, "voice_embeddings").dropDuplicates(["emb_id"])
    assigned = rows.select("emb_id", F.when(F.get("vector", F.lit(0)) > 0, 1).otherwise(0).cast("long").alias("cluster"))
    return cluster_stats(rows, assigned)


def w4_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("session_id", F.col("seg_id").alias("pos"), F.col("end_ms").alias("to_ms"), "text").distinct()
    return repair_timeline(rows).drop("text")


def w6_compact_ids(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "segments").where("speaker_id is not null").groupBy("session_id", "speaker_id").agg(F.min(F.struct("start_ms", "seg_id")).alias("_at"))
    return first.select("session_id", "speaker_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("_at")) - 1).alias("compact_id"))


def w13_packed(spark: SparkSession, d: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, n, len(x)) for s, t in zip(frame["session_id"], frame["raw_text"]) for n, x in enumerate(pack_lines(t))]
            yield pd.DataFrame(rows, columns=["session_id", "piece", "chars"])

    rows = table(spark, d, "transcripts").where("raw_text is not null").select("session_id", "raw_text").dropDuplicates(["session_id"])
    return rows.mapInPandas(run, "session_id string, piece int, chars int")


def f1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", estimate_tokens("text").alias("tokens"), F.length("text").alias("chars"))


def f4_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", slugify("url", 60).alias("slug"))


def f40_times(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("seg_id", "start_ms").distinct()
    return rows.select("seg_id", format_time("start_ms").alias("clock"), format_time_short("start_ms").alias("short"), format_srt("start_ms").alias("srt"))


def q1_upsert_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_labels").select(F.concat_ws("#", "session_id", "speaker_id").alias("id"), "labels_version", "display_name", "color").distinct()
    first = rows.groupBy("id").agg(F.min("labels_version").alias("v"), F.max("labels_version").alias("w"))
    rows = rows.join(first, "id")
    take = lambda which: rows.where(F.col("labels_version") == F.col(which)).groupBy("id").agg(*[F.max(c).alias(c) for c in ("labels_version", "display_name", "color")])
    return upsert(take("v"), take("w"), "id", keep=["color"])


def t1_newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcripts").select("session_id", "engine", F.unix_millis("created_at").alias("created_ms")).distinct()
    return rows.orderBy(F.desc("created_ms"), "session_id").limit(20)


def s29_even_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcripts").groupBy("session_id").agg(F.max("duration_ms").alias("duration_ms"))
    return rows.select("session_id", F.inline(even_segments("duration_ms", 60_000)))


def a19_sound(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audio_chunks").where("samples is not null").dropDuplicates(["session_id", "idx"])
    return rows.select("session_id", "idx", F.round(peak("samples").cast("double"), 5).alias("peak"), F.round(rms("samples"), 5).alias("rms"), duration_ms("samples", "sample_rate", "channels").alias("duration_ms"))


def st1_speech_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("session_id", "speaker_id", "seg_id", F.timestamp_millis("start_ms").alias("at"))
    out = speech_sessions(rows, "at", "60 seconds")
    return out.select("session_id", "speaker_id", F.unix_millis("start").alias("start_ms"), "segments")


def st2_talk_time(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("session_id", "speaker_id", "seg_id", "start_ms", "end_ms", F.timestamp_millis("start_ms").alias("at"))
    return talk_time(rows, "at").select("session_id", "speaker_id", F.unix_millis("start").alias("hour_ms"), "talk_ms", "segments")


_NAMES = "w1_utterances w9_numbered r1_dialogue r2_timeline r3_plain r4_srt j1_assign_speaker j2_annotate_segments j5_display_names j6_missing_labels j10_sessions a1_speaker_stats a3_talk_time a4_speaker_counts a5_centroids j4_identify f50_cosine k2_kmeans k1_auto a2_cluster_stats w4_timeline w6_compact_ids w13_packed f1_tokens f4_slugs f40_times q1_upsert_labels t1_newest_sessions s29_even_segments a19_sound st1_speech_sessions st2_talk_time"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_W = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(column: str) -> str:
    return f"regexp_replace({column}, '^{_W}+|{_W}+$', '', 'g')"


_SEG = f"""seg as (select distinct seg_id, session_id, start_ms, end_ms, speaker_id, text, coalesce(overlapped, false) as overlapped
  from segments where {_trim("text")} <> '')"""
_UTT = f"""
with recursive {_SEG},
s as (select seg_id, session_id, start_ms, coalesce(end_ms, start_ms) as end_ms, speaker_id, text, overlapped, row_number() over (partition by session_id order by start_ms, seg_id) as n from seg),
r as (
  select session_id, n, 1 as u, seg_id as first_seg, start_ms, end_ms, speaker_id, text, overlapped from s where n = 1
  union all
  select session_id, n, case when m then u else u + 1 end, case when m then first_seg else seg_id end, case when m then from_ms else start_ms end, end_ms, speaker_id,
    case when m then before || text else text end, case when m then was or overlapped else overlapped end
  from (select s.*, r.u, r.first_seg, r.start_ms as from_ms, r.text as before, r.overlapped as was,
      s.speaker_id is not distinct from r.speaker_id and greatest(s.start_ms - r.end_ms, 0) < 2500 and greatest(s.end_ms - r.start_ms, 0) <= 60000
      and length(r.text) + length(s.text) <= 200 and right(r.text, 1) not in ('。', '!', '?', '…', '.') as m
    from r join s on s.session_id = r.session_id and s.n = r.n + 1)),
utt as (select session_id, first_seg, start_ms, end_ms, speaker_id, text, overlapped from (
  select *, row_number() over (partition by session_id, u order by n desc) as k from r) where k = 1)"""
_LABELS = """top as (select session_id, max(labels_version) as v from speaker_labels group by session_id),
lab as (select l.session_id, l.speaker_id, max(display_name) as display_name from speaker_labels l join top t on l.session_id = t.session_id and l.labels_version = t.v group by all)"""
_NAME = "case when x.speaker_id is null then {0} else coalesce(lab.display_name, '说话人 ' || (x.speaker_id + 1)) end"
_JOIN = "left join lab on lab.session_id = x.session_id and lab.speaker_id = x.speaker_id"
_CLOCK = "lpad(({0} // 3600000)::varchar, greatest(2, length(({0} // 3600000)::varchar))::int, '0') || ':' || lpad(({0} // 60000 % 60)::varchar, 2, '0') || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0')"
_SHORT = "case when {0} >= 3600000 then " + _CLOCK + " else lpad(({0} // 60000)::varchar, 2, '0') || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0') end"
_SRT = _CLOCK + " || ',' || lpad(({0} % 1000)::varchar, 3, '0')"
_PAIRS = """pairs as (select s.seg_id, i.speaker_id, sum(least(s.end_ms, i.end_ms) - greatest(s.start_ms, i.start_ms)) as common
  from (select distinct seg_id, session_id, start_ms, end_ms from segments) s
  join (select distinct interval_id, session_id, start_ms, end_ms, speaker_id from speaker_intervals) i
    on s.session_id = i.session_id and s.start_ms < i.end_ms and i.start_ms < s.end_ms and s.end_ms > s.start_ms and i.end_ms > i.start_ms
  where i.speaker_id is not null group by all),
best as (select seg_id, speaker_id, coalesce((second::double / common)::float > 0.75, false) as contested from (
  select *, row_number() over w as k, lead(common) over w as second from pairs window w as (partition by seg_id order by common desc, speaker_id)) where k = 1)"""
_CENTRE = """select {k}, max(used) as used, list(x order by place) as v from (
  select {k}, place, sum(v * w) / sum(w) as x, count(*) as used from (
    select {k}, unnest({v})::double as v, unnest(range(0, len({v}))) as place, w from ({rows})) group by all) group by all"""
_WEIGHT = "greatest(coalesce({q}, 0)::double, 0.001) * sqrt(greatest(least(coalesce({e} - {s}, 0) / 1000.0, 60.0), 0.5))"
_UNIT = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
_VOICES = "(select distinct on (emb_id) * from voice_embeddings where vector is not null)"
_LEN = "greatest(length({0}), 1)"

ORACLE = {
    "w1_utterances": _UTT + " select * from utt",
    "w9_numbered": _UTT + ", n as (select session_id, first_seg, row_number() over (partition by session_id order by start_ms, first_seg) as utt_no from utt) select *, (utt_no - 1) // 20 as batch_no from n",
    "r1_dialogue": _UTT + f", {_LABELS} select x.session_id, first_seg, '[' || {_SHORT.format('start_ms')} || '] ' || {_NAME.format(chr(39) + '—' + chr(39))} || case when overlapped then ' ⟂' else '' end || ':' || chr(10) || {_trim('text')} as block from utt x {_JOIN}",
    "r2_timeline": f"with {_SEG}, {_LABELS} select x.session_id, seg_id, '[' || {_CLOCK.format('start_ms')} || ' - ' || {_CLOCK.format('coalesce(end_ms, start_ms)')} || '] ' || case when overlapped then '⟂' else ' ' end || ' ' || rpad(nm, greatest(6, length(nm))::int, ' ') || ' ' || {_trim('text')} as block from (select x.*, {_NAME.format(chr(39) + '—' + chr(39))} as nm from seg x {_JOIN}) x",
    "r3_plain": _UTT + f", {_LABELS} select x.session_id, first_seg, coalesce({_NAME.format('null')} || ':', '') || {_trim('text')} as block from utt x {_JOIN}",
    "r4_srt": _UTT + f", {_LABELS}, n as (select *, row_number() over (partition by session_id order by start_ms, first_seg) as no from utt) select x.session_id, first_seg, no || chr(10) || {_SRT.format('start_ms')} || ' --> ' || {_SRT.format('end_ms')} || chr(10) || coalesce({_NAME.format('null')} || ':', '') || {_trim('text')} as block from n x {_JOIN}",
    "j1_assign_speaker": f"with {_PAIRS} select * from best",
    "j2_annotate_segments": f"with {_PAIRS} select s.seg_id, s.session_id, s.start_ms, b.speaker_id, coalesce(b.contested, false) as overlapped from (select distinct seg_id, session_id, start_ms from segments) s left join best b using (seg_id)",
    "j5_display_names": f"with {_LABELS}, x as (select session_id, speaker_id, count(distinct seg_id) as segments from segments group by all) select x.session_id, x.speaker_id, segments, {_NAME.format(chr(39) + '—' + chr(39))} as name from x {_JOIN}",
    "j6_missing_labels": "with h as (select session_id, speaker_id, max(display_name) as display_name from speaker_labels group by all) select * from h union all select distinct session_id, speaker_id, 'Speaker ' || (speaker_id + 1) from segments s where speaker_id is not null and not exists (select 1 from h where h.session_id = s.session_id and h.speaker_id = s.speaker_id)",
    "j10_sessions": f"""select t.session_id, t.duration_ms, t.has_text, coalesce(s.segments, 0) as segments, coalesce(s.has_speakers, false) as has_speakers, coalesce(l.labels, 0) as labels, l.labels_version
from (select session_id, max(duration_ms) as duration_ms, bool_or(coalesce({_trim("raw_text")}, '') <> '') as has_text from transcripts group by 1) t
left join (select session_id, count(distinct seg_id) as segments, bool_or(speaker_id is not null) as has_speakers from segments group by 1) s using (session_id)
left join (select session_id, count(distinct speaker_id) as labels, max(labels_version) as labels_version from speaker_labels group by 1) l using (session_id)""",
    "a1_speaker_stats": "select session_id, speaker_id, sum(greatest(coalesce(end_ms - start_ms, 0), 0)) as talk_time_ms, count(*) as segment_count from (select distinct interval_id, session_id, speaker_id, start_ms, end_ms from speaker_intervals where speaker_id is not null) group by all",
    "a3_talk_time": "select session_id, speaker_id, sum(greatest(coalesce(end_ms - start_ms, 0), 0)) as talk_time_ms, count(*) as segment_count, count_if(overlapped) as overlapped_count from (select distinct seg_id, session_id, speaker_id, start_ms, end_ms, overlapped from segments where speaker_id is not null) group by all",
    "a4_speaker_counts": "select session_id, max(speaker_id) + 1 as by_largest, count(distinct speaker_id) as by_distinct from speaker_intervals where speaker_id is not null group by 1",
    "a5_centroids": "select label, used, unnest(range(0, len(v))) as place, round(unnest(" + _UNIT + "), 5) as x from (" + _CENTRE.format(k="label", v="embedding", rows="select *, " + _WEIGHT.format(q="((1 + vec_id % 10) / 10)", s="0", e="(1000 + vec_id % 20 * 500)") + " as w from (select *, row_number() over (partition by label order by (1 + vec_id % 10) desc, vec_id) as k from embeddings) where k <= 8") + ")",
    "j4_identify": f"with c as (select session_id, {_UNIT} as v from (" + _CENTRE.format(k="session_id", v="vector", rows="select *, " + _WEIGHT.format(q="quality", s="start_ms", e="end_ms") + " as w from (select *, row_number() over (partition by session_id order by coalesce(quality, 0) desc, emb_id) as k, arg_min(len(vector), emb_id) over (partition by session_id) as n from " + _VOICES + ") where k <= 8 and len(vector) = n") + f")), p as (select profile, {_UNIT} as v from (" + _CENTRE.format(k="profile", v="vector", rows="select *, left(session_id, 1) as profile, 1.0 as w, arg_min(len(vector), emb_id) over (partition by left(session_id, 1)) as n from " + _VOICES + " qualify len(vector) = n") + ")), u as (select * from c where list_sum(list_transform(v, lambda y: y * y)) > 0.5), m as (select session_id, profile, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * p.v[i])) as s from u c join p on len(c.v) = len(p.v)), b as (select *, row_number() over (partition by session_id order by s desc, profile) as k from m), r as (select u.session_id, b.profile, coalesce(b.s, 0) as s from u left join b on b.session_id = u.session_id and k = 1) select session_id, case when s >= 0.55 then profile end as profile, round(s, 5) as similarity, case when s >= 0.72 then 'confirmed' when s >= 0.55 then 'uncertain' else 'new' end as confidence from r",
    "a2_cluster_stats": "with e as (select distinct on (emb_id) *, case when vector[1] > 0 then 1 else 0 end as cluster from voice_embeddings) select session_id, cluster, sum(greatest(coalesce(end_ms - start_ms, 0), 0)) as talk_time_ms, count(*) as segment_count from e group by all",
    "f50_cosine": f"with r as (select {REFERENCE_VECTOR}::double[] as q), x as (select distinct emb_id, vector::double[] as v from voice_embeddings) select emb_id, round(case when len(v) = 8 and list_sum(list_transform(v, lambda y: y * y)) > 1e-13 then greatest(-1.0, least(1.0, list_sum(list_transform(range(1, 9), lambda i: v[i] * q[i])) / sqrt(list_sum(list_transform(v, lambda y: y * y))) / sqrt(list_sum(list_transform(q, lambda y: y * y))))) else 0.0 end, 6) + 0.0 as similarity from x, r",
    "w4_timeline": f"""with s as (select distinct session_id, seg_id as pos, greatest(coalesce(end_ms, 0), 0) as end_ms, length({_trim("text")}) as n from segments where {_trim("text")} <> ''),
l as (select *, coalesce(lag(end_ms) over (partition by session_id order by pos), 0) as start_ms from s),
w as (select session_id, bool_and(end_ms > start_ms) as fine, max(end_ms) as all_ms, sum(n) as sizes from l group by 1),
x as (select l.*, fine, all_ms, greatest(floor(n::double / sizes::double * all_ms::double + 0.5), 1)::bigint as share from l join w using (session_id)),
y as (select *, sum(share) over (partition by session_id order by pos) as upto from x)
select session_id, pos, case when fine then start_ms else least(all_ms, upto - share) end as start_ms, case when fine then end_ms else least(all_ms, upto) end as end_ms from y where all_ms > 0""",
    "w6_compact_ids": "select session_id, speaker_id, row_number() over (partition by session_id order by s, g) - 1 as compact_id from (select session_id, speaker_id, min(start_ms) as s, arg_min(seg_id, (start_ms, seg_id)) as g from segments where speaker_id is not null group by all)",
    "f1_tokens": r"select doc_id, w + ceil((length(text) - w) / 4.0)::bigint as tokens, length(text) as chars from (select doc_id, text, length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]', '', 'g')) as w from documents)",
    "f4_slugs": r"""select doc_id, case when s = '' then 'untitled' else s end as slug from (select doc_id, trim(left(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(url, ''), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), '\.+$', ''), 60)) as s from documents)""",
    "f40_times": f"select seg_id, {_CLOCK.format('start_ms')} as clock, {_SHORT.format('start_ms')} as short, {_SRT.format('start_ms')} as srt from (select distinct seg_id, start_ms from segments)",
    "q1_upsert_labels": "with r as (select session_id || '#' || speaker_id as id, labels_version, display_name, color, min(labels_version) over w as v, max(labels_version) over w as u from speaker_labels window w as (partition by session_id, speaker_id)) select id, max(labels_version) filter (labels_version = u) as labels_version, max(display_name) filter (labels_version = u) as display_name, max(color) filter (labels_version = v) as color from r group by id",
    "t1_newest_sessions": "select distinct session_id, engine, epoch_ms(created_at) as created_ms from transcripts order by created_ms desc, session_id limit 20",
    "s29_even_segments": "select session_id, s as start_ms, least(s + 60000, n) as end_ms from (select session_id, n, unnest(range(0, n, 60000)) as s from (select session_id, max(duration_ms) as n from transcripts group by 1) where n > 0)",
    "a19_sound": "select session_id, idx, round(coalesce(list_max(list_transform(samples, lambda v: abs(v)))::double, 0), 5) as peak, round(case when len(samples) > 0 then sqrt(list_sum(list_transform(samples, lambda v: v::double * v::double)) / len(samples)) else 0 end, 5) as rms, case when sample_rate > 0 and channels > 0 then len(samples) // channels * 1000 // sample_rate else 0 end as duration_ms from (select distinct on (session_id, idx) * from audio_chunks where samples is not null)",
    "st1_speech_sessions": "with s as (select distinct seg_id, session_id, speaker_id, start_ms from segments), l as (select *, case when start_ms - lag(start_ms) over w < 60000 then 0 else 1 end as new from s window w as (partition by session_id, speaker_id order by start_ms)), g as (select *, sum(new) over (partition by session_id, speaker_id order by start_ms) as k from l) select session_id, speaker_id, min(start_ms) as start_ms, count(*) as segments from g group by session_id, speaker_id, k",
    "st2_talk_time": "select session_id, speaker_id, start_ms // 3600000 * 3600000 as hour_ms, sum(greatest(coalesce(end_ms - start_ms, 0), 0)) as talk_ms, count(*) as segments from (select distinct seg_id, session_id, speaker_id, start_ms, end_ms from segments where speaker_id is not null) group by all",
}
