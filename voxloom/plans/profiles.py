"""Queries over profiles of voices, their samples, and tables kept by key, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.operators import profiles
from voxloom.operators.listings import exists, lookup, update, upsert
from voxloom.sources import table


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Voice vectors as samples of a profile by the first two digits of their session; the first two of their number tell the session apart, so that keys collide."""
    rows = table(spark, d, "voice_embeddings").dropDuplicates(["emb_id"])
    return rows.select(
        F.concat(F.lit("p_"), F.left("session_id", F.lit(2))).alias("profile_id"), F.left("session_id", F.lit(4)).alias("session_id"), (F.expr("start_ms div 60000") * 60000).alias("start_ms"),
        F.expr("start_ms div 60000 * 60000 + (end_ms - start_ms) * 2").alias("end_ms"), "quality", "vector", "emb_id",
    )


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return profiles.enroll(_samples(spark, d).where("size(vector) = 8"))


def p5_acceptable(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).withColumn("ok", profiles.acceptable())
    return rows.groupBy("profile_id").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


def k4_enroll(spark: SparkSession, d: str) -> DataFrame:
    rows = _stored(spark, d)
    return rows.select("sample_id", "profile_id", "session_id", F.round("quality", 5).alias("quality"), "duration_ms", F.round("weight", 5).alias("weight"))


def a7_profile_centroids(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.profile_centroids(_stored(spark, d))
    return out.select("profile_id", "used", "sample_count", F.posexplode("centroid").alias("place", "x")).withColumn("x", F.round("x", 4) + 0.0)


def q26_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    samples = _stored(spark, d).select("sample_id", "profile_id")
    people = samples.select("profile_id").distinct()
    gone = people.where("profile_id < 'p_80'")
    kept, rest = profiles.delete_profiles(people, samples, gone)
    return kept.select("profile_id", F.lit("").alias("sample_id")).unionByName(rest)


def q28_profile_stats(spark: SparkSession, d: str) -> DataFrame:
    people = _samples(spark, d).select("profile_id").distinct()
    return profiles.profile_stats(people, _stored(spark, d).where("quality > 0.5"))


def q19_usable_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "voice_embeddings").dropDuplicates(["emb_id"])
    people = rows.select(F.col("emb_id").cast("string").alias("profile_id"), F.col("vector").alias("centroid"), F.when(F.col("pos") % 3 == 0, "old").otherwise("new").alias("embedding_model"))
    usable, stale = profiles.usable_profiles(people, "new")
    return usable.select("profile_id", F.lit(0).cast("long").alias("stale")).unionByName(stale.select(F.lit("").alias("profile_id"), "stale"))


def q1_upsert_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of which the second half of devices saves a new state: model, title and language change; when and where they began stays."""
    rows = table(spark, d, "transcripts").groupBy("session_id").agg(*[F.max(c).alias(c) for c in ("created_at", "origin_device", "model", "spoken_language", "duration_ms")])
    rows = rows.withColumn("created_ms", F.unix_millis("created_at")).drop("created_at")
    later = rows.where("duration_ms is not null").select(
        F.when(F.col("duration_ms") % 4 == 0, F.concat(F.lit("new-"), F.left("session_id", F.lit(8)))).otherwise(F.col("session_id")).alias("session_id"),
        (F.col("created_ms") + 1).alias("created_ms"), F.lit("dev-x").alias("origin_device"), F.lit("m2").alias("model"), "spoken_language", (F.col("duration_ms") + 5).alias("duration_ms"),
    )
    later = later.groupBy("session_id").agg(*[F.max(c).alias(c) for c in ("created_ms", "origin_device", "model", "spoken_language", "duration_ms")])
    return upsert(rows, later, "session_id", keep=["created_ms", "origin_device"])


def q14_chunks_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audio_chunks").groupBy("session_id", "idx").agg(F.max("start_ms").alias("start_ms"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.coalesce("idx", F.lit(-1))))
    return rows.withColumn("place", place)


def q15_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of four tables by key, in one row."""
    keys = {"transcripts": "session_id", "segments": "seg_id", "speaker_intervals": "interval_id", "voice_embeddings": "emb_id"}
    rows = None
    for name, key in keys.items():
        one = table(spark, d, name).select(key).distinct().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in keys])


def p24_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """For beginnings of session ids: the one session they mean, or how many."""
    rows = table(spark, d, "transcripts").select("session_id").distinct()
    out = rows.select(F.explode(F.transform(F.array(*[F.lit(n) for n in (2, 3, 64)]), lambda n: F.left("session_id", n))).alias("prefix"), "session_id")
    return out.groupBy("prefix").agg(F.count("*").alias("sessions"), F.when(F.count("*") == 1, F.max("session_id")).alias("session_id"))


def m9_renamed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels after a change of names: those that are there and differ change, and the version of their session rises by one for each."""
    from voxloom.operators.utterances import newest_labels

    rows = newest_labels(table(spark, d, "speaker_labels"))
    wish = F.when(F.col("speaker_id") % 2 == 0, F.concat(F.lit("Guest "), F.col("speaker_id").cast("string"))).otherwise(F.col("display_name"))
    changed = F.coalesce(F.col("display_name") != wish, F.lit(False))
    versions = table(spark, d, "speaker_labels").groupBy("session_id").agg(F.max("labels_version").alias("labels_version"))
    more = rows.groupBy("session_id").agg(F.count_if(changed).alias("_n"))
    rows = rows.withColumn("display_name", F.when(changed, wish).otherwise(F.col("display_name")))
    return rows.join(versions.join(more, "session_id").select("session_id", (F.col("labels_version") + F.col("_n")).alias("labels_version")), "session_id")


def q2_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Heads of the sessions that are asked for: those with labels."""
    asked = table(spark, d, "speaker_labels").select("session_id").distinct()
    return lookup(table(spark, d, "transcripts").select("session_id", "engine", "model", "duration_ms").distinct(), asked, "session_id")


def q5_exists(spark: SparkSession, d: str) -> DataFrame:
    """Of each session with segments, whether it has labels."""
    asked = table(spark, d, "segments").select("session_id").distinct()
    return exists(asked, table(spark, d, "speaker_labels"), "session_id")


def q3_updates(spark: SparkSession, d: str) -> DataFrame:
    """Heads with the engine and model that sessions with labels get."""
    rows = table(spark, d, "transcripts").select("session_id", "engine", "model").distinct()
    changes = table(spark, d, "speaker_labels").groupBy("session_id").agg(F.lit("done").alias("engine"), F.max("color").alias("model"))
    return update(rows, changes, "session_id")


def q8_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings by key, after changes."""
    rows = table(spark, d, "manifest_feed").where("origin is not null and rel_path is not null")
    now = rows.where("change_id % 2 = 0").groupBy(F.col("origin").alias("key")).agg(F.max("rel_path").alias("value"))
    new = rows.where("change_id % 2 = 1 and origin > 'dev-l'").groupBy(F.concat("origin", F.when(F.col("origin") > "dev-p", "-2").otherwise("")).alias("key")).agg(F.min("rel_path").alias("value"))
    return upsert(now, new, "key")


def q27_profiles_by_time(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "voice_embeddings").groupBy(F.left("session_id", F.lit(2)).alias("profile_id")).agg(F.max(F.unix_micros("ingested_at")).alias("updated_us"))
    return rows.orderBy(F.desc("updated_us"), "profile_id")


_NAMES = "q2_lookups q5_exists q3_updates q8_settings q27_profiles_by_time p5_acceptable k4_enroll a7_profile_centroids q26_delete_cascade q28_profile_stats q19_usable_profiles q1_upsert_sessions q14_chunks_in_order q15_counts p24_prefixes m9_renamed_labels"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_S = """with e as (select distinct on (emb_id) * from voice_embeddings),
s as (select 'p_' || left(session_id, 2) as profile_id, left(session_id, 4) as session_id, start_ms // 60000 * 60000 as start_ms, (end_ms - start_ms) * 2 as len, quality, vector from e),
ok as (select *, coalesce(len >= 3000 and quality > 0 and len(vector) > 0, false) as ok from s)"""
_STORED = _S + """, st as (select * from (select profile_id || '-' || session_id || '-' || start_ms as sample_id, profile_id, session_id, vector, quality::double as quality, len as duration_ms, greatest(quality::double, 0.001) * sqrt(len / 1000.0) as weight,
  row_number() over (partition by profile_id, session_id, start_ms order by quality desc, len desc, vector desc) as k from ok where ok and len(vector) = 8) where k = 1)"""
_NEWEST = "n as (select session_id, speaker_id, max(display_name) as display_name, max(v) as v from (select *, max(labels_version) over (partition by session_id) as v from speaker_labels) where labels_version = v group by 1, 2)"

ORACLE = {
    "p5_acceptable": _S + " select profile_id, count(*) filter (ok) as accepted, count(*) filter (not ok) as rejected from ok group by 1",
    "k4_enroll": _STORED + " select sample_id, profile_id, session_id, round(quality, 5) as quality, duration_ms, round(weight, 5) as weight from st",
    "a7_profile_centroids": _STORED + """, b as (select *, row_number() over (partition by profile_id order by quality desc, sample_id) as r, count(*) over (partition by profile_id) as n from st),
u as (select profile_id, n, greatest(quality, 0.001) * sqrt(greatest(least(duration_ms / 1000.0, 60.0), 0.5)) as w, case when list_sum(list_transform(vector, lambda y: y::double * y::double)) > 1e-13 then list_transform(vector, lambda x: x::double / sqrt(list_sum(list_transform(vector, lambda y: y::double * y::double)))) else vector::double[] end as v from b where r <= 8),
x as (select profile_id, n, w, unnest(v) as v, unnest(range(0, 8)) as place from u),
c as (select profile_id, place, max(n) as sample_count, count(*) as used, sum(v * w) / sum(w) as x from x group by 1, 2)
select profile_id, used, sample_count, place, round(x / sqrt(sum(x * x) over (partition by profile_id)), 4) + 0.0 as x from c""",
    "q26_delete_cascade": _STORED + " select distinct profile_id, '' as sample_id from st where profile_id >= 'p_80' union all select profile_id, sample_id from st where profile_id >= 'p_80'",
    "q28_profile_stats": _STORED + " select p.profile_id, count(st.sample_id) as samples, coalesce(sum(st.duration_ms), 0)::bigint as duration_ms from (select distinct profile_id from s) p left join st on st.profile_id = p.profile_id and st.quality > 0.5 group by 1",
    "q19_usable_profiles": "with e as (select distinct on (emb_id) * from voice_embeddings) select emb_id::varchar as profile_id, 0 as stale from e where (pos % 3 <> 0 or pos is null) and len(vector) > 0 union all select '', count(*) from e where pos % 3 = 0",
    "q1_upsert_sessions": """with t as (select session_id, max(origin_device) as origin_device, max(model) as model, max(spoken_language) as spoken_language, max(duration_ms) as duration_ms, epoch_ms(max(created_at)) as created_ms from transcripts group by 1),
l as (select case when duration_ms % 4 = 0 then 'new-' || left(session_id, 8) else session_id end as session_id, max(created_ms) + 1 as created_ms, 'dev-x' as origin_device, 'm2' as model, max(spoken_language) as spoken_language, max(duration_ms) + 5 as duration_ms from t where duration_ms is not null group by 1)
select coalesce(t.session_id, l.session_id) as session_id, case when t.session_id is null then l.origin_device else t.origin_device end as origin_device, case when l.session_id is null then t.model else l.model end as model,
  case when l.session_id is null then t.spoken_language else l.spoken_language end as spoken_language, case when l.session_id is null then t.duration_ms else l.duration_ms end as duration_ms, case when t.session_id is null then l.created_ms else t.created_ms end as created_ms
from t full join l on t.session_id = l.session_id""",
    "q14_chunks_in_order": "select session_id, idx, max(start_ms) as start_ms, row_number() over (partition by session_id order by coalesce(idx, -1)) as place from audio_chunks group by 1, 2",
    "q15_counts": "select (select count(distinct session_id) from transcripts) as transcripts, (select count(distinct seg_id) from segments) as segments, (select count(distinct interval_id) from speaker_intervals) as speaker_intervals, (select count(distinct emb_id) from voice_embeddings) as voice_embeddings",
    "p24_prefixes": "select prefix, count(*) as sessions, case when count(*) = 1 then max(session_id) end as session_id from (select session_id, left(session_id, unnest([2, 3, 64])) as prefix from (select distinct session_id from transcripts)) group by 1",
    "m9_renamed_labels": "with " + _NEWEST + ", c as (select *, coalesce(speaker_id % 2 = 0 and display_name <> 'Guest ' || speaker_id, false) as changed from n) select session_id, speaker_id, case when changed then 'Guest ' || speaker_id else display_name end as display_name, v + count(*) filter (changed) over (partition by session_id) as labels_version from c",
    "q2_lookups": "select distinct session_id, engine, model, duration_ms from transcripts where session_id in (select session_id from speaker_labels)",
    "q5_exists": "select distinct session_id, session_id in (select session_id from speaker_labels) as found from segments",
    "q3_updates": "with c as (select session_id, max(color) as color from speaker_labels group by 1) select distinct t.session_id, case when c.session_id is null then engine else 'done' end as engine, case when c.session_id is null then model else color end as model from transcripts t left join c on c.session_id = t.session_id",
    "q8_settings": "with n as (select origin as key, max(rel_path) as value from manifest_feed where origin is not null and rel_path is not null and change_id % 2 = 0 group by 1), u as (select origin || case when origin > 'dev-p' then '-2' else '' end as key, min(rel_path) as value from manifest_feed where rel_path is not null and change_id % 2 = 1 and origin > 'dev-l' group by 1) select coalesce(u.key, n.key) as key, case when u.key is null then n.value else u.value end as value from n full join u on n.key = u.key",
    "q27_profiles_by_time": "select left(session_id, 2) as profile_id, max(epoch_us(ingested_at)) as updated_us from voice_embeddings group by 1 order by updated_us desc, profile_id",
}
