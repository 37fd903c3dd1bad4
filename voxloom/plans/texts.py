"""Queries over texts, keys, answers of models, sound and parsed formats, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import diagrams
from voxloom.functions import text as T
from voxloom.operators import correction
from voxloom.operators.utterances import documents_of, merge_utterances, render
from voxloom.sources import table
from voxloom.sources.files import dav_listing, recognised_segments
from voxloom.sources.wav import cuts_of, decode_wav, encode_wav, resampled, sliced_ms, to_mono


def f2_scene_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("session_id", "raw_text").distinct().select("session_id", T.scene_sample("raw_text").alias("sample"))


LESSON = ("lesson", "garden", "the hinge", "forêt", "Felder")
TALK = ("folder", "notebook", "signal", "parcel", "marché")


def f3_guessed_scene(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.guessed_scene(F.coalesce("text", F.lit("")), LESSON, TALK).alias("x")).select("doc_id", "x.scene", "x.confidence")


def f7_short_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_labels").select("display_name", "session_id").distinct()
    return rows.select("session_id", "display_name", T.short_id("session_id").alias("short"), T.masked("display_name").alias("masked"), T.shortened("display_name", 9).alias("cut"))


def f11_split_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "url")
    return rows.select("doc_id", T.split_service_url("url", ["/dav", "/docs"]).alias("x")).select("doc_id", "x.base", "x.folder")


def f12_joined_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "local_files").select("rel_path").distinct()
    odd = F.when(F.length("rel_path") % 4 == 0, F.concat(F.lit("/"), "rel_path")).when(F.length("rel_path") % 4 == 1, F.concat("rel_path", F.lit("/../x"))).otherwise(F.col("rel_path"))
    return rows.select("rel_path", T.joined_path(F.lit("/dav/ /root/"), "rel_path", F.lit("")).alias("joined"), T.safe_path(odd).alias("safe"))


def _diagrams(spark: SparkSession, d: str) -> DataFrame:
    """A mind map a session, from its labels; every third node lacks an id."""
    rows = table(spark, d, "speaker_labels").select("session_id", "speaker_id").distinct()
    s = F.col("speaker_id").cast("string")
    node = F.when(F.col("speaker_id") % 3 == 0, F.concat(F.lit("    ((S "), s, F.lit("))"))).when(F.col("speaker_id") % 3 == 1, F.concat(F.lit("    a"), s, F.lit("[S "), s, F.lit("]"))).otherwise(F.concat(F.lit("    S "), s))
    nodes = F.array_sort(F.collect_list(F.struct("speaker_id", node.alias("line"))))
    text = F.concat(F.lit("mindmap\n  root((map))\n"), F.array_join(F.transform("nodes", lambda n: n["line"]), "\n"))
    return rows.groupBy("session_id").agg(nodes.alias("nodes")).select("session_id", text.alias("text"))


def f16_diagram_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = _diagrams(spark, d).select("session_id", diagrams.issues_of("text").alias("found"), diagrams.issues_of(diagrams.repaired("text")).alias("left"))
    return rows.select("session_id", F.array_join("found", ",").alias("found"), F.size("left").alias("after_repair"))


def f20_outlines(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("```mermaid\nHere you are:\n"), "text", F.lit("\n```\nanything else?"))
    rows = _diagrams(spark, d).withColumn("got", diagrams.extracted(answer))
    return rows.select("session_id", (F.col("got") == F.col("text")).alias("extracted"), diagrams.outline_of("got").alias("outline"), diagrams.outline_of(diagrams.repaired("got")).alias("of_repaired"))


LOW_CONFIDENCE = 0.6  # fixed value: below it a verdict is uncertain


def f81_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("seg_id").distinct()
    kind = F.when(F.col("seg_id") % 3 == 0, "Meeting").when(F.col("seg_id") % 3 == 1, "party").otherwise("lecture ")
    sure = F.when(F.col("seg_id") % 4 == 0, "").otherwise(F.concat(F.lit(',"confidence":'), (F.col("seg_id") % 4 - 1).cast("string"), F.lit(".25")))
    json = F.concat(F.lit('{"scene":"'), kind, F.lit('"'), sure, F.lit(',"evidence":"{a \\" }'), F.col("seg_id").cast("string"), F.lit('","x":{"y":1}}'))
    answer = F.when(F.col("seg_id") % 5 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(F.col("seg_id") % 5 == 1, F.concat(F.lit("Sure: "), json, F.lit(" {"))).when(F.col("seg_id") % 5 == 2, F.lit("{ no")).otherwise(json)
    return rows.withColumn("v", diagrams.scene_verdict(answer)).select("seg_id", "v.scene", F.round("v.confidence", 2).cast("double").alias("confidence"), (F.col("v.confidence") < LOW_CONFIDENCE).alias("low"), "v.evidence")


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("session_id", "seg_id", "start_ms", T.trim_white(F.regexp_replace("text", r"[\r\n\x0b\x0c\x85  ]+", " ")).alias("text")).where("text <> ''").distinct()
    batched = correction.batches(rows)
    line = lambda p, x: F.concat(p["no"].cast("string"), F.lit(". "), x)
    joined = lambda f: F.array_join(F.transform("parts", f), "\n")
    kind = F.col("batch") % 5
    reply = F.when(kind == 0, F.col("prompt")).when(kind == 1, joined(lambda p: line(p, F.concat(p["text"], F.lit(" !")))))
    reply = reply.when(kind == 2, F.array_join(F.slice(F.split("prompt", "\n"), 1, F.col("segments").cast("int") - 1), "\n")).when(kind == 3, joined(lambda p: line(p, F.repeat(p["text"], F.lit(4)))))
    return correction.apply_replies(batched, batched.select("session_id", "batch", reply.alias("reply")))


def f29_corrections(spark: SparkSession, d: str) -> DataFrame:
    return _corrected(spark, d).select("session_id", "batch", "seg_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "changed", "outcome")


def a17_correction_stats(spark: SparkSession, d: str) -> DataFrame:
    return correction.correction_stats(_corrected(spark, d))


def f23_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("seg_id").distinct()
    n = F.col("seg_id") % 150
    line = F.when(n % 7 == 0, F.lit("done 5%")).otherwise(F.concat(F.lit("callback: progress = "), n.cast("string"), F.when(n % 5 == 0, "").otherwise("%")))
    return rows.select("seg_id", T.progress_share(line).alias("share"), T.slice_total(F.concat(F.lit("x processing processing "), F.when(n % 3 == 0, "").otherwise(n.cast("string")), F.lit(" slice(s)"))).alias("slices"))


def f43_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcripts").select("session_id", "duration_ms", F.unix_millis("created_at").alias("ms")).distinct()
    return rows.select("session_id", T.format_length("duration_ms").alias("length"), T.spoken_length("duration_ms").alias("words"), T.format_day("ms").alias("day"), T.format_minute("ms").alias("minute"))


def f70_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("raw_bytes", 256).alias("hash"))


def f71_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcripts").groupBy("session_id").agg(*[F.max(c).alias(c) for c in ("model", "backend", "spoken_language", "backend_diarize", "duration_ms")])
    n = F.coalesce("duration_ms", F.lit(7))
    key = T.transcript_key(
        "session_id", F.coalesce("model", F.lit("-")), F.coalesce("backend", F.lit("cpu")), "spoken_language", F.col("backend_diarize").isNotNull(), "backend_diarize",
        F.when(n % 3 == 0, n % 8), F.lit(True), n * 7919 % 4294967296, F.when(n % 2 == 0, n % 1000),
    )
    return rows.select("session_id", key.alias("key"), T.diarize_key("session_id", F.lit("seg"), F.lit("emb"), F.coalesce("backend", F.lit("cpu"))).alias("diarize"))


def f73_words_version(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_labels").groupBy("session_id").agg(F.array_sort(F.collect_set("display_name")).alias("words"))
    return rows.select("session_id", T.words_version("words").alias("version"), T.prompt_of("words", "Names follow", 40).alias("prompt"))


def s21_dav_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as DAV texts, one for each first letter of a name, and read back."""
    rows = table(spark, d, "local_files").groupBy("rel_path").agg(F.max_by(F.struct("is_dir", "local_size", "content_hash"), F.struct("listed_at", "local_size")).alias("x")).select("rel_path", "x.*")
    node = F.concat(
        F.lit("<D:response><D:href>/dav/"), T.encode_path("rel_path"), F.when(F.col("is_dir"), "/").otherwise(""), F.lit("</D:href><D:propstat><D:prop><D:resourcetype>"),
        F.when(F.col("is_dir"), "<D:collection/>").otherwise(""), F.lit("</D:resourcetype>"), F.coalesce(F.concat(F.lit("<D:getcontentlength> "), F.col("local_size").cast("string"), F.lit("</D:getcontentlength>")), F.lit("")),
        F.coalesce(F.concat(F.lit("<D:getetag>&quot;"), "content_hash", F.lit("&quot;</D:getetag>")), F.lit("")), F.lit("</D:prop></D:propstat></D:response>"),
    )
    texts = rows.groupBy(F.sha2("rel_path", 256).substr(1, 2).alias("part")).agg(F.concat(F.lit('<?xml version="1.0"?><D:multistatus xmlns:D="DAV:">'), F.array_join(F.collect_list(node), "\n"), F.lit("</D:multistatus>")).alias("xml"))
    return dav_listing(texts, "xml", "/dav").select("rel_path", "is_dir", "size_bytes", F.replace("etag", F.lit('"'), F.lit("")).alias("etag"))


def s19_recognised(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as a recogniser's JSON, one for each minute, and read back."""
    rows = table(spark, d, "segments").select("session_id", "seg_id", "start_ms", "end_ms", "text").distinct()
    minute = F.expr("start_ms div 60000")
    piece = F.struct(F.struct((F.col("start_ms") - minute * 60000).alias("from"), (F.col("end_ms") - minute * 60000).alias("to")).alias("offsets"), "text", F.col("seg_id").alias("chunk_id"))
    texts = rows.groupBy("session_id", minute.alias("minute")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("start_ms", piece.alias("p")))).alias("all"))).alias("json"))
    texts = texts.select("session_id", "minute", F.to_json(F.struct(F.from_json("json", "all array<struct<p: struct<offsets: struct<`from`: long, `to`: long>, text: string, chunk_id: long>>>")["all"]["p"].alias("transcription"))).alias("json"))
    found = texts.select("session_id", F.inline(recognised_segments("json", F.col("minute") * 60000)))
    return found.select("session_id", F.col("chunk_id").alias("seg_id"), "start_ms", "end_ms")


def _sound(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_chunks").where("size(samples) > 0 and sample_rate > 0 and channels > 0").groupBy("session_id", "idx").agg(F.max(F.struct("sample_rate", "channels", "samples")).alias("x")).select("session_id", "idx", "x.*")


def _measure(x: str) -> list[Column]:
    return [F.size(x).alias("values"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 3).alias("total"), F.round(F.element_at(x, -1).cast("double"), 5).alias("last")]


def s1_wav_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sound written as WAV files of 16 bits and read back."""
    rows = _sound(spark, d).withColumn("file", encode_wav("samples", "sample_rate", "channels")).withColumn("y", decode_wav("file"))
    rows = rows.select("session_id", "idx", F.length("file").alias("bytes"), "y.sample_rate", "y.channels", F.col("y.samples").alias("z"))
    return rows.select("session_id", "idx", "bytes", "sample_rate", "channels", *_measure("z"))


def f53_mono(spark: SparkSession, d: str) -> DataFrame:
    return _sound(spark, d).withColumn("y", to_mono("samples", "channels")).where("size(y) > 0").select("session_id", "idx", *_measure("y"))


def f54_resampled(spark: SparkSession, d: str) -> DataFrame:
    return _sound(spark, d).withColumn("y", resampled("samples", "sample_rate", F.col("sample_rate") * 3 / 4)).where("size(y) > 0").select("session_id", "idx", *_measure("y"))


def f55_sliced(spark: SparkSession, d: str) -> DataFrame:
    return _sound(spark, d).withColumn("y", sliced_ms("samples", "sample_rate", "channels", F.lit(1500), F.lit(9250))).where("size(y) > 0").select("session_id", "idx", *_measure("y"))


def w10_planned_cuts(spark: SparkSession, d: str) -> DataFrame:
    rows = _sound(spark, d).withColumn("cuts", cuts_of(to_mono("samples", "channels"), "sample_rate", 10_000))
    return rows.select("session_id", "idx", F.posexplode("cuts").alias("piece", "x")).select("session_id", "idx", "piece", "x.start_ms", "x.end_ms")


def r5_documents(spark: SparkSession, d: str) -> DataFrame:
    """The dialogue of each session as one text, or as numbered parts of at most about a million characters."""
    blocks = render("dialogue", table(spark, d, "segments"), table(spark, d, "speaker_labels"))
    out = documents_of(blocks, "\n\n")
    return out.select("session_id", "part", "blocks", F.length("text").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


def a9_plain_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").where("start_ms is not null and text is not null").select("session_id", F.col("seg_id").alias("first_seg"), "start_ms", F.col("text").alias("block")).distinct()
    return documents_of(rows, "", 20_000).select("session_id", "part", "blocks", F.length("text").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


_NAMES = "f2_scene_samples f3_guessed_scene f7_short_texts f11_split_urls f12_joined_paths f16_diagram_issues f20_outlines f81_verdicts f29_corrections a17_correction_stats f23_progress f43_lengths f70_content_hash f71_cache_keys f73_words_version s21_dav_listing s19_recognised s1_wav_round_trip f53_mono f54_resampled f55_sliced w10_planned_cuts r5_documents a9_plain_text"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_W = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COUNT = lambda words: " + ".join("contains(t, '" + w + "')::int" for w in words)
_NODES = "n as (select distinct session_id, speaker_id as s from speaker_labels), r as (select *, row_number() over (partition by session_id order by s) + 2 as line from n)"
_BATCH = f"""x as (select distinct session_id, seg_id, start_ms, regexp_replace(regexp_replace(text, '[\\r\\n\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'), '^{_W}+|{_W}+$', '', 'g') as text from segments),
b as (select *, (row_number() over (partition by session_id order by start_ms, seg_id) - 1) // 20 as batch from x where text <> ''),
c as (select *, case batch % 5 when 0 then 'unchanged' when 1 then 'applied' when 2 then 'mismatch' when 3 then 'unchanged' else 'failed' end as outcome from b)"""
_SOUND = "w as (select * from (select *, row_number() over (partition by session_id, idx order by sample_rate desc, channels desc, samples desc) as k from audio_chunks where len(samples) > 0 and sample_rate > 0 and channels > 0) where k = 1)"
_TOTALS = "select session_id, idx, len(y) as values, round(list_sum(list_transform(y, lambda v: v::double)), 3) as total, round(y[-1]::double, 5) as last from z where len(y) > 0"
_HEX4 = "unhex(substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2))"


def _documents(blocks: str, between: str, limit: int) -> str:
    return f"""{blocks}, o as (select *, sum(length(block) + {len(between)}) over (partition by session_id order by start_ms, first_seg) - length(block) - {len(between)} as before from blocks),
p as (select *, before // {limit} as part from o)
select session_id, part, count(*) as blocks, length(string_agg(block, '{between}' order by start_ms, first_seg)) as chars, md5(string_agg(block, '{between}' order by start_ms, first_seg)) as digest from p group by 1, 2"""


def _dialogue() -> str:
    from voxloom.plans import recordings

    inner = recordings.ORACLE["r1_dialogue"].replace("select x.session_id, first_seg,", "select x.session_id, first_seg, start_ms,")
    head, _, last = inner.rpartition(" select x.session_id, first_seg, start_ms,")
    return f"{head}, blocks as (select x.session_id, first_seg, start_ms,{last})"


ORACLE = {
    "f2_scene_samples": "select distinct session_id, case when length(raw_text) <= 2100 then raw_text else '[start]' || chr(10) || left(raw_text, 700) || chr(10) || chr(10) || '[middle]' || chr(10) || substring(raw_text, length(raw_text) // 2 - 350 + 1, 700) || chr(10) || chr(10) || '[end]' || chr(10) || right(raw_text, 700) end as sample from transcripts",
    "f3_guessed_scene": f"with c as (select doc_id, {_COUNT(LESSON)} as a, {_COUNT(TALK)} as b from (select doc_id, coalesce(text, '') as t from documents)) select doc_id, case when a = 0 and b = 0 then 'other' when a >= b then 'lecture' else 'meeting' end as scene, case when a = 0 and b = 0 then 0.3 else round(0.7 + 0.05 * greatest(a, b), 2) end::double as confidence from c",
    "f7_short_texts": "select distinct session_id, display_name, left(session_id, 8) as short, case when length(display_name) <= 8 then repeat('*', greatest(length(display_name), 1)) else left(display_name, 4) || '****' || right(display_name, 4) end as masked, case when length(display_name) <= 9 then display_name else left(display_name, 8) || '…' end as cut from speaker_labels",
    "f11_split_urls": """with u as (select doc_id, regexp_replace(trim(url), '/+$', '') as u from documents), p as (select doc_id, regexp_extract(u, '^(https?://[^/]+)', 1) as host, regexp_extract(u, '^https?://[^/]+(/.*)$', 1) as path from u),
k as (select *, regexp_extract(path, '^(.*(?:/dav|/docs))', 1) as known, len(list_filter(string_split(path, '/'), lambda s: s <> '')) as parts from p),
c as (select *, case when known <> '' then known when parts >= 2 then regexp_replace(path, '[^/]+$', '') end as cut from k),
f as (select *, trim(trim(substr(path, length(cut) + 1), '/')) as folder from c)
select doc_id, case when host <> '' and cut is not null and folder <> '' then host || regexp_replace(cut, '/+$', '') end as base, case when host <> '' and cut is not null and folder <> '' then folder end as folder from f""",
    "f12_joined_paths": "select distinct rel_path, 'dav/root/' || array_to_string(list_filter(string_split(rel_path, '/'), lambda p: trim(p) <> ''), '/') as joined, case when length(rel_path) % 4 in (0, 1) then null else rel_path end as safe from local_files",
    "f16_diagram_issues": f"with {_NODES} select session_id, coalesce(string_agg('line ' || line, ',' order by s) filter (s % 3 = 0), '') as found, 0 as after_repair from r group by 1",
    "f20_outlines": f"with {_NODES} select session_id, true as extracted, '- map' || chr(10) || string_agg('  - S ' || s, chr(10) order by s) as outline, '- map' || chr(10) || string_agg('  - S ' || s, chr(10) order by s) as of_repaired from r group by 1",
    "f81_verdicts": """select distinct seg_id, case when seg_id % 5 = 2 then null when seg_id % 3 = 0 then 'meeting' when seg_id % 3 = 1 then 'other' else 'lecture' end as scene,
  case when seg_id % 5 = 2 then null when seg_id % 4 = 0 then 0.5 else least(seg_id % 4 - 1 + 0.25, 1.0) end::double as confidence, case when seg_id % 5 <> 2 then seg_id % 4 <= 1 end as low, case when seg_id % 5 <> 2 then '{a " }' || seg_id end as evidence from segments""",
    "f29_corrections": f"with {_BATCH} select session_id, batch, seg_id, md5(case when outcome = 'applied' then text || ' !' else text end) as digest, outcome = 'applied' as changed, outcome from c",
    "a17_correction_stats": f"with {_BATCH}, d as (select distinct session_id, batch, outcome from c) select count(*) as batches, count(*) filter (outcome = 'applied') as applied, count(*) filter (outcome = 'unchanged') as unchanged, count(*) filter (outcome = 'mismatch') as mismatch, count(*) filter (outcome = 'failed') as failed, (select count(*) from c where outcome = 'applied') as changed from d",
    "f23_progress": "select distinct seg_id, case when seg_id % 150 % 7 <> 0 and seg_id % 150 % 5 <> 0 then least((seg_id % 150) / 100.0, 1.0) end::double as share, case when seg_id % 150 % 3 <> 0 then null end::bigint as slices from segments",
    "f43_lengths": """with t as (select distinct session_id, duration_ms // 1000 as s, epoch_ms(created_at) // 60000 * 60 as secs from transcripts)
select session_id, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) when s is not null then printf('%d:%02d', s // 60, s % 60) end as length,
  case when s < 60 then 'about ' || s || ' s' when s < 3600 then 'about ' || s // 60 || ' min' when s % 3600 < 60 then 'about ' || s // 3600 || ' h' else 'about ' || s // 3600 || ' h ' || s % 3600 // 60 || ' min' end as words,
  strftime(make_timestamp(secs * 1000000), '%Y-%m-%d') as day, strftime(make_timestamp(secs * 1000000), '%Y-%m-%d %H:%M') as minute from t""",
    "f70_content_hash": "select doc_id, sha256(raw_bytes) as hash from documents",
    "f71_cache_keys": f"""with t as (select session_id, coalesce(max(model), '-') as model, coalesce(max(backend), 'cpu') as backend, coalesce(max(spoken_language), 'auto') as lang, max(backend_diarize) as bd, coalesce(max(duration_ms), 7) as n from transcripts group by 1),
h as (select *, printf('%08X', n * 7919 % 4294967296) as w, case when n % 2 = 0 then printf('%08X', n % 1000) else 'FFFFFFFF' end as c from t)
select session_id, sha256(encode(session_id || '|' || model || '|' || backend || '|' || lang || '|') || unhex(case when bd is not null then '01' else '00' end) || encode('|' || coalesce(bd, '-') || '|' || case when n % 3 = 0 then 'fixed' || n % 8 else 'auto' end || '|') || unhex('01') || encode('|')
  || {_HEX4.format("w")} || encode('|') || {_HEX4.format("c")}) as key, sha256(session_id || '|diarize|seg|emb|' || backend) as diarize from h""",
    "f73_words_version": f"""with w as (select session_id, list_sort(list(distinct display_name) filter (display_name is not null)) as words from speaker_labels group by 1),
h as (select *, substr(sha256(array_to_string(words, chr(10)) || chr(10)), 1, 8) as h from w)
select session_id, case when len(words) > 0 then ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint else 0 end as version, left(case when len(words) > 0 and array_to_string(words, ', ') <> '' then 'Names follow. ' || array_to_string(words, ', ') else 'Names follow' end, 40) as prompt from h""",
    "s21_dav_listing": "select rel_path, is_dir, case when not is_dir then local_size end as size_bytes, content_hash as etag from (select *, row_number() over (partition by rel_path order by listed_at desc, local_size desc nulls last) as k from local_files) where k = 1",
    "s19_recognised": f"select distinct session_id, seg_id, start_ms, greatest(coalesce(end_ms, start_ms // 60000 * 60000), start_ms) as end_ms from segments where regexp_replace(text, '^ +| +$', '', 'g') <> ''",
    "s1_wav_round_trip": f"with {_SOUND}, z as (select session_id, idx, sample_rate, channels, list_transform(samples, lambda v: trunc(greatest(-1.0, least(1.0, v::double)) * 32767) / 32768) as y from w) select session_id, idx, 44 + 2 * len(y) as bytes, sample_rate, channels, len(y) as values, round(list_sum(y), 3) as total, round(y[-1], 5) as last from z",
    "f53_mono": f"with {_SOUND}, z as (select session_id, idx, list_transform(range(0, len(samples) // channels), lambda f: list_sum(list_transform(samples[f * channels + 1 : (f + 1) * channels], lambda v: v::double)) / channels) as y from w) {_TOTALS}",
    "f54_resampled": f"""with {_SOUND}, q as (select session_id, idx, samples, sample_rate::double / (sample_rate * 3 / 4.0) as step, round(len(samples) * ((sample_rate * 3 / 4.0) / sample_rate::double))::bigint as n from w),
z as (select session_id, idx, list_transform(range(0, n), lambda i: case when floor(i * step)::bigint + 1 < len(samples) then (samples[floor(i * step)::bigint + 1]::double + (samples[floor(i * step)::bigint + 2]::double - samples[floor(i * step)::bigint + 1]::double) * (i * step - floor(i * step))) else samples[-1]::double end) as y from q) {_TOTALS}""",
    "f55_sliced": f"with {_SOUND}, z as (select session_id, idx, samples[1500 * sample_rate // 1000 * channels + 1 : least(9250 * sample_rate // 1000 * channels, len(samples))] as y from w) {_TOTALS}",
    "r5_documents": _documents(_dialogue(), "\n\n", 1_000_000),
    "a9_plain_text": _documents("with blocks as (select distinct session_id, seg_id as first_seg, start_ms, text as block from segments where start_ms is not null and text is not null)", "", 20_000),
}
