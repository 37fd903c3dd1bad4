"""Queries p1, p2, p5, p7, p8 and p9 over the project tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.encode import count_tokens, decoded, encode_texts
from voxloom.llm.mixing import mixture
from voxloom.llm.nearest import nearest_by_ticks
from voxloom.llm.pieces import STOPS, WHITE, pieces
from voxloom.llm.quality import text_quality
from voxloom.llm.turns import spoken_segments, turns
from voxloom.session import materialize
from voxloom.sources import table


def _spoken(spark: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    return spoken_segments(table(spark, d, "segments"), table(spark, d, "speaker_labels"), table(spark, d, "speaker_intervals"), with_text)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return turns(_spoken(spark, d)).select("session_id", "speaker_id", "first_seg", "last_seg")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(_spoken(spark, d, True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rights = {"interval": (table(spark, d, "speaker_intervals"), "interval_id"), "embedding": (table(spark, d, "voice_embeddings"), "emb_id")}
    return nearest_by_ticks(table(spark, d, "segments"), rights).select("seg_id", "match_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("piece = 0").select("item", "session_id", "idx", "forced")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces(table(spark, d, "transcripts"), table(spark, d, "audio_chunks"))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each item cut: whether its pieces are numbered without holes, cover it, keep to the limit and repeat what they should, and whether cuts in words are forced ones."""
    cut = p5_pieces(spark, d)
    size = F.when(F.col("item") == "text", F.lit(4000)).otherwise(F.col("_limit"))
    repeat = F.when(F.col("item") == "text", F.lit(200)).otherwise(F.floor(F.col("_limit") / 30))
    texts = table(spark, d, "transcripts").select("session_id", "raw_text").dropDuplicates(["session_id"])
    texts = texts.select(F.lit("text").alias("item"), "session_id", F.lit(-1).cast("long").alias("idx"), F.length("raw_text").cast("long").alias("_n"), F.lit(None).cast("long").alias("_limit"), F.col("raw_text").alias("_text"))
    sound = table(spark, d, "audio_chunks").where("sample_rate > 0 and samples is not null").dropDuplicates(["session_id", "idx"])
    sound = sound.select(F.lit("audio").alias("item"), "session_id", "idx", F.floor(F.size("samples") / F.col("channels")).alias("_n"), (F.col("sample_rate").cast("long") * 30).alias("_limit"), F.lit(None).cast("string").alias("_text"))
    parts = F.array_sort(F.collect_list(F.struct("piece", "start_at", "end_at")))
    rows = cut.groupBy("item", "session_id", "idx", "forced").agg(parts.alias("p")).join(texts.unionByName(sound), ["item", "session_id", "idx"])
    last, n = F.element_at("p", -1), F.size("p")
    pairs = F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n - 1), lambda a, b: b["start_at"] == F.greatest(a["end_at"] - repeat, F.lit(0)))
    inside = lambda x: F.substring(F.col("_text"), x["end_at"].cast("int"), F.lit(2)).rlike(f"^[^{WHITE}{STOPS}]{{2}}$")
    torn = F.exists(F.slice("p", 1, n - 1), inside)
    return rows.select(
        "item", "session_id", "idx", F.forall("p", lambda x: x["piece"] < n).alias("numbered"), ((F.element_at("p", 1)["start_at"] == 0) & (last["end_at"] == F.col("_n"))).alias("covered"),
        F.forall("p", lambda x: x["end_at"] - x["start_at"] <= size).alias("within"), F.forall(pairs, lambda x: x).alias("repeated"), (F.coalesce(torn, F.lit(False)) & (F.col("forced") == 0) & ~F.coalesce(F.col("_text").rlike(f"[^{WHITE}{STOPS}]{{3801}}"), F.lit(False))).alias("torn"),
    )


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, how many ids it has none of, and whether they give its text again."""
    rows = encode_texts(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", (decoded("ids") == F.coalesce("text", F.lit(""))).alias("same"), (F.size("ids") == 0).alias("none"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each target: whether no document occurs too often, and the tokens of its documents."""
    mix, report = _mixture(spark, d)
    times = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("repeat").alias("r"))
    times = times.groupBy("source").agg(F.max("n").alias("most"), F.bool_and(F.col("r") == F.col("n") - 1).alias("in_row"))
    rows = report.join(times, "source", "left")
    fair = (F.abs(F.col("actual_share") - F.col("target_share")) < 0.02) | (F.col("actual_tokens") > 0.98 * F.col("available_tokens") * F.col("max_repeats")) | (F.col("actual_share") > F.col("target_share"))
    return rows.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("kept"), F.coalesce("in_row", F.lit(True)).alias("in_row"), fair.alias("fair"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = materialize(count_tokens(table(spark, d, "documents").select("doc_id", "source", "text")), "token-counts")
    return mixture(counted, table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_turns, p2_found, p5_found, p5_pieces, p5_checked, p7_ids, p7_round_trip, p8_mixture, p8_shares, p8_checked, p9_found, p9_statistics)}

_NEAR = """
select seg_id, match_id from (
  select s.seg_id, r.id as match_id, row_number() over (partition by s.seg_id order by abs(r.t - s.start_ms), r.t, r.id) as rn
  from (select distinct session_id, seg_id, start_ms from segments) s
  join (select distinct session_id, start_ms as t, {id} as id from {table} where start_ms is not null) r
    on r.session_id = s.session_id and r.t between s.start_ms - 1000 and s.start_ms + 1000)
where rn = 1"""

_LONG = """with c as (
  select 'text' as item, session_id, -1 as idx from transcripts where length(raw_text) > 4000
  union select 'audio', session_id, idx from audio_chunks where sample_rate > 0 and len(samples) // channels > 30 * sample_rate)
"""

ORACLE = {
    "p2_found": _NEAR.format(id="interval_id", table="speaker_intervals") + " union all " + _NEAR.format(id="emb_id", table="voice_embeddings"),
    "p5_found": r"""
select distinct 'text' as item, session_id, -1 as idx,
  (list_max(list_transform(string_split_regex(raw_text, '[\x09-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?…。！？]'), lambda x: length(x))) > 4000)::int as forced
from transcripts where length(raw_text) > 4000
union all
select distinct 'audio', session_id, idx, (list_max(list_transform(string_split_regex(
    regexp_replace(array_to_string(list_transform(range(0, len(samples) // channels), lambda f:
      case when list_max(list_transform(samples[f * channels + 1 : (f + 1) * channels], lambda v: abs(v))) <= 0.02 then 'q' else 'x' end), ''),
      'q{' || (sample_rate // 5) || ',}', 'B', 'g'), 'B'), lambda x: length(x))) > 30 * sample_rate)::int
from audio_chunks where sample_rate > 0 and len(samples) // channels > 30 * sample_rate""",
    "p5_checked": _LONG + "select item, session_id, idx, true as numbered, true as covered, true as within, true as repeated, false as torn from c",
    "p7_round_trip": "select doc_id, true as same, coalesce(text, '') = '' as none from documents",
    "p8_checked": "select lower(trim(source)) as source, round(weight / sum(weight) over (), 9) as target_share, max_repeats, true as kept, true as in_row, true as fair from mix_targets",
}
