"""Corrections of segments by a model's answers, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import correction_accepted, numbered_lines, trim_white
from voxloom.operators.scan import SLICE_MS, running_sum, sliced

BATCH = 20  # fixed value: segments that are sent at once


def batches(segments: DataFrame, size: int = BATCH, width: int = SLICE_MS) -> DataFrame:
    """(session_id, batch, prompt, segments, parts): the segments of each session by start_ms and seg_id, size at a time, as numbered lines.

    parts holds (no, seg_id, text) of each; a batch has at most size of them.
    Segments with a null session, start or text are left out.
    """
    rows = segments.where(F.col("session_id").isNotNull() & F.col("start_ms").isNotNull() & F.col("text").isNotNull())
    rows = sliced(rows.select("session_id", "seg_id", "start_ms", "text", F.lit(1).cast("long").alias("_one")), ["session_id"], "start_ms", width)
    rows = running_sum(rows, ["session_id"], ["start_ms", "seg_id"], "_one", "_n")
    rows = rows.select("session_id", F.expr(f"(_n - 1) div {int(size)}").alias("batch"), (F.col("_n") - F.expr(f"(_n - 1) div {int(size)}") * size).cast("int").alias("no"), "seg_id", "text")
    parts = F.array_sort(F.collect_list(F.struct("no", "seg_id", "text")))
    out = rows.groupBy("session_id", "batch").agg(parts.alias("parts"), F.count("*").alias("segments"))
    prompt = F.array_join(F.transform("parts", lambda p: F.concat(p["no"].cast("string"), F.lit(". "), p["text"])), "\n")
    return out.select("session_id", "batch", prompt.alias("prompt"), "segments", "parts")


def apply_replies(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """(session_id, batch, seg_id, text, changed, outcome): segments with the corrections that can be trusted.

    replies: (session_id, batch, reply) of numbered lines, one a batch. outcome of a
    batch: failed without a reply; mismatch if the reply has another number of lines
    than the batch, which then stays as it is; applied if any of its segments
    changes; else unchanged. A segment changes if its line is neither blank nor the
    same and not much shorter or longer than before.
    """
    rows = batched.join(replies.select("session_id", "batch", "reply"), ["session_id", "batch"], "left")
    rows = rows.withColumn("_lines", numbered_lines("reply"))
    fits = F.coalesce(F.size("_lines") == F.col("segments"), F.lit(False))
    new = F.when(fits, F.transform("parts", lambda p, i: F.struct(p["seg_id"].alias("seg_id"), p["text"].alias("old"), trim_white(F.get("_lines", i)).alias("new"))))
    new = F.coalesce(new, F.transform("parts", lambda p: F.struct(p["seg_id"].alias("seg_id"), p["text"].alias("old"), F.lit(None).cast("string").alias("new"))))
    good = lambda x: correction_accepted(x["old"], x["new"]) & (x["new"] != trim_white(x["old"]))
    rows = rows.withColumn("_new", F.transform(new, lambda x: F.struct(x["seg_id"].alias("seg_id"), F.when(good(x), x["new"]).otherwise(x["old"]).alias("text"), F.coalesce(good(x), F.lit(False)).alias("changed"))))
    outcome = F.when(F.col("reply").isNull(), "failed").when(~fits, "mismatch").when(F.exists("_new", lambda x: x["changed"]), "applied").otherwise("unchanged")
    return rows.select("session_id", "batch", F.inline("_new"), outcome.alias("outcome"))


def correction_stats(applied: DataFrame) -> DataFrame:
    """One row: batches, applied, unchanged, mismatch, failed (batches) and changed (segments)."""
    per_batch = applied.groupBy("session_id", "batch").agg(F.max("outcome").alias("outcome"), F.count_if("changed").alias("_n"))
    kinds = [F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "unchanged", "mismatch", "failed")]
    return per_batch.agg(F.count("*").alias("batches"), *kinds, F.coalesce(F.sum("_n"), F.lit(0)).alias("changed"))
