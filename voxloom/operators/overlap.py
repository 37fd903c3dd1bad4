"""Overlap of segments with speaker intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of slices, from the first on; an interval lies in slices of the first width that is at least a quarter of its length.
WIDTHS = (60_000, 3_600_000, 86_400_000)


def overlap_ms(start: str | Column, end: str | Column, other_start: str | Column, other_end: str | Column) -> Column:
    """Length of the common part of two intervals, 0 if there is none."""
    return F.greatest(F.least(end, other_end) - F.greatest(start, other_start), F.lit(0))


def overlap_by_speaker(segments: DataFrame, intervals: DataFrame, widths: Sequence[int] = WIDTHS) -> DataFrame:
    """(seg_id, speaker_id, common): how long each speaker's intervals overlap each segment, if at all.

    Rows without positive length or with nulls don't count, and copies of a segment
    or interval, by their ids, count once.

    Both sides are cut at multiples of a width and joined on (session, slice). An
    interval is cut at one width that suits its length, a segment at each, so a
    long interval has few slices, a slice of short ones holds few pairs, and a
    hot session is spread over its slices. A pair is counted in the slice in which
    its common part begins.
    """

    def slices(start: str, end: str, width: int) -> Column:
        return F.expr(f"sequence(({start} - pmod({start}, {width})) div {width}, ({end} - 1 - pmod({end} - 1, {width})) div {width})")

    def cut(df: DataFrame, at: Column) -> DataFrame:
        return df.where(F.col("end_ms") > F.col("start_ms")).withColumn("_at", F.explode(at))

    def levels(level: int) -> Column:
        return F.transform(slices("start_ms", "end_ms", widths[level]), lambda x: F.struct(F.lit(level).alias("level"), x.alias("slice")))

    all_levels = F.concat(*[levels(n) for n in range(len(widths))])
    length, suited = F.col("end_ms") - F.col("start_ms"), levels(len(widths) - 1)
    for n in range(len(widths) - 2, -1, -1):
        suited = F.when(length <= 4 * widths[n], levels(n)).otherwise(suited)
    left = cut(segments.select("session_id", "seg_id", "start_ms", "end_ms"), all_levels)
    right = intervals.where(F.col("speaker_id").isNotNull()).select("session_id", "interval_id", "start_ms", "end_ms", "speaker_id")
    right = cut(right, suited).withColumnsRenamed({"start_ms": "s", "end_ms": "e"})
    begins = F.greatest("start_ms", "s")
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("_at.level") + 1)
    pairs = left.join(right, ["session_id", "_at"]).where((F.col("s") < F.col("end_ms")) & (F.col("e") > F.col("start_ms")))
    pairs = pairs.where((begins - F.pmod(begins, width)) == F.col("_at.slice") * width)
    pairs = pairs.groupBy("seg_id", "interval_id", "speaker_id").agg(F.max(overlap_ms("start_ms", "end_ms", "s", "e")).alias("common"))
    return pairs.groupBy("seg_id", "speaker_id").agg(F.sum("common").alias("common"))


def assign_speaker(segments: DataFrame, intervals: DataFrame, contest: float = 0.75) -> DataFrame:
    """(seg_id, speaker_id, contested): who overlaps each segment longest, of equal ones the smallest id.

    contested: the second longest has more than contest of the longest. Segments
    that nobody overlaps are absent.
    """
    sums = overlap_by_speaker(segments, intervals)
    w = Window.partitionBy("seg_id").orderBy(F.desc("common"), "speaker_id")
    ranked = sums.withColumns({"_rank": F.row_number().over(w), "_second": F.lead("common").over(w)}).where("_rank = 1")
    ratio = (F.col("_second") / F.col("common")).cast("float")
    return ranked.select("seg_id", "speaker_id", F.coalesce(ratio > contest, F.lit(False)).alias("contested"))


def annotate_segments(segments: DataFrame, intervals: DataFrame) -> DataFrame:
    """segments, once per seg_id, with speaker_id and overlapped set from the intervals; null and false where nobody overlaps."""
    rest = [c for c in segments.columns if c not in ("speaker_id", "overlapped")]
    found = assign_speaker(segments, intervals).withColumnsRenamed({"contested": "overlapped"})
    rows = segments.select(*rest).dropDuplicates(["seg_id"]).join(found, "seg_id", "left")
    return rows.withColumn("overlapped", F.coalesce("overlapped", F.lit(False)))
