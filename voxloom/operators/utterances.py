"""Utterances from segments, timelines, and lines of the views of a transcript."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.text import blank, format_srt, format_time, format_time_short, trim_white
from voxloom.operators.scan import SLICE_MS, Fields, along, carried, once, runs, running_sum, salted_join, sliced, throughout, up_to

K = ["session_id"]
ORDER = ["start_ms", "seg_id"]
TERMINATORS = "。!?…."  # fixed values: signs after which an utterance ends


def ends_sentence(text: str | Column, signs: str = TERMINATORS) -> Column:
    """Whether the last character is one of signs; nothing is trimmed."""
    return F.coalesce(F.right(F.col(text) if isinstance(text, str) else text, F.lit(1)).isin(*signs), F.lit(False))


BLOCK = 4096  # segments of a run that are folded at once

_UTTERANCE = "session_id string, first_seg long, start_ms long, end_ms long, speaker_id long, text string, overlapped boolean"


class Caps:
    """Greedy utterances of segments that follow each other in a run: as long and as wordy as allowed."""

    def __init__(self, max_duration: int, max_chars: int):
        self.max_duration, self.max_chars = max_duration, max_chars

    def ends(self, starts: list[int], ends: list[int], sizes: list[int], first: int, single: bool) -> list[int]:
        """For a segment, where an utterance that begins there ends; for all, or only for those that one from first on leads to (single)."""
        out, n, at = [0] * len(starts), len(starts), first
        while at < n:
            end, size, start = at + 1, sizes[at], starts[at]
            while end < n and ends[end] - start <= self.max_duration and size + sizes[end] <= self.max_chars:
                size += sizes[end]
                end += 1
            out[at] = end
            at = end if single else at + 1
        return out

    def utterances(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those of each block (session_id, speaker_id, parts, entry, own) from entry on that begin among its own segments."""
        for batch in batches:
            session, speaker, parts, entries, owns = (batch.column(i) for i in range(5))
            offsets, flat = parts.offsets.to_pylist(), parts.values
            seg, start, end, text, over = (flat.field(n).to_pylist() for n in ("seg_id", "start_ms", "end_ms", "text", "overlapped"))
            sizes = pc.utf8_length(flat.field("text")).to_pylist()
            at, rows = [], []
            for n, (entry, own) in enumerate(zip(entries.to_pylist(), owns.to_pylist())):
                a, b = offsets[n], offsets[n + 1]
                until = self.ends(start[a:b], end[a:b], sizes[a:b], entry, True)
                while entry < min(own, b - a):
                    x, y = a + entry, a + until[entry]
                    at.append(n)
                    rows.append((seg[x], start[x], end[y - 1], "".join(text[x:y]), any(over[x:y])))
                    entry = until[entry]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([session.take(at), *columns[:3], speaker.take(at), *columns[3:]], [f.split()[0] for f in _UTTERANCE.split(", ")])

    def exits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, for an utterance that begins at each of its first max_chars segments, where one begins in the next block."""
        for batch in batches:
            parts, found = batch.column(3), []
            offsets, flat = parts.offsets.to_pylist(), parts.values
            start, end = (flat.field(n).to_pylist() for n in ("start_ms", "end_ms"))
            sizes = pc.utf8_length(flat.field("text")).to_pylist()
            for n, own in enumerate(batch.column(4).to_pylist()):
                a, b = offsets[n], offsets[n + 1]
                until = self.ends(start[a:b], end[a:b], sizes[a:b], 0, False)
                here = min(own, b - a)
                for i in range(here - 1, -1, -1):
                    until[i] = until[until[i]] if until[i] < here else until[i]
                found.append([x - own for x in until[: self.max_chars]])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.list_(pa.int64()))], ["session_id", "_run", "_block", "exits"])


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order: the entry of each follows from that of the one before."""
    now, entry = None, 0
    for frame in frames:
        found = []
        for session, run, exits in zip(frame["session_id"], frame["_run"], frame["exits"]):
            run = (session, tuple(run.values()) if isinstance(run, dict) else tuple(run))
            now, entry = run, entry if run == now else 0
            found.append(entry)
            entry = int(exits[entry]) if entry < len(exits) else 0
        yield frame[["session_id", "_run", "_block"]].assign(entry=found)


def merge_utterances(
    segments: DataFrame, max_gap: int = 2500, max_duration: int = 60_000, max_chars: int = 200, width: int = SLICE_MS, block: int = BLOCK
) -> DataFrame:
    """(session_id, first_seg, start_ms, end_ms, speaker_id, text, overlapped): consecutive segments of one speaker joined.

    Segments, once per session, start and seg_id, are taken by start_ms and seg_id;
    those with blank or null text, or a null start, are skipped, a null end counts
    as the start. A segment joins the utterance before it if the speaker is the
    same (null equals null), it starts less than max_gap after its end, the whole
    lasts at most max_duration and has at most max_chars characters, and the text
    so far ends in none of TERMINATORS. Texts are joined without a separator.

    Speaker, gap and terminator depend on the segment before only. They cut a
    session into runs, found along slices of time, so a hot session is spread. The
    caps depend on all of an utterance; they are applied to blocks of a run. A run
    of more than one block, say an hour without pause or full stop, is folded block
    by block: each block, with the max_chars segments behind it, tells where an
    utterance that enters it at any place leaves it, which gives the place where
    each block is entered. So no task holds more than a block of a run.
    """
    block = max(block, max_chars)
    rows = segments.where(F.col("start_ms").isNotNull() & F.col("session_id").isNotNull() & ~blank("text"))
    rows = rows.select(*K, *ORDER, F.coalesce("end_ms", "start_ms").alias("end_ms"), "speaker_id", "text", F.coalesce("overlapped", F.lit(False)).alias("overlapped"))
    rows = once(sliced(rows, K, "start_ms", width), [*K, "_slice", *ORDER])

    def starts(before: Fields, row: Fields) -> Column:
        near = F.greatest(row["start_ms"] - before["end_ms"], F.lit(0)) < max_gap
        # Cases rather than a disjunction of three, whose order differs between copies of a plan, so that exchanges would not be reused.
        return F.when(~row["speaker_id"].eqNullSafe(before["speaker_id"]), True).when(near, ends_sentence(before["text"])).otherwise(True)

    rows = runs(rows, K, ORDER, starts, "_run", "_place")
    own = F.coalesce(F.expr(f"_place div {block}"), F.lit(0).cast("long"))
    both = F.when((own > 0) & (F.col("_place") % block < max_chars), F.array(own, own - 1)).otherwise(F.array(own))
    parts = F.array_sort(F.collect_list(F.struct("_place", "seg_id", "start_ms", "end_ms", "text", "overlapped")))
    keys = [*K, "_run", "_block"]
    rows = rows.withColumns({"session_id": F.coalesce("session_id", F.lit("")), "_block": F.explode(both)})  # keys that can't be null: see slice_of
    blocks = rows.groupBy(*keys).agg(F.max("speaker_id").alias("speaker_id"), parts.alias("parts"), F.max("_place").alias("_upto"))
    blocks = blocks.withColumn("own", F.greatest(F.lit(block).cast("long"), F.least("_upto", F.lit(0))))  # block; both readers of the exchange use all of it

    caps = Caps(max_duration, max_chars)
    run_type = blocks.schema["_run"].dataType.simpleString()
    long = blocks.where(F.greatest(F.col("_block") * block, F.col("_upto")) >= block)  # of runs of more than one block
    exits = long.select(*keys, "parts", "own", "speaker_id").mapInArrow(caps.exits, f"session_id string, _run {run_type}, _block long, exits array<long>")
    exits = exits.repartition(*K, "_run").sortWithinPartitions(*keys)
    entries = exits.mapInPandas(_entries, f"session_id string, _run {run_type}, _block long, entry long")
    entered = blocks.join(entries, keys, "left").select("session_id", "speaker_id", "parts", F.coalesce("entry", F.lit(0)).alias("entry"), "own")
    return entered.mapInArrow(caps.utterances, _UTTERANCE)


def numbered(utterances: DataFrame, name: str = "utt_no", width: int = SLICE_MS) -> DataFrame:
    """Utterances with their number in the session, from 1."""
    rows = sliced(utterances.withColumn("_one", F.lit(1).cast("long")), K, "start_ms", width)
    return running_sum(rows, K, ["start_ms", "first_seg"], "_one", name).drop("_one", "_slice")


def newest_labels(labels: DataFrame) -> DataFrame:
    """(session_id, speaker_id, display_name) of the highest labels_version of each session."""
    versions = labels.groupBy("session_id", "labels_version", "speaker_id").agg(F.max("display_name").alias("display_name"))
    newest = F.max("labels_version").over(Window.partitionBy("session_id"))
    return versions.withColumn("_v", newest).where("labels_version = _v").select("session_id", "speaker_id", "display_name")


def with_names(df: DataFrame, labels: DataFrame, word: str = "说话人", unknown: str | None = None, by: str = "session_id") -> DataFrame:
    """df with name: that of the highest labels_version, else word and the id counted from 1; unknown for a null id.

    by: a column by which rows of a hot session are spread.
    """
    out = salted_join(df, newest_labels(labels).withColumnRenamed("display_name", "_name"), ["session_id", "speaker_id"], by)
    default = F.concat(F.lit(word + " "), (F.col("speaker_id") + 1).cast("string"))
    return out.withColumn("name", F.when(F.col("speaker_id").isNull(), F.lit(unknown)).otherwise(F.coalesce("_name", default))).drop("_name")


def render_dialogue(utterances: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, first_seg, start_ms, block): '[MM:SS] name:' with a mark for overlap, and the text below; a row per utterance."""
    rows = with_names(utterances, labels, unknown="—", by="first_seg")
    mark = F.when(F.col("overlapped"), F.lit(" ⟂")).otherwise(F.lit(""))
    return rows.select("session_id", "first_seg", "start_ms", F.concat(F.lit("["), format_time_short("start_ms"), F.lit("] "), "name", mark, F.lit(":\n"), trim_white("text")).alias("block"))


def render_plain(utterances: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, first_seg, start_ms, block): 'name:text', or the text alone without a speaker."""
    rows = with_names(utterances, labels, by="first_seg")
    return rows.select("session_id", "first_seg", "start_ms", F.concat(F.when(F.col("name").isNull(), F.lit("")).otherwise(F.concat("name", F.lit(":"))), trim_white("text")).alias("block"))


def render_srt(utterances: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, first_seg, start_ms, block): numbered SubRip cues."""
    rows = with_names(numbered(utterances), labels, by="first_seg")
    who = F.when(F.col("name").isNull(), F.lit("")).otherwise(F.concat("name", F.lit(":")))
    times = F.concat(format_srt("start_ms"), F.lit(" --> "), format_srt("end_ms"))
    return rows.select("session_id", "first_seg", "start_ms", F.concat(F.col("utt_no").cast("string"), F.lit("\n"), times, F.lit("\n"), who, trim_white("text")).alias("block"))


def render_timeline(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, seg_id, block): one line per segment with words, not merged; names are padded to six characters, never cut."""
    rows = with_names(segments.where(~blank("text")).dropDuplicates(["seg_id"]), labels, unknown="—", by="seg_id")
    name = F.when(F.length("name") < 6, F.rpad("name", 6, " ")).otherwise(F.col("name"))
    mark = F.when(F.col("overlapped"), F.lit("⟂")).otherwise(F.lit(" "))
    times = F.concat(F.lit("["), format_time("start_ms"), F.lit(" - "), format_time(F.coalesce("end_ms", "start_ms")), F.lit("] "))
    return rows.select("session_id", "seg_id", F.concat(times, mark, F.lit(" "), name, F.lit(" "), trim_white("text")).alias("block"))


def repair_timeline(raw: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(session_id, pos, start_ms, end_ms, text) from recognised pieces (session_id, pos, to_ms, text) whose starts can't be trusted.

    Blank pieces are dropped. If the ends of a session rise strictly from above 0,
    each piece starts where the one before ends; else its whole length is shared
    out by the lengths of the texts, each share at least 1 ms and cut off at the
    whole length. A session whose ends are all 0 or less has no timeline.
    """
    rows = raw.where(~blank("text") & F.col("session_id").isNotNull() & F.col("pos").isNotNull())
    rows = rows.select(*K, "pos", F.greatest(F.coalesce("to_ms", F.lit(0)), F.lit(0)).alias("end_ms"), trim_white("text").alias("text"))
    rows = sliced(rows, K, "pos", width)
    order = ["pos"]
    before = F.lag("end_ms").over(along(K, order))
    rows = rows.withColumns({"_lag": before, "_size": F.greatest(F.length("text"), F.lit(1)).cast("long")})
    # _rises: of a slice's rows but the first, whose row before is in another slice.
    rows = rows.withColumns({
        "_rises": F.min(F.coalesce(F.col("end_ms") > F.col("_lag"), F.lit(True))).over(up_to(along(K, order))),
        "_top": F.max("end_ms").over(up_to(along(K, order))), "_many": F.sum("_size").over(up_to(along(K, order))),
    })
    steps = [
        {"_before": lambda w: F.coalesce(F.lag("_last.end_ms").over(w), F.lit(0))},
        {
            "_fine": lambda w: F.min(F.col("_last._rises") & (F.col("_first.end_ms") > F.col("_before"))).over(throughout(w)),
            "_all": lambda w: F.max("_last._top").over(throughout(w)), "_sizes": lambda w: F.sum("_last._many").over(throughout(w)),
        },
    ]
    rows = carried(rows, K, order, steps, ["_before", "_fine", "_all", "_sizes"])
    rows = rows.select(*K, "_slice", "pos", "end_ms", "text", F.coalesce("_lag", "_before").alias("_start"), "_fine", "_all", "_sizes", "_size")
    share = F.greatest(F.floor(F.col("_size").cast("double") / F.col("_sizes").cast("double") * F.col("_all").cast("double") + 0.5), F.lit(1))
    rows = running_sum(rows.withColumn("_share", share), K, order, "_share", "_sum")
    spread = lambda x: F.least("_all", x)
    return rows.where("_all > 0").select(
        *K, "pos", F.when(F.col("_fine"), F.col("_start")).otherwise(spread(F.col("_sum") - F.col("_share"))).alias("start_ms"),
        F.when(F.col("_fine"), F.col("end_ms")).otherwise(spread(F.col("_sum"))).alias("end_ms"), "text",
    )


RENDERERS = {"dialogue": render_dialogue, "plain": render_plain, "srt": render_srt}


def render(kind: str, segments: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, first_seg, start_ms, block): the blocks of a view of transcripts: dialogue, plain, srt or timeline."""
    if kind == "timeline":
        rows = segments.where("start_ms is not null").groupBy("seg_id").agg(F.min("start_ms").alias("start_ms")).withColumnRenamed("seg_id", "first_seg")
        return render_timeline(segments, labels).withColumnRenamed("seg_id", "first_seg").join(rows, "first_seg").select("session_id", "first_seg", "start_ms", "block")
    if kind not in RENDERERS:
        raise ValueError(f"no view {kind}: use timeline, {', '.join(RENDERERS)}")
    return RENDERERS[kind](merge_utterances(segments), labels)


def documents_of(blocks: DataFrame, between: str = "\\n\\n", most_chars: int = 1_000_000, width: int = SLICE_MS) -> DataFrame:
    """(session_id, part, blocks, text): the blocks of each session by start_ms and first_seg, joined to one text, or to numbered parts.

    A block begins part n if n * most_chars characters or more lie before it, so a
    part is longer than most_chars by one block at most, however long a session is;
    the session's text is that of its parts, with between between them.
    """
    order = ["start_ms", "first_seg"]
    rows = blocks.where(F.col("session_id").isNotNull() & F.col("start_ms").isNotNull()).select(*K, *order, "block")
    rows = sliced(rows.withColumn("_size", (F.length("block") + len(between)).cast("long")), K, "start_ms", width)
    rows = running_sum(rows, K, order, "_size", "_upto")
    rows = rows.withColumn("part", F.expr(f"(_upto - _size) div {int(most_chars)}"))
    out = rows.groupBy(*K, "part").agg(F.array_sort(F.collect_list(F.struct(*order, "block"))).alias("_x"))
    return out.select(*K, "part", F.size("_x").cast("long").alias("blocks"), F.array_join(F.transform("_x", lambda x: x["block"]), between).alias("text"))
