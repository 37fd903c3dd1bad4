"""Transcript segments into ordered turns of one person each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.captions import Line, clean_text
from voxloom.llm.names import Persons
from voxloom.operators.overlap import assign_speaker
from voxloom.operators.scan import SLICE_MS, once, runs, salted_join, sliced
from voxloom.operators.utterances import newest_labels
from voxloom.session import materialize

HOUR_MS = 3_600_000
_LINE = "spoken boolean, names array<string>, words string"


def _spoken(text: pd.Series) -> pd.Series:
    return pd.Series([Line(t).spoken for t in text], dtype=bool)


def _parsed(text: pd.Series) -> pd.DataFrame:
    lines = [Line(t) for t in text]
    return pd.DataFrame({"spoken": [x.spoken for x in lines], "names": [x.names for x in lines], "words": None})


def _parsed_words(text: pd.Series) -> pd.DataFrame:
    lines = [Line(t) for t in text]
    words = [clean_text(t, x.body) if x.spoken else None for t, x in zip(text, lines)]
    return pd.DataFrame({"spoken": [x.spoken for x in lines], "names": [x.names for x in lines], "words": words})


def parsed_line(text: str, with_words: bool = False) -> Column:
    """Of a segment's text: spoken, whether it holds spoken words, names, the candidates in front of them, and words, cleaned, if asked for."""
    return F.pandas_udf(_parsed_words if with_words else _parsed, _LINE)(text)


def _persons(labels) -> Persons:
    return Persons({int(x["speaker_id"]): x["display_name"] for x in labels} if labels is not None else {})


def _ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [{i: p for i, p in _persons(labels).persons.items() if p != i} for labels in frame["labels"]]
        yield pd.DataFrame({"session_id": frame["session_id"], "persons": found})


def _names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, persons = None, Persons({})
    for frame in frames:
        out = []
        for s, name, labels in zip(frame["session_id"], frame["name"], frame["labels"]):
            if s != session:
                session, persons = s, _persons(labels)
            if (who := persons.who(name)) is not None:
                out.append((s, name, who))
        yield pd.DataFrame(out, columns=["session_id", "name", "person"])


def persons_of(labels: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, persons), of each labelled session a map from ids to the other id whose person they belong to; and (session_id, name, person): names that mean one.

    labels: of each session those of its highest labels_version count, one name an
    id. names: (session_id, name). Only the labels of a session come together, whose
    number is that of its speakers; names are spread over tasks, each row with the
    labels of its session, and compared with these one by one.
    """
    rows = newest_labels(labels).where(F.col("speaker_id").isNotNull() & F.col("session_id").isNotNull())
    rows = rows.select("session_id", F.struct(F.col("speaker_id").cast("long").alias("speaker_id"), "display_name").alias("x"))
    of_session = rows.groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("labels"))
    same = of_session.mapInPandas(_ids, "session_id string, persons map<long, long>")
    told = salted_join(names.distinct(), of_session, ["session_id"], "name")
    return same, told.mapInPandas(_names, "session_id string, name string, person long")


def spoken_segments(segments: DataFrame, labels: DataFrame, intervals: DataFrame, with_text: bool = False, width: int = SLICE_MS) -> DataFrame:
    """(session_id, _slice, seg_id, start_ms, person[, text]) of the segments with words, as far as a person is known, partitioned by (session_id, _slice).

    Rows are partitioned by slices of their session once, and what they need of
    their session, the map of persons, comes to each slice, so that neither rows nor
    texts travel for it.
    """
    segments = segments.where(F.col("session_id").isNotNull() & F.col("start_ms").isNotNull() & F.col("seg_id").isNotNull() & F.col("text").isNotNull())
    text = [F.col("line.words").alias("text")] if with_text else []
    line = parsed_line("text", with_text).alias("line")
    own = line if with_text else F.struct(F.pandas_udf(_spoken, "boolean")("text").alias("spoken")).alias("line")
    known = segments.where(F.col("speaker_id").isNotNull()).select("session_id", "seg_id", "start_ms", F.col("speaker_id").cast("long").alias("speaker_id"), own).where("line.spoken")
    known = known.select("session_id", "seg_id", "start_ms", "speaker_id", *text)

    unknown = segments.where(F.col("speaker_id").isNull()).select("session_id", "seg_id", "start_ms", "end_ms", line).where("line.spoken")
    unknown = unknown.select("session_id", "seg_id", "start_ms", "end_ms", F.col("line.names").alias("names"), *text)
    unknown = materialize(unknown.dropDuplicates(["seg_id"]), "unnamed-segments")

    same, means = persons_of(labels, unknown.select("session_id", F.explode("names").alias("name")))
    said = unknown.select("session_id", "seg_id", F.posexplode("names").alias("at", "name"))
    said = salted_join(said, means, ["session_id", "name"], "seg_id", "inner")
    said = said.groupBy("seg_id").agg(F.min_by("person", "at").alias("said"))
    heard = assign_speaker(unknown, intervals).select("seg_id", "speaker_id")
    unknown = unknown.join(said, "seg_id", "left").join(heard, "seg_id", "left")
    columns = ["session_id", "seg_id", "start_ms", "speaker_id", "said", *(["text"] if with_text else [])]
    rows = known.withColumn("said", F.lit(None).cast("long")).select(columns).unionByName(unknown.select(columns))
    rows = sliced(rows, ["session_id"], "start_ms", width)
    # The hash uses all columns only so that both sides of the join read the same exchange.
    slices = rows.groupBy("session_id", "_slice").agg(F.max(F.xxhash64(*rows.columns)).alias("_x")).where("_x is not null").select("session_id", "_slice")
    rows = rows.join(slices.join(same, "session_id", "left"), ["session_id", "_slice"])
    rows = rows.withColumn("person", F.coalesce("said", F.col("persons")[F.col("speaker_id")], "speaker_id"))
    return rows.where(F.col("person").isNotNull()).drop("said", "speaker_id", "persons")


def turns(spoken: DataFrame, max_step: int = HOUR_MS, width: int = SLICE_MS) -> DataFrame:
    """Longest runs of one person's segments: (session_id, speaker_id, first_seg, last_seg, segments, start_ms[, text]).

    Segments are taken by start_ms (equal ones by seg_id); each starts less than
    max_step after the one before. Sessions are cut into slices of time, whose ends
    tell which turns go on across them, so a hot session is spread over its slices.
    Of copies of a segment the largest person counts. A turn's texts come together
    in the row that holds them. spoken may already be partitioned by sliced().
    """
    keys, order = ["session_id"], ["start_ms", "seg_id"]
    texts = ["text"] if "text" in spoken.columns else []

    def starts(before: Column, row: Column) -> Column:
        return (before["person"] != row["person"]) | (row["start_ms"] - before["start_ms"] >= max_step)

    rows = spoken.select(*keys, "_slice", *order, "person", *texts) if "_slice" in spoken.columns else sliced(spoken.select(*keys, *order, "person", *texts), keys, "start_ms", width)
    rows = runs(once(rows, [*keys, "_slice", *order]), keys, order, starts, "_turn", "_place")
    at = F.struct(*order)
    found = [F.max("person").alias("speaker_id"), F.min_by("seg_id", at).alias("first_seg"), F.max_by("seg_id", at).alias("last_seg"), F.count("*").alias("segments")]
    if texts:
        found.append(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("_texts"))
    out = rows.groupBy(*keys, "_turn").agg(*found)
    columns = ["session_id", "speaker_id", "first_seg", "last_seg", "segments", F.col("_turn.start_ms").alias("start_ms")]
    if texts:
        columns.append(F.array_join(F.transform("_texts", lambda x: x["text"]), " ").alias("text"))
    return out.select(*columns)
