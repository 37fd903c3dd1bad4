"""Recognition of chunks of sound by a pluggable recogniser, and putting chunks together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.scan import salted_join

#: From samples, rate and channels, the segments (start_ms, end_ms, text) of a chunk, by its own clock.
Recogniser = Callable[[np.ndarray, int, int], list[tuple[int, int, str]]]


def mock_recogniser(samples: np.ndarray, rate: int, channels: int, step: int = 5000) -> list[tuple[int, int, str]]:
    """A stand-in: segments of step ms that cover the chunk, the last one cut off, numbered from 1."""
    total = len(samples) // channels * 1000 // rate if rate > 0 and channels > 0 else 0
    return [(at, min(at + step, total), f"segment {n}") for n, at in enumerate(range(0, total, step), 1)]


def transcribe(chunks: DataFrame, recogniser: Recogniser = mock_recogniser) -> DataFrame:
    """(session_id, idx, pos, start_ms, end_ms, text): what the recogniser finds in chunks, on the session's clock.

    chunks: session_id, idx, start_ms, sample_rate, channels, samples; a null start
    is 0. Chunks without samples give none; blank texts are left out, and an end is
    not before its start. Each chunk is recognised on its own, in Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for session, idx, start, rate, channels, samples in zip(*(frame[c] for c in ("session_id", "idx", "start_ms", "sample_rate", "channels", "samples"))):
                found = recogniser(np.asarray(samples, np.float32), int(rate), int(channels))
                rows += [(session, idx, n, int(start) + a, int(start) + max(a, b), t.strip()) for n, (a, b, t) in enumerate(found) if t.strip()]
            yield pd.DataFrame(rows, columns=["session_id", "idx", "pos", "start_ms", "end_ms", "text"])

    rows = chunks.where((F.size("samples") > 0) & (F.col("sample_rate") > 0) & (F.col("channels") > 0))
    rows = rows.select("session_id", "idx", F.coalesce("start_ms", F.lit(0)).cast("long").alias("start_ms"), "sample_rate", "channels", "samples")
    return rows.mapInPandas(run, "session_id string, idx long, pos long, start_ms long, end_ms long, text string")


def in_chunk_order(raw: DataFrame) -> DataFrame:
    """raw with order: that of pieces in their session, by chunk_id and pos if all of the session have a chunk_id, else by pos.

    raw: session_id, chunk_id, pos; chunk_id within 31 bits, pos within 32.
    """
    flags = raw.groupBy("session_id").agg(F.bool_and(F.col("chunk_id").isNotNull()).alias("_all"))
    rows = salted_join(raw, flags, ["session_id"], "pos")
    return rows.withColumn("order", F.when(F.col("_all"), F.col("chunk_id").cast("long") * (1 << 32)).otherwise(F.lit(0)) + F.col("pos")).drop("_all")


def resume_points(done: DataFrame, first: int = 0) -> DataFrame:
    """(session_id, completed, next): of each session how many chunks are done, and the first one, from first on, that is not.

    done: session_id and idx of finished chunks; repeated rows count once, those
    with a null not at all. The next one is found by anti-joins on (session_id,
    idx), so a session of many chunks is no single task.
    """
    rows = done.where("session_id is not null and idx is not null").select("session_id", F.col("idx").cast("long").alias("idx")).distinct()
    behind = rows.select("session_id", (F.col("idx") + 1).alias("idx")).unionByName(rows.select("session_id").distinct().withColumn("idx", F.lit(first).cast("long")))
    free = behind.where(F.col("idx") >= first).join(rows, ["session_id", "idx"], "left_anti").groupBy("session_id").agg(F.min("idx").alias("next"))
    return rows.groupBy("session_id").agg(F.count("*").alias("completed")).join(free, "session_id")


def in_list_order(is_dir: str, name: str) -> list[Column]:
    """Folders first, then by name."""
    return [F.col(is_dir).desc(), F.col(name)]
