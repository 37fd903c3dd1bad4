"""Structured Streaming forms of the session and manifest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.listings import merge_manifests


def speech_sessions(segments: DataFrame, at: str, gap: str = "2500 milliseconds", late: str = "1 hour") -> DataFrame:
    """(session_id, speaker_id, start, end, segments): stretches of one speaker's segments that begin less than gap apart.

    segments may be a stream with an event time at; rows later than late are
    dropped once the watermark has passed them, and copies by seg_id count once.
    """
    rows = segments.withWatermark(at, late).dropDuplicatesWithinWatermark(["seg_id"]) if segments.isStreaming else segments.dropDuplicates(["seg_id"])
    found = rows.groupBy("session_id", "speaker_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("segments"))
    return found.select("session_id", "speaker_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "segments")


def talk_time(segments: DataFrame, at: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(session_id, speaker_id, start, talk_ms, segments) per window of event time; null speakers and negative lengths don't count."""
    rows = segments.where(F.col("speaker_id").isNotNull())
    rows = rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["seg_id"]) if rows.isStreaming else rows.dropDuplicates(["seg_id"])
    spent = F.greatest(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(0))
    found = rows.groupBy("session_id", "speaker_id", F.window(at, window).alias("w")).agg(F.sum(spent).alias("talk_ms"), F.count("*").alias("segments"))
    return found.select("session_id", "speaker_id", F.col("w.start").alias("start"), "talk_ms", "segments")


def finished_chunks(chunks: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Finished chunks (session_id, idx and the rest), each once, of a stream in which they may come again; a batch keeps one of each."""
    rows = chunks.where("session_id is not null and idx is not null")
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["session_id", "idx"]) if rows.isStreaming else rows.dropDuplicates(["session_id", "idx"])


def maintain_manifest(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table at path/<batch> equal to the latest entry of each path in a stream of manifest entries.

    Every batch merges the newest table with its changes into a new folder, so a
    batch that is repeated after a failure gives the same folder again; readers
    take the folder with the highest number (see newest_manifest).
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = newest_manifest(batch, path, number)
        merged = merge_manifests(before, batch) if before is not None else merge_manifests(batch, batch.limit(0))
        merged.write.mode("overwrite").parquet(f"{path}/batch={number:020d}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_manifest(df: DataFrame, path: str, below: int | None = None) -> DataFrame | None:
    """The newest table that maintain_manifest has written, of batches below a number if given; None if there is none."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None
    names = [s.getPath().getName() for s in system.listStatus(place)]
    numbers = sorted(int(n[6:]) for n in names if n.startswith("batch=") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    numbers = [n for n in numbers if below is None or n < below]
    return spark.read.parquet(f"{path}/batch={numbers[-1]:020d}") if numbers else None
