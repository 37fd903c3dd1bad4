"""Profiles of voices and the samples they are made of, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import sample_key
from voxloom.operators.vectors import centroids, unit

LEAST_MS = 3000  # fixed value: length of an acceptable sample


def acceptable(least_ms: int = LEAST_MS) -> Column:
    """Whether a sample is long and loud enough and has a vector."""
    return F.coalesce((F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) >= least_ms) & (F.col("quality") > 0) & (F.size("vector") > 0), F.lit(False))


def enroll(samples: DataFrame, stored: DataFrame | None = None, least_ms: int = LEAST_MS) -> DataFrame:
    """stored and the acceptable ones of samples: (sample_id, profile_id, session_id, vector, quality, duration_ms, weight), each sample_id once.

    samples: profile_id, session_id, start_ms, end_ms, quality, vector. What is
    stored stays; of several new samples of a key the one with the largest quality,
    duration and vector is taken. The first of a key is decided by an aggregate that
    is combined before the shuffle.
    """
    good = samples.where(acceptable(least_ms))
    length = (F.col("end_ms") - F.col("start_ms")).cast("long")
    weight = F.greatest(F.col("quality").cast("double"), F.lit(1e-3)) * F.sqrt(length / 1000.0)
    rows = good.select(
        sample_key("profile_id", "session_id", "start_ms").alias("sample_id"), "profile_id", "session_id", "vector", F.col("quality").cast("double").alias("quality"),
        length.alias("duration_ms"), weight.alias("weight"), F.lit(1).alias("_new"),
    )
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("_new", F.lit(0)))
    order = F.struct(-F.col("_new"), "quality", "duration_ms", "vector")
    value = F.struct("profile_id", "session_id", "vector", "quality", "duration_ms", "weight")
    return rows.groupBy("sample_id").agg(F.max_by(value, order).alias("_x")).select("sample_id", "_x.*")


def profile_centroids(samples: DataFrame, top_k: int = 8) -> DataFrame:
    """(profile_id, centroid, used, sample_count): of each profile's samples, each of length 1 first, the weighted centre of the top_k best; sample_count counts all."""
    rows = samples.select("profile_id", "sample_id", unit("vector").alias("vector"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), "quality")
    counts = samples.groupBy("profile_id").agg(F.count("*").alias("sample_count"))
    return centroids(rows, ["profile_id"], "sample_id", top_k).join(counts, "profile_id")


def usable_profiles(profiles: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """The profiles of a model with a centroid, and (stale): how many are of another model."""
    of_model = F.col("embedding_model") == model
    return profiles.where(of_model & (F.size("centroid") > 0)), profiles.agg(F.count_if(~F.coalesce(of_model, F.lit(False))).alias("stale"))


def delete_profiles(profiles: DataFrame, samples: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profiles and samples without those of the profile_id in gone."""
    keys = gone.select("profile_id").distinct()
    return profiles.join(keys, "profile_id", "left_anti"), samples.join(keys, "profile_id", "left_anti")


def profile_stats(profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """profiles with samples and duration_ms, 0 for those without samples."""
    sums = samples.groupBy("profile_id").agg(F.count("*").alias("samples"), F.sum("duration_ms").alias("duration_ms"))
    return profiles.join(sums, "profile_id", "left").fillna(0, ["samples", "duration_ms"])
