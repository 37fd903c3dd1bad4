"""Continuous periods of overlapping intervals, and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.scan import SLICE_MS, earlier, slice_of

HOUR_MS = 3_600_000


def periods_and_gaps(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_ms",
    end: str = "end_ms",
    max_gap: int | None = HOUR_MS,
    bucket_width: int = SLICE_MS,
) -> DataFrame:
    """Merge overlapping or touching intervals per entity and list the gaps.

    Returns keys, kind ('period' or 'gap'), start, end. A gap is the time
    between two neighbouring periods of an entity, listed if under max_gap
    (None: always). Rows with a null key, null start or end, or an end not
    after the start don't count; repeated rows change nothing; an empty table
    gives an empty result. Other columns are ignored.

    Method: starts are compared with the running maximum of earlier ends, which
    labels islands cumulatively. The running maximum is taken in two levels, per
    bucket of bucket_width and then over buckets, so a hot entity spreads over
    as many tasks as it has buckets. In a bucket, equal starts are folded first,
    which bounds its rows by bucket_width whatever the number of repeats; the
    number of buckets is bounded by the stretch of time that an entity covers.
    """
    keys = list(keys)
    k, s, e = [f"_k{i}" for i in range(len(keys))], "_s", "_e"
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(start).cast("long").alias(s), F.col(end).cast("long").alias(e))
    for c in k:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where(F.col(s).isNotNull() & (F.col(e) > F.col(s))).withColumn("_b", slice_of(s, bucket_width))
    rows = rows.repartition(*k, "_b").groupBy(*k, "_b", s).agg(F.max(e).alias(e))

    order = Window.partitionBy(*k, "_b").orderBy(s)
    rows = rows.withColumn("_prev", F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_head", F.col("_prev").isNull() | (F.col(s) > F.col("_prev")))
    rows = rows.withColumn("_island", F.sum(F.col("_head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    local = rows.groupBy(*k, "_b", "_island").agg(
        F.min(s).alias(s), F.max(e).alias(e), F.max(F.when(F.col("_head"), F.col("_prev"))).alias("_prev")
    )

    buckets = local.groupBy(*k, "_b").agg(F.max(e).alias("_me"), F.max(s).alias("_ls"))
    axis = earlier(Window.partitionBy(*k).orderBy("_b"))
    buckets = buckets.withColumn("_carry", F.max("_me").over(axis))
    opened = F.when(F.col("_carry").isNull() | (F.col("_ls") > F.col("_carry")), F.col("_ls"))
    buckets = buckets.withColumn("_label_in", F.max(opened).over(axis))

    joined = local.join(buckets.select(*k, "_b", "_carry", "_label_in"), [*k, "_b"])
    head = F.col("_carry").isNull() | (F.col(s) > F.col("_carry"))
    joined = joined.select(
        *k, s, e,
        F.when(head, F.col(s)).otherwise(F.col("_label_in")).alias("_label"),
        F.when(head, F.greatest("_prev", "_carry")).alias("_before"),
    )
    islands = joined.groupBy(*k, "_label").agg(F.max(e).alias(e), F.max("_before").alias("_before"))

    gap = F.col("_before").isNotNull()
    if max_gap is not None:
        gap = gap & (F.col("_label") - F.col("_before") < max_gap)
    period = F.struct(F.lit("period").alias("kind"), F.col("_label").alias("s"), F.col(e).alias("e"))
    gaps = F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("_before").alias("s"), F.col("_label").alias("e")))
    out = islands.select(*k, F.explode(F.array_compact(F.array(period, gaps))).alias("_x"))
    return out.select(
        *[F.col(a).alias(c) for c, a in zip(keys, k)], F.col("_x.kind").alias("kind"), F.col("_x.s").alias(start), F.col("_x.e").alias(end)
    )
