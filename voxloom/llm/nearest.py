"""Pairing of records with the nearest record in time of the same entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_by_ticks(
    left: DataFrame,
    rights: dict[str, tuple[DataFrame, str]],
    entity: str = "session_id",
    left_id: str = "seg_id",
    left_time: str = "start_ms",
    right_time: str = "start_ms",
    tolerance: int = 1000,
    tick: int | None = None,
) -> DataFrame:
    """(left_id, source, match_id, distance): of each source the record nearest in time.

    rights maps a source's name to its table and id column. A match lies at most
    tolerance away in the same entity; of two as near the earlier, of equal times
    the smaller id. Records without entity, time or id match nothing, repeated
    rows count once, records without a match are absent, and other columns are
    ignored. Times are integers.

    Method: tick expansion. Each right record is exploded to every tick that its
    tolerance reaches. Ticks are as wide as tolerance by default, so these are
    three at most; per (entity, tick) only records remain that are nearest to
    some time within the tick: those inside it, the last one before it and the
    first one after it. Left records then meet their own tick in an equi-join and
    take the nearest of its few candidates. With tick=1 exactly one candidate
    remains per tick and source; wider ticks give the same pairs with fewer rows.

    Right records of equal time are reduced to the smallest id before, so a tick
    holds at most tick + 2 candidates of a source whatever the number of rows, and
    a hot entity spreads over its ticks.
    """
    width = int(tick or max(tolerance, 1))
    names = list(rights)
    rows: DataFrame | None = None
    for n, name in enumerate(names):
        df, right_id = rights[name]
        own = df.select(F.col(entity).alias("_e"), F.lit(n).alias("_n"), F.col(right_time).cast("long").alias("_t"), F.col(right_id).cast("long").alias("_id"))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.where(F.col("_e").isNotNull() & F.col("_t").isNotNull() & F.col("_id").isNotNull())
    rows = rows.groupBy("_e", "_n", "_t").agg(F.min("_id").alias("_id"))

    def tick_of(x: Column) -> Column:
        return F.floor(x / width)

    rows = rows.withColumn("_tick", F.explode(F.sequence(tick_of(F.col("_t") - tolerance), tick_of(F.col("_t") + tolerance))))
    own = tick_of(F.col("_t"))
    packed = F.struct(F.col("_t").alias("t"), F.col("_id").alias("id"))
    chosen = []
    for n in range(len(names)):
        mine = F.col("_n") == n
        chosen += [
            F.collect_list(F.when(mine & (own == F.col("_tick")), packed)).alias(f"_in{n}"),
            F.max_by("_id", F.when(mine & (own < F.col("_tick")), F.col("_t"))).alias(f"_bi{n}"),
            F.max(F.when(mine & (own < F.col("_tick")), F.col("_t"))).alias(f"_bt{n}"),
            F.min_by("_id", F.when(mine & (own > F.col("_tick")), F.col("_t"))).alias(f"_ai{n}"),
            F.min(F.when(mine & (own > F.col("_tick")), F.col("_t"))).alias(f"_at{n}"),
        ]
    ticks = rows.groupBy("_e", "_tick").agg(*chosen)

    lefts = left.select(F.col(entity).alias("_e"), F.col(left_id).alias("_l"), F.col(left_time).cast("long").alias("_s"))
    lefts = lefts.where(F.col("_e").isNotNull() & F.col("_s").isNotNull() & F.col("_l").isNotNull())
    lefts = lefts.withColumn("_tick", tick_of(F.col("_s"))).repartition("_e", "_tick").dropDuplicates(["_e", "_tick", "_s", "_l"])

    joined = lefts.join(ticks, ["_e", "_tick"])

    def measured(t: Column, i: Column) -> Column:
        return F.struct(F.abs(t - F.col("_s")).alias("d"), t.alias("t"), i.alias("id"))

    best = []
    for n, name in enumerate(names):
        inside = F.array_min(F.transform(F.col(f"_in{n}"), lambda c: measured(c["t"], c["id"])))
        sides = [F.when(F.col(f"_{x}t{n}").isNotNull(), measured(F.col(f"_{x}t{n}"), F.col(f"_{x}i{n}"))) for x in "ba"]
        near = F.least(inside, *sides)
        best.append(F.when(near["d"] <= tolerance, F.struct(F.lit(name).alias("source"), near["id"].alias("match_id"), near["d"].alias("distance"))))
    out = joined.select(F.col("_l").alias(left_id), F.explode(F.array_compact(F.array(*best))).alias("_x"))
    return out.select(left_id, "_x.source", "_x.match_id", "_x.distance")
