"""Mixing of sources to target shares."""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SOURCES = 10_000
SLOTS = (4096, 1 << 18)  # of the schedule, at least and at most
SLOT_TOKENS = 1 << 24  # of a slot, as far as SLOTS allow
BUCKET_BITS = (12, 24)  # of the order within a source, at least and at most
BUCKET_TOKENS = 1 << 27  # of a bucket, as far as BUCKET_BITS allow


def slots_for(tokens: float) -> int:
    """Slots of a schedule of so many tokens."""
    return int(min(max(tokens // SLOT_TOKENS, SLOTS[0]), SLOTS[1]))


def bucket_bits_for(tokens: float) -> int:
    """Bits of the number of buckets for so many tokens."""
    return min(max(int(tokens // BUCKET_TOKENS).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])


def plain_source(column: str) -> Column:
    """A source in lower case without white space around it; an empty one is null."""
    x = F.regexp_replace(F.col(column), r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")
    return F.nullif(F.lower(x), F.lit(""))


def quotas(targets: dict[str, tuple[float, float]], total: int) -> dict[str, float]:
    """Tokens of each source: its share of total, but at most its room; what is lacking goes to the rest by weight.

    targets: weight and room (tokens times repeats). Weights are relative to
    their sum; the sum of the result is total, or all room if that is less.
    """
    left, out = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0}, dict.fromkeys(targets, 0.0)
    remaining = float(total)
    while left and remaining > 0:
        weights = sum(w for w, _ in left.values())
        full = [s for s, (w, r) in left.items() if r <= remaining * w / weights]
        if not full:
            return out | {s: remaining * w / weights for s, (w, _) in left.items()}
        for s in sorted(full):
            out[s] = float(left.pop(s)[1])
        remaining = total - sum(out.values())
    return out


def pfair(blocks: dict[str, float], slots_limit: int = 1 << 20) -> list[tuple[str, int]]:
    """An order of blocks, as (source, number), in which no source is ever a block or more off its share of the slots.

    blocks: how many blocks of each source; a part of one counts as a block. A
    source's share w is that of its blocks in all of them, a fraction. Its block j
    is released at slot floor(j / w) and due at slot ceil((j + 1) / w); each slot
    takes the released block that is due first, of equal ones that of the source
    with the larger share, then by name. Such windows can be kept by one at a time
    if the shares add up to 1, and the earliest deadline first keeps them.
    """
    counts = {s: ceil(n - 1e-9) for s, n in blocks.items() if n > 0}
    total = sum(counts.values())
    if total > slots_limit:
        raise ValueError("more blocks than slots_limit: make blocks larger")
    share = counts
    waiting = [(0, s, 0) for s in sorted(counts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    while waiting or ready:
        while waiting and (waiting[0][0] <= len(out) or not ready):
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // share[s]), -share[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < counts[s]:
            heapq.heappush(waiting, ((j + 1) * total // share[s], s, j + 1))
    return out


def mixture(
    counted: DataFrame,
    targets: DataFrame,
    size: int | None = None,
    slots: int | None = None,
    seed: int = 42,
    doc_id: str = "doc_id",
    source: str = "source",
    tokens: str = "n_tokens",
) -> tuple[DataFrame, DataFrame]:
    """A mixture of whole documents in which each source has its share, and the shares reached.

    counted: a row per document with its source and number of tokens; it is read
    several times, so it should be materialized. targets: (source, weight,
    max_repeats). Sources are compared by plain_source. size: tokens of the
    mixture, by default those of all documents, also of those without a source or
    target. A source gets its share of size as far as max_repeats of each of its
    documents allow; what it lacks goes to the others by weight (quotas), so the
    mixture has its full size unless all sources are exhausted. No document occurs
    more often than max_repeats, or less often than another of its source by more
    than one; documents without tokens occur as often as the first ones.

    Returns (doc_id, source, repeat, n_tokens, slot, place): sorted by slot, then
    place, the sources are interleaved; and (source, target_share, actual_share,
    actual_tokens, documents, max_repeats, available_tokens), with a row per
    target. Empty tables give an empty mixture.

    Method: pfair scheduling over blocks of size / slots tokens, but at least eight
    times the largest document, as documents stay whole; see pfair. The
    schedule has at most slots and a block per source, by default as many as the
    tokens call for within SLOTS, so it is made on the driver and broadcast. The
    order within a source is that of a hash of doc_id and seed; running sums of
    tokens are taken per bucket of that order, whose number grows with the tokens,
    and over the buckets' sums, so a hot source is spread over its buckets.
    """
    spark = counted.sparkSession
    docs = counted.select(F.col(doc_id).alias("_id"), plain_source(source).alias("_s"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_n"))
    docs = docs.withColumn("_h", F.xxhash64("_id", F.lit(seed)))
    wanted = targets.select(plain_source("source").alias("_s"), F.col("weight").cast("double").alias("w"), F.col("max_repeats").cast("long").alias("r")).where("_s is not null")
    wanted = wanted.groupBy("_s").agg(F.sum("w").alias("w"), F.max("r").alias("r"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in targets")
    weights = {x["_s"]: (max(x["w"] or 0.0, 0.0), max(x["r"] or 0, 0)) for x in rows}

    known = docs.join(F.broadcast(wanted.select("_s")), "_s", "left_semi")
    sums = {x["_s"]: x["n"] for x in known.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}
    if size is None:
        size = docs.agg(F.sum("_n")).first()[0] or 0
    slots = slots or slots_for(size)
    known = known.withColumn("_b", F.shiftright("_h", 64 - bucket_bits_for(sum(sums.values()))))
    quota = quotas({s: (w, sums.get(s, 0) * r) for s, (w, r) in weights.items()}, size)
    largest = known.agg(F.max("_n")).first()[0] or 1
    block = max(sum(quota.values()) / slots, 8.0 * largest)
    order = pfair({s: q / block for s, q in quota.items() if q > 0}, 2 * slots + len(quota))
    plan = spark.createDataFrame([(s, j, n) for n, (s, j) in enumerate(order)], "_s string, _block long, slot long")
    shares = spark.createDataFrame([(s, float(q), sums.get(s, 0)) for s, q in quota.items()], "_s string, _q double, _all long")

    per_bucket = known.groupBy("_s", "_b").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("_s", "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(per_bucket, ["_s", "_b"])
    placed = placed.withColumn("_at", F.col("_at") + F.col("_before")).join(F.broadcast(shares.where("_q > 0")), "_s")
    full = F.floor(F.col("_q") / F.col("_all"))
    times = full + F.when(F.col("_at") < F.col("_q") - full * F.col("_all"), F.lit(1)).otherwise(F.lit(0))
    placed = placed.withColumn("_times", times).where("_times > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    placed = placed.withColumn("place", F.col("repeat") * F.col("_all") + F.col("_at"))
    placed = placed.withColumn("_block", F.least(F.floor(F.col("place") / F.lit(block)), F.ceil(F.col("_q") / F.lit(block) - 1e-9) - 1).cast("long"))
    mix = placed.join(F.broadcast(plan), ["_s", "_block"]).select(
        F.col("_id").alias(doc_id), F.col("_s").alias(source), "repeat", F.col("_n").alias(tokens), "slot", "place"
    )

    reached = mix.groupBy(F.col(source).alias("_s")).agg(F.sum(tokens).alias("_t"), F.count("*").alias("_d"))
    everything = sum(w for w, _ in weights.values()) or 1.0
    goals = spark.createDataFrame([(s, w / everything, r, sums.get(s, 0)) for s, (w, r) in weights.items()], "_s string, target_share double, max_repeats long, available_tokens long")
    reached = goals.join(reached, "_s", "left").withColumn("_t", F.coalesce("_t", F.lit(0)))
    total = F.sum("_t").over(Window.partitionBy())  # a row per target
    report = reached.select(
        F.col("_s").alias("source"), "target_share", F.coalesce(F.col("_t") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        F.col("_t").alias("actual_tokens"), F.coalesce("_d", F.lit(0)).alias("documents"), "max_repeats", "available_tokens",
    )
    return mix, report
