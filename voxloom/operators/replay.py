"""Replay of a change feed into the current state of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768  # of one bitmap of Spark's bitmap functions


def instant_ns(value: str | Column) -> Column:
    """Unix time in seconds, ms, us or ns, by magnitude, as nanoseconds.

    Under 1e11 is taken as seconds, under 1e14 as milliseconds, under 1e17 as
    microseconds. Null, and what doesn't fit into 64 bits, becomes null.
    """
    x = F.col(value) if isinstance(value, str) else value
    x = x.cast("long")
    size = F.abs(x)
    unit = F.when(size < 10**11, F.lit(10**9)).when(size < 10**14, F.lit(10**6)).when(size < 10**17, F.lit(10**3)).otherwise(F.lit(1))
    return F.try_multiply(x, unit.cast("long"))


def contiguous_watermark(changes: DataFrame, seq: str) -> DataFrame:
    """(watermark): the largest number up to which every sequence number from the smallest on is present; one row, null for a feed without numbers.

    Presence is held as one bitmap of 32,768 numbers per bucket, combined before
    the shuffle, so copies of a change and hot keys cost nothing. Only buckets
    with a hole go to the Python part.
    """
    x = changes.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("_q"))
    x = x.select(F.expr(f"(_q - pmod(_q, {BITS})) div {BITS}").alias("_b"), F.pmod("_q", F.lit(BITS)).alias("_p"))
    maps = x.groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_bits"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    maps = maps.select("_b", "_bits", "_lo", "_hi", F.bitmap_count("_bits").alias("_n"))
    # A run of numbers ends in a bucket with a hole, with an early end, or before a bucket that is absent or starts late.
    after = maps.select((F.col("_b") - 1).alias("_b"), F.col("_lo").alias("_next"))
    ends = maps.join(after, "_b", "left").where((F.col("_n") < F.col("_hi") - F.col("_lo") + 1) | (F.col("_hi") < BITS - 1) | F.coalesce(F.col("_next") > 0, F.lit(True)))

    def first_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for b, bits, lo, hi, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if n == hi - lo + 1:
                    at.append(b * BITS + hi)
                    continue
                present = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
                at.append(b * BITS + lo + int(np.argmin(present[lo:])) - 1)
            yield pa.RecordBatch.from_pydict({"end": pa.array(at, pa.int64())})

    return ends.select("_b", "_bits", "_lo", "_hi", "_n").mapInArrow(first_end, "end long").agg(F.min("end").alias("watermark"))


def committed_changes(changes: DataFrame) -> DataFrame:
    """The changes of complete transactions, with _commit, the number at which theirs commits: its largest one.

    changes: _seq and _tx, maybe _size, with whatever else. A transaction is complete
    once _size different _seq of it have come; of differing sizes the largest counts,
    and null means 1. Without _size, what has come of it is all. A change without a
    transaction commits alone. Distinct numbers of a transaction are counted before
    and after the shuffle. There may be as many transactions as changes, so the
    join is not salted: the changes of a hot one are split by adaptive execution.
    """
    rows = changes.where(F.col("_tx").isNotNull())
    if "_size" in changes.columns:
        have = rows.groupBy("_tx", "_seq").agg(F.max("_size").alias("_want"))
        have = have.groupBy("_tx").agg(F.count("*").alias("_have"), F.max("_want").alias("_want"), F.max("_seq").alias("_last"))
        have = have.select("_tx", (F.col("_have") >= F.coalesce("_want", F.lit(1))).alias("_whole"), "_last")
    else:
        have = rows.groupBy("_tx").agg(F.max("_seq").alias("_last")).withColumn("_whole", F.lit(True))
    found = changes.join(have, "_tx", "left")
    alone = F.col("_tx").isNull()
    return found.where(alone | F.col("_whole")).select(*changes.columns, F.when(alone, F.col("_seq")).otherwise(F.col("_last")).alias("_commit"))


def replay_parts(feed: DataFrame, key: str, seq: str, at: str | Column, transaction: str | None = None, transaction_size: str | None = None) -> DataFrame:
    """(key, committed, held): the last change of each key up to the watermark, and the last one held beyond it.

    Each is a struct of order (time and seq) and change, the other columns; null
    without such a change. Deletions are kept, since what is held may come before
    or after them. A transaction is committed as a whole once the watermark of
    complete transactions reaches its largest number, else it is held as a whole.
    Keys don't conflict with each other and are replayed in parallel, by maxima
    combined before the shuffle, so copies, late and unordered changes and hot keys
    need nothing else. The feed's columns are packed first, so their names don't matter.
    """
    change = F.struct(*[F.col(f"`{c}`") for c in feed.columns if c != key])
    number = F.col(f"`{seq}`").cast("long")
    columns = [F.col(f"`{key}`").alias("_key"), number.alias("_seq"), F.struct(instant_ns(at).alias("t"), number.alias("q")).alias("_order"), change.alias("_change")]
    if transaction:
        size = [F.col(f"`{transaction_size}`").alias("_size")] if transaction_size else []
        came = feed.select(*columns, F.col(f"`{transaction}`").alias("_tx"), *size).where("_seq is not null")
        changes = committed_changes(came)
        numbers = changes if size else came
    else:
        numbers = changes = feed.select(*columns).where("_seq is not null").withColumn("_commit", F.col("_seq"))
    beyond = F.col("_commit") > contiguous_watermark(numbers, "_seq").scalar()
    rows = changes.where("_key is not null").select("_key", F.struct(F.col("_order").alias("order"), F.col("_change").alias("change")).alias("_value"), "_order", beyond.alias("_beyond"))
    last = lambda which: F.max_by(F.when(which, F.col("_value")), F.when(which, F.col("_order")))
    return rows.groupBy(F.col("_key").alias(key)).agg(last(~F.col("_beyond")).alias("committed"), last(F.col("_beyond")).alias("held"))


def _state(parts: DataFrame, columns: list[str], key: str, deleted: str, change: Column, later: Column) -> DataFrame:
    last = parts.select(key, change.alias("_x"), later.alias("_later")).where(F.col("_x").isNotNull() & F.col(f"_x.`{deleted}`").isNull())
    own = [F.col(f"`{c}`") if c == key else F.col(f"_x.`{c}`").alias(c) for c in columns if c != "after_gap"]
    return last.select(*own, F.col("_later").alias("after_gap"))


def exposed(parts: DataFrame, columns: list[str], key: str = "rel_path", deleted: str = "deleted_at") -> DataFrame:
    """The state at the watermark: what replay_parts has committed, without what is held."""
    return _state(parts, columns, key, deleted, F.col("committed.change"), F.lit(False))


def close_feed(parts: DataFrame, columns: list[str], key: str = "rel_path", deleted: str = "deleted_at") -> DataFrame:
    """The state at the end of the feed: gaps are taken as lost, and what was held is released and merged into the state at the watermark."""
    state, tail = F.col("committed"), F.col("held")
    later = tail.isNotNull() & (state.isNull() | (tail["order"] > state["order"]))
    return _state(parts, columns, key, deleted, F.when(later, tail["change"]).otherwise(state["change"]), later)


def replay(
    feed: DataFrame,
    key: str = "rel_path",
    seq: str = "change_id",
    at: str | Column = "synced_at",
    deleted: str = "deleted_at",
    transaction: str | None = None,
    transaction_size: str | None = None,
    close: bool = True,
) -> DataFrame:
    """The current row of each key that a feed of upserts and deletions leaves.

    Each row sets its key to the whole row; deleted not null is a deletion. The
    last change of a key, by the time at (see instant_ns; null is earliest) and,
    among equal times, by seq, decides. Rows with a null key or seq are left out.
    The result has the feed's columns, of each surviving key the last change,
    and after_gap: the change lies beyond the contiguous committed watermark.

    Method: complete transactions are assembled (committed_changes; without
    transaction_size each is complete with what has come of it); bitmaps of
    their numbers give the watermark up to which nothing is missing; a transaction
    whose largest number lies beyond it is held as a whole (replay_parts). With
    close=False only the state at the watermark is exposed; close=True is the end
    of the feed: the held transactions are released and merged into that state.
    Transactions that never became complete are not applied.

    Copies of a change (equal seq) are taken as equal; of differing ones any one
    that the order allows remains. An empty feed gives an empty result. Nothing
    runs while the plan is built; the watermark is a scalar subquery.
    """
    parts = replay_parts(feed, key, seq, at, transaction, transaction_size)
    return (close_feed if close else exposed)(parts, feed.columns, key, deleted)
