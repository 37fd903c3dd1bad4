"""Running values along an ordered axis without one task per group.

A window over a group sorts the whole group in one task, which fails once a
group holds a large part of all rows. Here an axis is cut into slices: rows are
partitioned once by (group, slice) and windows run within a slice; of each slice
its first and last row, with their running values, form a small table, in which
values pass from slice to slice; what a slice gets from those before it is joined
back to its rows. The number of slices of a group depends on the stretch of the
axis it covers, not on its rows, and a slice has at most width places.

Both branches, rows and ends of slices, use the same columns of the same
partitioned rows, so Spark reads the input once and reuses the exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Width of a slice of time: a century has 146,100 of them.
SLICE_MS = 21_600_000
SALTS = 16


def slice_of(at: str, width: int) -> Column:
    """The number of the slice that at lies in, exact for all integers; 0 for null, as a join on what can't be null infers no filter, which would keep exchanges from being reused."""
    return F.expr(f"coalesce((`{at}` - pmod(`{at}`, {int(width)})) div {int(width)}, 0L)")


def sliced(df: DataFrame, keys: Sequence[str], at: str, width: int = SLICE_MS) -> DataFrame:
    """df with _slice, the stretch of width along at, partitioned by (keys, _slice)."""
    return df.withColumn("_slice", slice_of(at, width)).repartition(*keys, "_slice")


def once(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per keys, which rows must be partitioned by: of several the largest. Unlike dropDuplicates, copies of the plan reuse exchanges above it."""
    rest = [c for c in rows.columns if c not in keys]
    if len(rest) == 1:
        return rows.groupBy(*keys).agg(F.max(rest[0]).alias(rest[0])).select(*rows.columns)
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_rest"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_rest.`{c}`").alias(c) for c in rows.columns])


def along(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of a slice in order."""
    return Window.partitionBy(*keys, "_slice").orderBy(*order)


def up_to(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], steps: Sequence[dict[str, Callable[[WindowSpec], Column]]], keep: Sequence[str]) -> DataFrame:
    """rows of sliced(), with the columns keep that their slice gets from the others.

    The table of slices has _first and _last, structs of all columns of rows of the
    first and last row by order. steps add columns to it one after the other, each
    from the window over the slices of a group in order: its lag is the slice
    before, aggregates need a frame (earlier() or throughout()).
    """
    keys = list(keys)
    row, place, w = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order), along(keys, order)
    edge = (F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull()).alias("_edge")
    slices = rows.select("*", edge).where("_edge").groupBy(*keys, "_slice").agg(F.min_by(row, place).alias("_first"), F.max_by(row, place).alias("_last"))
    window = Window.partitionBy(*keys).orderBy("_slice")
    for step in steps:
        slices = slices.withColumns({name: column(window) for name, column in step.items()})
    return rows.join(slices.select(*keys, "_slice", *keep), [*keys, "_slice"])


def earlier(window: WindowSpec) -> WindowSpec:
    """All rows before this one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def throughout(window: WindowSpec) -> WindowSpec:
    """All rows."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of value up to and with each row of sliced rows, along order, also across slices."""
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(up_to(along(keys, order))), F.lit(0)))
    steps = [{"_before": lambda w: F.coalesce(F.sum("_last._own").over(earlier(w)), F.lit(0))}]
    return carried(rows, keys, order, steps, ["_before"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before")


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Add the values of the row before, along order, of sliced rows; also across slices, null at the start."""
    rows = rows.withColumn("_lag", F.lag(F.struct(*columns)).over(along(keys, order)))
    steps = [{"_before": lambda w: F.lag(F.struct(*[F.col(f"_last.`{c}`").alias(c) for c in columns])).over(w)}]
    out = carried(rows, keys, order, steps, ["_before"])
    return out.withColumns({name: F.coalesce("_lag", "_before")[c] for c, name in columns.items()}).drop("_lag", "_before")


class Fields:
    """Columns by name, of this row or another one."""

    def __init__(self, of: Callable[[str], Column]):
        self._of = of

    def __getitem__(self, name: str) -> Column:
        return self._of(name)


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Callable[[Fields, Fields], Column], name: str, place: str) -> DataFrame:
    """Add name, the order values, as a struct, of the last row up to this one that starts a run, and place, the number of rows between; also across slices.

    starts(before, row) tells from the fields of the row before and a row whether
    the latter starts a run; a first row does.
    """
    w = along(keys, order)
    new = starts(Fields(lambda c: F.lag(c).over(w)), Fields(F.col))
    rows = rows.withColumns({"_new": F.when(F.lag(F.lit(1)).over(w).isNotNull(), new), "_n": F.row_number().over(w).cast("long")})
    rows = rows.withColumn("_own", F.max(F.when(F.col("_new"), F.struct(*order, "_n"))).over(up_to(w)))  # _new is null in a slice's first row

    def put(source: str, n: Column) -> Column:
        return F.struct(*[F.col(f"{source}.`{c}`").alias(c) for c in order], n.alias("_n"))

    steps = [
        {"_prev": lambda w: F.lag("_last").over(w), "_base": lambda w: F.coalesce(F.sum("_last._n").over(earlier(w)), F.lit(0))},
        {"_head": lambda w: F.when(F.col("_prev").isNull() | starts(Fields(lambda c: F.col(f"_prev.`{c}`")), Fields(lambda c: F.col(f"_first.`{c}`"))), put("_first", F.col("_base") + 1))},
        {"_tail": lambda w: F.when(F.col("_last._own").isNotNull(), put("_last._own", F.col("_base") + F.col("_last._own._n")))},
        {"_in": lambda w: F.coalesce("_head", F.max(F.coalesce("_tail", "_head")).over(earlier(w)))},
    ]
    rows = carried(rows, keys, order, steps, ["_base", "_in"])
    start = F.coalesce(F.when(F.col("_own").isNotNull(), put("_own", F.col("_base") + F.col("_own._n"))), F.col("_in"))
    rows = rows.withColumn("_start", start).withColumns({name: F.struct(*[F.col(f"_start.`{c}`").alias(c) for c in order]), place: F.col("_base") + F.col("_n") - F.col("_start._n")})
    return rows.drop("_new", "_n", "_own", "_base", "_in", "_start")


def salted_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], by: str | Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """rows joined with lookup on keys, where a key may hold a large part of rows.

    Rows of a key are spread over salts tasks by the hash of by, and lookup, which
    should have few rows a key, is repeated for each.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(n) for n in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
