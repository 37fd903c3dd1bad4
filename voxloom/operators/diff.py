"""Differences between two listings of the same store."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BITS = 32_768  # of one bitmap of Spark's bitmap functions


def plain_path(text: str | None, decode: bool) -> str | None:
    """The path in composed Unicode with single forward slashes, relative to the root.

    decode also resolves percent escapes, once; what isn't a valid escape, or
    isn't UTF-8 once decoded, stays as it is. Null stays null.
    """
    if text is None:
        return None
    if decode and "%" in text:
        try:
            text = unquote_to_bytes(text).decode("utf-8")
        except UnicodeDecodeError:
            pass
    text = unicodedata.normalize("NFC", text).replace("\\", "/")
    return "/".join(p for p in text.split("/") if p not in ("", "."))


def composed(x: Column) -> Column:
    """Text in composed Unicode (NFC), by the library that Spark's collations use; null for null."""
    return F.when(~x.rlike(r"[^\x00-\x7f]"), x).when(x.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(False)))


def plain_paths(column: str, decode: bool) -> Column:
    """plain_path as a column."""
    x = F.col(column)
    if decode:
        escaped = F.regexp_replace(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
        lost = F.regexp_count(F.url_decode(escaped), F.lit("\ufffd")) > F.regexp_count(x, F.lit("(?i)%EF%BF%BD|\ufffd"))  # bytes that are no UTF-8
        x = F.when(x.contains("%") & ~lost, F.url_decode(escaped)).otherwise(x)
    parts = F.split(F.replace(composed(x), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/")


def plain_digest(column: str) -> Column:
    """A digest without weak mark, quotes, case and blanks around it; an empty one is null."""
    x = F.regexp_replace(F.trim(F.col(column)), r"^(?:[Ww]/)?\"?|\"$", "")
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def spelled_time(column: str) -> Column:
    """Seconds since 1970 of an HTTP date, an ISO time with zone or Unix time; null for all else."""
    x = F.trim(F.col(column))
    zone = F.regexp_replace(F.regexp_replace(x, r"(?i)\s*(?:GMT|UTC|Z)$", "+0000"), r"\s*([+-]\d\d):?(\d\d)$", "$1$2")
    http = F.try_to_timestamp(F.regexp_replace(zone, r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ssxx"))
    iso = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(zone, "[Tt]", " "), r"\.\d+", ""), F.lit("yyyy-MM-dd HH:mm:ssxx"))
    number = F.when(x.rlike(r"^\d{1,18}$"), x.cast("long"))
    number = F.when(number < 10**11, number).when(number < 10**14, F.floor(number / 1000)).otherwise(F.floor(number / 1_000_000))
    return F.coalesce(number, F.unix_seconds(http), F.unix_seconds(iso))


def _latest(side: int, *columns: str) -> Column:
    return F.max(F.when(F.col("_side") == side, F.struct("_listed", "_dir", *columns)))


def _sides(local: DataFrame, remote: DataFrame, values: bool) -> DataFrame:
    def side(df: DataFrame, number: int, path: Column, size: str, time: Column) -> DataFrame:
        columns = [F.col(size).cast("long").alias("_size"), plain_digest("content_hash").alias("_hash"), time.alias("_time")] if values else []
        return df.where(F.col("rel_path").isNotNull()).select(
            F.coalesce(path, F.lit("")).alias("_path"), F.lit(number).alias("_side"), F.col("listed_at").alias("_listed"), F.coalesce("is_dir", F.lit(False)).alias("_dir"), *columns
        )

    return side(local, 0, plain_paths("rel_path", False), "local_size", F.unix_seconds(F.col("modified_at").cast("timestamp"))).unionByName(
        side(remote, 1, plain_paths("rel_path", True), "remote_size", spelled_time("remote_modified"))
    )


def _compare_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each unit of ordinals, from the bitmaps of both sides, those of one side only and of both, as 512 longs each."""
    for batch in batches:
        local, remote = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8) for i in (1, 2))
        sets = [local & ~remote, remote & ~local, local & remote]
        edges = pa.array(np.arange(0, len(local) // 8 + 1, BITS // 64, dtype=np.int32))
        cut = [pa.ListArray.from_arrays(edges, pa.array(x.view("<i8"))) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cut], ["_unit", "_l", "_r", "_both"])


def _has(bitmap: str, place: str) -> Column:
    """Whether the bit at place is set."""
    return F.call_function("shiftright", F.get(bitmap, F.expr(f"cast({place} div 64 as int)")), F.expr(f"cast({place} % 64 as int)")).bitwiseAND(1) == 1


def presence(local: DataFrame, remote: DataFrame, blocks: int = 4096) -> DataFrame:
    """(path, ordinal, side) of the files of two listings; side is local_only, remote_only or both.

    See listing_diff for what counts as a file. Only paths, times of listing and
    is_dir are read.

    The distinct paths are numbered within blocks by hash: these ordinals are
    shared by both sides. Of each side a bitmap of BITS ordinals says which it has;
    bitmaps are combined before the shuffle and travel compressed, 4 kB for up to
    32,768 paths. AND-NOT of a unit's two bitmaps gives the ordinals of one side
    only, AND those of both, by which the paths are told apart.
    """
    rows = _sides(local, remote, False).groupBy("_path").agg(_latest(0).alias("_l"), _latest(1).alias("_r"))
    here = [F.coalesce(~F.col(f"{x}._dir"), F.lit(False)).alias(f"in{x}") for x in ("_l", "_r")]
    keys = rows.select("_path", *here).where("in_l or in_r").withColumn("_block", F.pmod(F.xxhash64("_path"), F.lit(blocks)))
    at = F.row_number().over(Window.partitionBy("_block").orderBy("_path")).cast("long") - 1
    keys = keys.withColumn("_at", at).select("_path", "in_l", "in_r", (F.shiftleft("_block", 40) + F.expr(f"_at div {BITS}")).alias("_unit"), (F.col("_at") % BITS).alias("_place"))
    bits = [F.bitmap_construct_agg(F.when(F.col(f"in_{x}"), F.col("_place"))).alias(f"_{x}") for x in "lr"]
    sets = keys.groupBy("_unit").agg(*bits).mapInArrow(_compare_presence, "_unit long, _l array<long>, _r array<long>, _both array<long>")
    side = F.when(_has("_both", "_place"), "both").when(_has("_l", "_place"), "local_only").when(_has("_r", "_place"), "remote_only")
    found = keys.select("_path", "_unit", "_place").join(sets, "_unit")
    return found.select(F.col("_path").alias("path"), F.struct(F.col("_unit").alias("unit"), F.col("_place").alias("place")).alias("ordinal"), side.alias("side"))


def listing_diff(local: DataFrame, remote: DataFrame, blocks: int = 4096) -> DataFrame:
    """Files on one side only and fields that differ, as (rel_path, diff).

    diff is local_only, remote_only, size, hash, local_newer or remote_newer; a
    path may have several rows, but no row twice. Paths are compared in plain
    form (see plain_path; only remote ones are percent-decoded), digests without
    regard to spelling, times in whole seconds and only where both are known.
    Null on one side only is a difference of size or hash, null on both is none.
    Of several rows of a path the latest listed_at holds (null is earliest; among
    equal times the larger values); a path whose latest row is a folder is no
    file. A null path is left out, a null is_dir means a file. Empty listings are
    listings without files. Other columns are ignored.

    Method: presence() tells by shared ordinals and bitmaps which paths are on one
    side only. Sizes, digests and times travel apart from that and are aligned
    with the ordinals of both sides alone, so that each column of one side lies
    beside that of the other and is compared as a whole.
    """
    where = presence(local, remote, blocks)
    missing = where.where("side <> 'both'").select("path", F.array("side").alias("_diffs"))
    values = _sides(local, remote, True).groupBy("_path").agg(*[_latest(n, "_size", "_hash", "_time").alias(x) for n, x in enumerate("lr")])
    both = where.where("side = 'both'").join(values.withColumnRenamed("_path", "path"), "path")
    differs = [F.when(~F.col(f"l._{f}").eqNullSafe(F.col(f"r._{f}")), F.lit(f)) for f in ("size", "hash")]
    newer = [F.when(F.col(f"{a}._time") > F.col(f"{b}._time"), F.lit(d)) for a, b, d in (("l", "r", "local_newer"), ("r", "l", "remote_newer"))]
    diffs = both.select("path", F.array_compact(F.array(*differs, *newer)).alias("_diffs"))
    return missing.unionByName(diffs).select(F.col("path").alias("rel_path"), F.explode("_diffs").alias("diff"))


def folders_of(path: str | Column) -> Column:
    """All folders above a path, the root as an empty string."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def only_per_folder(diff: DataFrame, which: str = "remote_only") -> DataFrame:
    """How many files of the kind which lie below each folder: (folder, files); diff has rel_path and diff.

    Counts are combined before the shuffle, so the root and other hot folders
    cost one row a task. Folders without such files are absent.
    """
    rows = diff.where(F.col("diff") == which).select(F.explode(folders_of("rel_path")).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("files"))
