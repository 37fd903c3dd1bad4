"""Vectors of voices: similarity, centroids, matching and clustering."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.directions import EPSILON, GONE, PLACES, Directions, unit as direction, units


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products in double precision."""
    product = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine within [-1, 1]; 0 for vectors of different or no length, null or without direction."""
    usable = (F.size(_col(a)) == F.size(_col(b))) & (F.size(_col(a)) > 0) & (norm(a) > EPSILON) & (norm(b) > EPSILON)
    value = dot(a, b) / (norm(a) * norm(b))
    return F.when(F.coalesce(usable, F.lit(False)), F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))


def unit(a: str | Column) -> Column:
    """The vector of length 1, in double precision; one without direction stays as it is."""
    n = norm(a)
    return F.transform(_col(a), lambda x: F.when(n > EPSILON, x.cast("double") / n).otherwise(x.cast("double")))


def centroids(samples: DataFrame, keys: list[str], order: str, top_k: int = 0, weighted: bool = True) -> DataFrame:
    """(keys, centroid, used): the centre of the top_k samples by quality (0: all) of each group, of length 1.

    samples: keys, order, vector, start_ms, end_ms, quality. The weight is
    quality, at least 0.001, times the root of the seconds, within 0.5 and 60. Of
    equal quality those first by order count. Samples with null vectors are left
    out; so are, after the choice of the best, those whose length differs from that
    of the group's first sample by order. Groups without samples or direction, or
    whose first sample is empty, are absent.

    top_k is applied before the shuffle, per task, and sums per place of the
    vector are combined before the shuffle, so hot groups are no burden.
    """
    rows = samples.where(F.col("vector").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.min_by(F.size("vector"), order).alias("_size"))
    if top_k:
        w = Window.partitionBy(*keys).orderBy(F.coalesce("quality", F.lit(0.0)).desc(), order)
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k)
    rows = rows.join(sizes, keys).where(F.size("vector") == F.col("_size"))
    seconds = F.greatest(F.least((F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0))) / 1000.0, F.lit(60.0)), F.lit(0.5))
    weight = F.greatest(F.coalesce("quality", F.lit(0.0)).cast("double"), F.lit(1e-3)) * F.sqrt(seconds) if weighted else F.lit(1.0)
    rows = rows.select(*keys, weight.alias("_w"), F.posexplode("vector").alias("_at", "_v"))
    sums = rows.groupBy(*keys, "_at").agg((F.sum(F.col("_v").cast("double") * F.col("_w")) / F.sum("_w")).alias("_v"), F.count("*").alias("_used"))
    out = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_x"), F.max("_used").alias("used"))
    out = out.select(*keys, unit(F.transform("_x", lambda x: x["_v"])).alias("centroid"), "used")
    return out.where(norm("centroid") > 0.5)


def confidence(similarity: str | Column) -> Column:
    """confirmed from 0.72, uncertain from 0.55, else new."""
    x = _col(similarity)
    return F.when(x >= 0.72, F.lit("confirmed")).when(x >= 0.55, F.lit("uncertain")).otherwise(F.lit("new"))


def identify(clusters: DataFrame, profiles: DataFrame, cluster_key: str, profile_key: str, most_profiles: int = 100_000, most_values: int = 1 << 26) -> DataFrame:
    """(cluster_key, profile_key, similarity, confidence): the profile most similar to each cluster's centroid.

    Of equally similar profiles the smallest key. profile_key is null for 'new';
    without a profile of the same length similarity is 0. All profiles are held in
    each task as one matrix, so their size is checked; more than most_profiles, or
    most_values values, are refused. Clusters are compared with it in Arrow batches.
    """
    usable = profiles.where((F.size("centroid") > 0) & (norm("centroid") > EPSILON)).select(profile_key, F.transform("centroid", lambda x: x.cast("double")).alias("centroid"))
    count, values = usable.agg(F.count("*"), F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()
    if count > most_profiles or values > most_values:
        raise ValueError(f"more than {most_profiles} profiles or {most_values} values")
    rows = usable.orderBy(profile_key).collect()
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(r["centroid"]) for r in rows}:
        own = [r for r in rows if len(r["centroid"]) == size]
        matrix = np.array([r["centroid"] for r in own])
        by_size[size] = ([r[profile_key] for r in own], matrix / np.linalg.norm(matrix, axis=1, keepdims=True))
    shared = clusters.sparkSession.sparkContext.broadcast(by_size)
    kinds = {f.name: f.dataType.simpleString() for f in (*clusters.schema, *profiles.schema)}

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, vector in zip(frame[cluster_key], frame["centroid"]):
                x = np.array(vector, np.float64) if vector is not None else np.zeros(0)
                length = np.linalg.norm(x)
                if len(x) not in shared.value or length <= EPSILON:
                    out.append((key, None, 0.0))
                    continue
                names, matrix = shared.value[len(x)]
                found = np.clip(matrix @ (x / length), -1, 1)
                best = int(found.argmax())
                out.append((key, names[best], float(found[best])))
            yield pd.DataFrame(out, columns=[cluster_key, profile_key, "similarity"])

    out = clusters.select(cluster_key, "centroid").mapInPandas(match, f"`{cluster_key}` {kinds[cluster_key]}, `{profile_key}` {kinds[profile_key]}, similarity double")
    out = out.withColumn("confidence", confidence("similarity"))
    return out.withColumn(profile_key, F.when(F.col("confidence") != "new", F.col(profile_key)))


def first_appearance(labels: np.ndarray) -> np.ndarray:
    """Labels numbered from 0 in the order in which they first occur."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(lengths > EPSILON, np.clip(a @ b.T / lengths, -1, 1), 0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The vector nearest to any centre, the last of equal ones."""
    near = _cosines(x, centres).max(axis=1)
    return x[len(near) - 1 - int(near[::-1].argmax())]


def moved(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray, seed) -> None:
    """Move centres, one after the other, to the direction of their vectors; one without vectors goes to seed(), the vector nearest to the centres as they are by then."""
    for c, n in enumerate(counts):
        length = np.linalg.norm(sums[c])
        if not n:
            centres[c] = seed()
        elif length > EPSILON:
            centres[c] = sums[c] / length


def kmeans_labels(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Clusters by cosine, without chance: the first centre is the first vector, each next one the vector farthest from all
    centres (the last of equal ones); in each round vectors go to the nearest centre (the first of equal ones)."""
    k = max(min(k, len(x)), 1)
    chosen = [0]
    while len(chosen) < k:
        far = np.maximum(1 - _cosines(x, x[chosen]).max(axis=1), 0) ** 2
        chosen.append(len(chosen) % len(x) if far.sum() <= EPSILON else len(far) - 1 - int(far[::-1].argmax()))
    centres = x[chosen].copy()
    labels = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        now = _cosines(x, centres).argmax(axis=1)
        stable, labels = (now == labels).all(), now
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, x)
        moved(centres, sums, np.bincount(labels, minlength=k), lambda: nearest(x, centres))
        if stable:
            break
    return first_appearance(labels)


def agglomerate_labels(x: np.ndarray, threshold: float = 0.62, least: int = 2, most: int = 8, dense: int = 512) -> np.ndarray:
    """Clusters merged by the cosine of their centres, the closest pair first, down to least while threshold is reached, and to most in any case.

    Of equally close pairs, to 12 places, the first. Up to dense vectors the cosines
    of all pairs are held; beyond, each cluster's closest one, which is sought in
    cells of directions (see Directions), so memory grows with the vectors and not
    with their pairs.
    """
    merge = _merged_densely if len(x) <= dense else _merged_by_cells
    return first_appearance(merge(x.astype(np.float64), threshold * PLACES, least, most))


def _merged_densely(sums: np.ndarray, threshold: float, least: int, most: int) -> np.ndarray:
    n = left = len(sums)
    parents = list(range(n))
    own, sought = np.hstack([units(sums), np.zeros((n, 1))]), np.ones(sums.shape[1] + 1)
    close = np.rint(own @ own.T * PLACES)
    close[np.tril_indices(n)] = GONE * PLACES
    while left > least:
        i, j = divmod(int(close.argmax()), n)
        if close[i, j] < threshold and left <= most:
            break
        sums[i] += sums[j]
        parents[j] = i
        own[i, :-1], own[j, :-1], own[j, -1] = direction(sums[i]), 0.0, GONE
        sought[:-1] = own[i, :-1]
        now = np.rint(own @ sought * PLACES)
        close[:i, i], close[i, i + 1 :] = now[:i], now[i + 1 :]
        close[j], close[:, j] = GONE * PLACES, GONE * PLACES
        left -= 1
    for c in range(n):  # a parent comes before its clusters
        parents[c] = parents[parents[c]]
    return np.array(parents)


def _merged_by_cells(sums: np.ndarray, threshold: float, least: int, most: int) -> np.ndarray:
    """The closest one of a cluster was the closest when it was sought; as clusters merged later look for themselves, it
    bounds the pairs with older ones from above, and is sought anew only when it comes first and no longer exists."""
    n = left = built = len(sums)
    parents, alive, version = np.arange(n), np.ones(n, bool), [0] * n
    index = Directions(parents, units(sums))

    def sought(c: int) -> tuple:
        close, other = index.closest(c)
        return -close, min(c, other), max(c, other), c, version[c], version[other]

    heap = [sought(c) for c in range(n)] if n > 1 else []
    heapq.heapify(heap)
    while left > least and heap:
        close, i, j, c, mine, others = heap[0]
        if version[c] != mine:
            heapq.heappop(heap)
        elif version[i + j - c] != others:
            heapq.heapreplace(heap, sought(c))
        elif -close < threshold and left <= most:
            break
        else:
            heapq.heappop(heap)
            sums[i] += sums[j]
            parents[j], alive[j], version[j] = i, False, -1
            version[i] += 1
            left -= 1
            if left < 0.7 * built:
                rest = np.flatnonzero(alive)
                index, built = Directions(rest, units(sums[rest])), left
            else:
                index.replace(i, j, direction(sums[i]))
            if left > 1:
                heapq.heappush(heap, sought(i))
    for c in range(n):  # a parent comes before its clusters
        parents[c] = parents[parents[c]]
    return parents


def cluster_sessions(embeddings: DataFrame, k: int | None = None, most_items: int | None = None) -> DataFrame:
    """(session_id, emb_id, cluster): clusters of each session's vectors, with k of them or, without k, by agglomeration.

    Vectors that are null, empty or of another length than the session's first are
    left out; copies by emb_id count once; order is that of start_ms and emb_id.
    All vectors of a session meet in one task, up to most_items of them, by default
    100,000 with k and 2,000,000 without. With k, larger sessions are clustered by
    the same rule in passes over distributed rows (see kmeans.spread_kmeans); they
    are found by one count, copies included, and there are at most one per
    most_items rows. Without k they are refused, as each merge depends on all
    merges before and the task holds about 1 KB a vector.
    """
    from voxloom.operators.kmeans import spread_kmeans

    most_items = most_items or (100_000 if k else 2_000_000)

    def label(table: pa.Table) -> pa.Table:
        if len(table) > most_items:
            raise ValueError(f"a session has {len(table)} vectors; most_items is {most_items}")
        table = table.take(pc.sort_indices(table, [("start_ms", "ascending"), ("emb_id", "ascending")], null_placement="at_start"))
        sizes = pc.list_value_length(table["vector"])
        table = table.filter(pc.equal(sizes, sizes[0]))
        x = np.array(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(table), -1)
        found = np.zeros(len(x), np.int64) if len(x) < 2 else kmeans_labels(x, k) if k else agglomerate_labels(x)
        return pa.table({"session_id": table["session_id"], "emb_id": table["emb_id"], "cluster": pa.array(found, pa.int64())})

    usable = embeddings.where((F.size("vector") > 0) & F.col("session_id").isNotNull())
    rows = usable.dropDuplicates(["emb_id"]).select("session_id", "emb_id", "start_ms", "vector")
    large = [r["session_id"] for r in usable.groupBy("session_id").count().where(F.col("count") > most_items).collect()] if k else []
    small = rows.where(~F.col("session_id").isin(large)) if large else rows
    out = small.groupBy("session_id").applyInArrow(label, "session_id string, emb_id long, cluster long")
    return out.unionByName(spread_kmeans(rows.where(F.col("session_id").isin(large)), k)) if large else out


def cluster_stats(embeddings: DataFrame, assigned: DataFrame) -> DataFrame:
    """(session_id, cluster, talk_time_ms, segment_count) of vectors (emb_id, session_id, start_ms, end_ms) with a cluster (emb_id, cluster), each once."""
    spent = F.greatest(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(0))
    rows = embeddings.select("emb_id", "session_id", spent.alias("_ms")).join(assigned.select("emb_id", "cluster"), "emb_id")
    return rows.groupBy("session_id", "cluster").agg(F.sum("_ms").alias("talk_time_ms"), F.count("*").alias("segment_count"))
