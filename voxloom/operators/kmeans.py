"""Clusters of sessions too large for one task: kmeans_labels of vectors.py as passes over distributed rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.vectors import EPSILON, _cosines, moved
from voxloom.session import materialize

LEAST = -(2**63)  # stands for null, which comes first


class Starts:
    """The first k vectors in order."""

    @staticmethod
    def of(k: int, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list:
        return [(int(at[i]), int(ids[i]), x[i]) for i in range(min(k, len(x)))]

    @staticmethod
    def both(k: int, a: list, b: list) -> list:
        return sorted(a + b, key=lambda r: r[:2])[:k]


class Farthest:
    """(sum of squared distances to the nearest centre, key of the largest, its vector)."""

    @staticmethod
    def of(centres: np.ndarray, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple:
        far = np.maximum(1 - _cosines(x, centres).max(axis=1), 0) ** 2
        i = len(far) - 1 - int(far[::-1].argmax())
        return float(far.sum()), (float(far[i]), int(at[i]), int(ids[i])), x[i]

    @staticmethod
    def both(_: np.ndarray, a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], *max(a[1:], b[1:], key=lambda r: r[0]))


class Round:
    """(sums, counts, first vector's key of each cluster, number of vectors that changed)."""

    @staticmethod
    def of(centres: tuple[np.ndarray, np.ndarray | None], at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple:
        now, before = centres
        near = _cosines(x, now)
        labels = near.argmax(axis=1)
        old = np.zeros(len(x), np.int64) if before is None else _cosines(x, before).argmax(axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, labels, x)
        first = {int(c): (int(at[i]), int(ids[i])) for c, i in zip(*np.unique(labels, return_index=True))}
        return sums, np.bincount(labels, minlength=len(now)), first, int((labels != old).sum())

    @staticmethod
    def both(_: tuple, a: tuple, b: tuple) -> tuple:
        first = {c: min(f[c] for f in (a[2], b[2]) if c in f) for c in {*a[2], *b[2]}}
        return a[0] + b[0], a[1] + b[1], first, a[3] + b[3]


class Nearest:
    """(key of the vector nearest to any centre, that vector)."""

    @staticmethod
    def of(centres: np.ndarray, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple:
        near = _cosines(x, centres).max(axis=1)
        i = len(near) - 1 - int(near[::-1].argmax())
        return (float(near[i]), int(at[i]), int(ids[i])), x[i]

    @staticmethod
    def both(_: np.ndarray, a: tuple, b: tuple) -> tuple:
        return max(a, b, key=lambda r: r[0])


def _sessions(frame: pd.DataFrame, sizes: dict[str, int]) -> Iterator[tuple[str, pd.DataFrame, np.ndarray]]:
    for session, own in frame.groupby("session_id", sort=False):
        own = own[own["_size"] == sizes[session]].sort_values(["_at", "_id"])
        if len(own):
            yield session, own, np.stack(own["vector"].to_numpy()).astype(np.float64)


def _pass(rows: DataFrame, sizes: dict[str, int], what: type, given: dict[str, Any]) -> dict[str, Any]:
    """what of all vectors of each session in given: combined per task, then on the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Any] = {}
        for frame in frames:
            for session, own, x in _sessions(frame, sizes):
                part = what.of(given[session], own["_at"].to_numpy(), own["_id"].to_numpy(), x)
                found[session] = what.both(given[session], found[session], part) if session in found else part
        yield pd.DataFrame({"session_id": list(found), "part": [pickle.dumps(p) for p in found.values()]}, columns=["session_id", "part"])

    out: dict[str, Any] = {}
    for r in rows.where(F.col("session_id").isin(list(given))).mapInPandas(run, "session_id string, part binary").toLocalIterator():
        part = pickle.loads(r["part"])
        out[r["session_id"]] = what.both(given[r["session_id"]], out[r["session_id"]], part) if r["session_id"] in out else part
    return out


def spread_kmeans(rows: DataFrame, k: int, rounds: int = 25) -> DataFrame:
    """(session_id, emb_id, cluster): as kmeans_labels of each session's vectors, without a limit to their number.

    rows: session_id, emb_id, start_ms, vector, of few sessions, each row once.
    The driver holds the centres of each session. A pass over the rows gives the
    next start or the sums of a round, combined per task, so at most k + rounds
    passes are made, and one for each centre that is left without vectors; sessions
    that are stable are left out of later ones. Sums are
    added up in another order than in kmeans_labels, so vectors as near to two
    centres but for the last digits may go to the other one.
    """
    at, ids = F.coalesce(F.col("start_ms").cast("long"), F.lit(LEAST)), F.coalesce(F.col("emb_id").cast("long"), F.lit(LEAST))
    rows = rows.select("session_id", at.alias("_at"), ids.alias("_id"), F.size("vector").alias("_size"), "vector")
    rows = materialize(rows.repartitionByRange("session_id", "_id"), "large-sessions")
    kinds = rows.groupBy("session_id", "_size").agg(F.min(F.struct("_at", "_id")).alias("first"), F.count("*").alias("n")).collect()
    sizes = {r["session_id"]: r["_size"] for r in sorted(kinds, key=lambda r: r["first"], reverse=True)}
    most = {r["session_id"]: max(min(k, r["n"]), 1) for r in kinds if r["_size"] == sizes[r["session_id"]]}

    starts: dict[str, list] = _pass(rows, sizes, Starts, most)
    centres = {s: x[0][2][None] for s, x in starts.items()}
    while growing := {s: c for s, c in centres.items() if len(c) < most[s]}:
        for s, (total, _, x) in _pass(rows, sizes, Farthest, growing).items():
            centres[s] = np.vstack([centres[s], starts[s][len(centres[s])][2] if total <= EPSILON else x])

    used: dict[str, np.ndarray] = {}
    ranks: dict[str, np.ndarray] = {}
    active: dict[str, tuple[np.ndarray, np.ndarray | None]] = {s: (c, None) for s, c in centres.items()}
    for _ in range(rounds):
        if not active:
            break
        found = _pass(rows, sizes, Round, active)
        for s, (sums, counts, first, changed) in found.items():
            now = active[s][0]
            used[s], ranks[s] = now, np.zeros(len(now), np.int64)
            for rank, c in enumerate(sorted(first, key=first.get)):
                ranks[s][c] = rank
            new = now.copy()
            moved(new, sums, counts, lambda s=s, new=new: _pass(rows, sizes, Nearest, {s: new})[s][1])
            active[s] = (new, now)
            if not changed:
                del active[s]

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for session, own, x in _sessions(frame, sizes):
                yield pd.DataFrame({"session_id": session, "emb_id": own["_id"], "cluster": ranks[session][_cosines(x, used[session]).argmax(axis=1)]})

    out = rows.mapInPandas(label, "session_id string, emb_id long, cluster long")
    return out.withColumn("emb_id", F.when(F.col("emb_id") != LEAST, F.col("emb_id")))
