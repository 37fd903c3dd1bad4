"""Cutting of oversized texts and recordings into pieces at natural boundaries."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unicode white space, and the signs that end a sentence.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STOPS = ".!?…。！？"

_UNBROKEN = re.compile(f"[^{WHITE}{STOPS}]+")
_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
_LINE = re.compile(f"[^{_ENDS}]*[{_ENDS}]*")
_SENTENCE = re.compile(f"[^{STOPS}]*(?:[{STOPS}]+[\"'”’»)\\]]*[{WHITE}]*|$)")
_WORD = re.compile(f"[^{WHITE}]*[{WHITE}]*")
#: Strength of the boundary after an atom: inside a word, at its end, at the end of a sentence, of a line.
INSIDE, AFTER_WORD, AFTER_SENTENCE, AFTER_LINE = range(4)


def merge_weakest(sizes: list[int], strengths: list[float], limit: int) -> list[int]:
    """Join atoms in a row into pieces of at most limit; the index of each piece's first atom.

    strengths[i] is that of the boundary after atom i. Adjacent pairs wait in a
    heap; the weakest boundary goes first, of equal ones the pair with the least
    joint size, then the first. A pair that would exceed limit is dropped, and
    stays apart, as sizes only grow.
    """
    n = len(sizes)
    size, left, right = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(strengths[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1) if size[i] + size[i + 1] <= limit]
    heapq.heapify(heap)
    last = list(range(n))  # of a piece that begins at i, its last atom
    while heap:
        _, total, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b] and right[a] == b and size[a] + size[b] == total):
            continue
        size[a], alive[b], last[a] = total, False, last[b]
        right[a] = right[b]
        if right[b] < n:
            left[right[b]] = a
            if total + size[right[b]] <= limit:
                heapq.heappush(heap, (strengths[last[a]], total + size[right[b]], a, right[b]))
        if left[a] >= 0 and total + size[left[a]] <= limit:
            heapq.heappush(heap, (strengths[last[left[a]]], total + size[left[a]], left[a], a))
    return [i for i in range(n) if alive[i]]


def _text_atoms(text: str, limit: int, first: int) -> tuple[list[int], list[int]]:
    """Sizes of atoms, and the strength of the boundary after each.

    A line, sentence or word that fits into limit, or at the start of the text into
    first, is one atom: all boundaries in it are weaker than the one at its end and
    every merge within it fits, so the heap would join it anyway. Only what doesn't
    fit is taken apart further.
    """
    sizes: list[int] = []
    strengths: list[int] = []

    def take(part: str, level: int) -> None:
        room = limit if sizes else first
        if len(part) <= room:
            sizes.append(len(part))
            strengths.append(level)
        elif level == INSIDE:
            for at in [0, *range(room, len(part), limit)]:
                sizes.append(min(limit if at else room, len(part) - at))
                strengths.append(INSIDE)
        else:
            pattern = {AFTER_LINE: _SENTENCE, AFTER_SENTENCE: _WORD}.get(level)
            if pattern is None:  # a word with its stops and blanks: what is unbroken, and each sign
                parts = [p for p in re.split(f"([{WHITE}{STOPS}])", part) if p]
            else:
                parts = [m.group() for m in pattern.finditer(part) if m.group()]
            for p in parts:
                take(p, level - 1)
            strengths[-1] = max(strengths[-1], level)

    for m in _LINE.finditer(text):
        if m.group():
            take(m.group(), AFTER_LINE)
    return sizes, strengths


def text_pieces(text: str, limit: int = 4000, overlap: int = 200) -> tuple[list[tuple[int, int]], int]:
    """(start, end) of pieces of at most limit code points, and 1 if a cut inside a word is forced.

    Each piece but the first repeats the last overlap code points of the one
    before; the first one may hold as much more of its own. forced: a cut was made
    in more than limit code points in a row that hold neither white space nor a
    stop. A text within limit is one piece, an empty one none.
    """
    if not text:
        return [], 0
    if len(text) <= limit:
        return [(0, len(text))], 0
    sizes, strengths = _text_atoms(text, limit - overlap, limit)
    firsts = merge_weakest([sizes[0] - overlap, *sizes[1:]], strengths, limit - overlap)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    edges = [int(starts[i]) for i in firsts] + [len(text)]
    unbroken = ((m.start(), m.end()) for m in _UNBROKEN.finditer(text) if m.end() - m.start() > limit)
    forced = int(any(edges[bisect_right(edges, a)] < b for a, b in unbroken))
    return [(max(a - overlap, 0), b) for a, b in zip(edges, edges[1:])], forced


def quiet_places(samples: np.ndarray, rate: int, channels: int, level: float = 0.02, least_s: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """First frame, and the frame behind the last, of runs of at least least_s seconds with all values within level of zero."""
    frames = len(samples) // channels
    values = np.abs(np.asarray(samples[: frames * channels], np.float64).reshape(frames, channels))
    with np.errstate(invalid="ignore"):
        quiet = (values <= level + 1e-9).all(axis=1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(np.int8), [0]])))
    first, behind = edges[::2], edges[1::2]
    long = (behind - first) * 1.0 >= least_s * rate - 1e-9
    return first[long], behind[long]


def audio_pieces(samples: np.ndarray, rate: int, channels: int, limit_s: float = 30, overlap_s: float = 1) -> tuple[list[tuple[int, int]], int]:
    """(start, end) in frames of pieces of at most limit_s, and 1 if a cut outside quiet places is forced.

    Atoms end in the middle of quiet places, whose length is the strength of the
    boundary, and, in a quiet place that is itself too long, after each limit.
    forced: a cut was made in more than limit_s of frames in a row, outside quiet
    places, that hold none. The first piece repeats nothing and may hold as much
    more of its own.
    """
    frames = len(samples) // channels if channels else 0
    limit, overlap = int(limit_s * rate), int(overlap_s * rate)
    if frames == 0 or rate <= 0:
        return [], 0
    if frames <= limit:
        return [(0, frames)], 0
    first, behind = quiet_places(samples, rate, channels)
    cuts = {int(m): float(n) for m, n in zip((first + behind) // 2, behind - first) if 0 < m < frames}
    core = max(limit - overlap, 1)
    edges = [0]
    for at in [*sorted(cuts), frames]:
        inside = np.searchsorted(behind, edges[-1], side="right") < len(first)
        while at - edges[-1] > (core if edges[-1] else limit):  # a quiet place may reach further than its middle
            low, high = edges[-1], edges[-1] + (core if edges[-1] else limit)
            near = [min(int(b), high) for a, b in zip(first, behind) if a < high and b > low and a <= high] if inside else []
            step = max((x for x in near if low < x <= high), default=high)
            cuts.setdefault(step, 0.0)
            edges.append(step)
        if at > edges[-1]:
            edges.append(at)
    sizes = [b - a for a, b in zip(edges, edges[1:])]
    firsts = merge_weakest([sizes[0] - overlap, *sizes[1:]], [cuts.get(b, 0.0) for b in edges[1:]], core)
    marks = [edges[i] for i in firsts] + [frames]
    loud = zip([0, *behind.tolist()], [*first.tolist(), frames])
    forced = int(any(b - a > limit and marks[bisect_right(marks, a)] < b for a, b in loud))
    return [(max(a - overlap, 0), b) for a, b in zip(marks, marks[1:])], forced


_PIECES = "item string, session_id string, idx long, piece int, start_at long, end_at long, forced int"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["item", "session_id", "idx", "piece", "start_at", "end_at", "forced"])


def pieces(transcripts: DataFrame, chunks: DataFrame, limit: int = 4000, overlap: int = 200, limit_s: int = 30, overlap_s: int = 1) -> DataFrame:
    """Numbered pieces of the texts and audio chunks beyond the limits, as places in them.

    (item, session_id, idx, piece, start_at, end_at, forced): item 'text' with
    idx -1 and code points, item 'audio' with the chunk's idx and frames. Only
    items beyond the limit occur; null, empty and shorter ones, and sample rates
    of 0 or null, give no rows. Copies of an item count once; other columns are
    ignored. Texts are taken whole, one at a time.

    Method: atoms between natural boundaries, adjacent pairs in a heap, weakest
    boundaries merged first while a piece and its overlap stay within the limit.
    forced is told from the cuts that were made.
    """
    texts = transcripts.where(F.length("raw_text") > limit).select("session_id", "raw_text")

    def cut_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for session, text in zip(frame["session_id"], frame["raw_text"]):
                places, forced = text_pieces(text, limit, overlap)
                rows += [("text", session, -1, n, a, b, forced) for n, (a, b) in enumerate(places)]
            yield _frame(rows)

    channels = F.greatest(F.coalesce("channels", F.lit(1)), F.lit(1)).cast("long")
    sound = chunks.where((F.col("sample_rate") > 0) & (F.floor(F.size("samples") / channels) > F.col("sample_rate").cast("long") * limit_s))
    sound = sound.select("session_id", "idx", "sample_rate", channels.alias("channels"), "samples")

    def cut_audio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for session, idx, rate, n_channels, samples in zip(*(frame[c] for c in ("session_id", "idx", "sample_rate", "channels", "samples"))):
                values = np.array([np.nan if v is None else v for v in samples] if samples.dtype == object else samples, np.float64)
                places, forced = audio_pieces(values, int(rate), int(n_channels), limit_s, overlap_s)
                rows += [("audio", session, idx, n, a, b, forced) for n, (a, b) in enumerate(places)]
            yield _frame(rows)

    cut = texts.mapInPandas(cut_texts, _PIECES).unionByName(sound.mapInPandas(cut_audio, _PIECES))
    return cut.dropDuplicates(["item", "session_id", "idx", "piece"])
