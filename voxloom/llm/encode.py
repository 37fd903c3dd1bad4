"""Encoding of texts with a public byte-level BPE, reusing content-defined chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 16  # bytes under the rolling hash
CACHE_BYTES = 48 << 20
_SPACES = np.isin(np.arange(256), [9, 10, 13, 32])
_NOT_BEFORE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])


def default_vocabulary() -> str:
    """The path of the public vocabulary byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # White space is Unicode's in the tokenizer's engine, while regex counts the separators 1C to 1F as well.
    words = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return tiktoken.Encoding("voxloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(words)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor, and of its inverse modulo 2**64."""
    factor = 0x9E3779B97F4A7C15
    out = []
    for x in (factor, pow(factor, -1, 1 << 64)):
        with np.errstate(over="ignore"):
            out.append(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))]))
    return out[0], out[1]


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For each place i the hash of the WINDOW bytes before it, mixed; places before WINDOW have 0."""
    n = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), sums])
        out = np.zeros(len(data) + 1, np.uint64)
        out[WINDOW:] = (sums[WINDOW:] - sums[:-WINDOW]) * inverse[: len(sums) - WINDOW]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(32)


def chunk_edges(data: np.ndarray, offsets: np.ndarray, mean_words: int = 64, longest: int = 2048, mean_bytes: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Edges of chunks in texts that lie one behind the other in data, and which may split a word.

    An edge lies where the hash of the bytes before it says so, so equal
    stretches of text are cut alike wherever they occur. Edges are taken where
    white space follows something else, one in mean_words; where these lie more
    than longest apart, also before any character, one in mean_bytes.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n <= WINDOW:
        return np.flatnonzero(edge), np.zeros(int(edge.sum()), bool)
    hashes = rolling_hash(data)
    soft = np.zeros(n + 1, bool)
    soft[1:n] = _SPACES[data[1:]] & ~_NOT_BEFORE[data[:-1]]
    edge |= soft & (hashes % np.uint64(mean_words) == 0)
    places = np.flatnonzero(edge)
    inside = np.zeros(n + 1, bool)
    for k in np.flatnonzero(np.diff(places) > longest):
        a, b = places[k] + WINDOW, places[k + 1]
        inside[a:b] = (hashes[a:b] % np.uint64(mean_bytes) == 1) & ((data[a:b] & 0xC0) != 0x80)
    edge |= inside
    places = np.flatnonzero(edge)
    return places, inside[places]


class ChunkEncoder:
    """Encodes batches of texts; chunks seen before are taken from a bounded cache."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.encoding, self.pattern = _encoding(path)
        self.cache: dict[bytes, np.ndarray] = {}
        self.room = self.cache_bytes = cache_bytes
        self.encoded = self.reused = 0

    def _ids(self, chunk: bytes) -> np.ndarray:
        ids = self.cache.get(chunk)
        if ids is not None:
            self.reused += 1
            return ids
        self.encoded += 1
        ids = np.array(self.encoding.encode_ordinary(chunk.decode("utf-8")), np.int32)
        cost = len(chunk) + ids.nbytes + 200
        if cost > self.room:  # drop the older half
            for old in list(self.cache)[: len(self.cache) // 2 + 1]:
                self.room += len(old) + self.cache.pop(old).nbytes + 200
        if cost <= self.room:
            self.cache[chunk] = ids
            self.room -= cost
        return ids

    def _repaired(self, left: bytes, left_ids: np.ndarray | None, right: bytes, right_ids: np.ndarray) -> list[tuple[bytes, np.ndarray | None]]:
        """Parts that stand for left followed by right, each of whole words of the joint text.

        The last but one word of left begins at a place where the pattern also
        begins a word in the joint text (the last one need not: an apostrophe
        before it may become part of it). From there that is split again until a word begins
        where one begins in right alone: from there on both agree, and only what
        lies between is encoded anew. If they never agree, what follows left's whole
        words stays open (without ids) and is encoded once the next agreement is met.
        """
        encode = self.encoding.encode_ordinary
        a, b = left.decode("utf-8"), right.decode("utf-8")
        last = before_last = 0
        for m in self.pattern.finditer(a):
            before_last, last = last, m.start()
        last = before_last
        tail = a[last:]
        whole = left_ids[: len(left_ids) - len(encode(tail))] if left_ids is not None else None
        # Words are encoded one by one: without what follows it, white space would split otherwise.
        ids_before = {0: 0}
        for m in self.pattern.finditer(b):
            ids_before[m.end()] = ids_before[m.start()] + len(encode(m.group()))
        middle: list[int] = []
        joint_words = list(self.pattern.finditer(tail + b))
        # What follows right may yet change where its last word begins, so that is no agreement.
        for m in joint_words[:-2]:
            middle += encode(m.group())
            at = m.end() - len(tail)
            if 0 <= at < len(b) and at in ids_before:
                joint = np.array(middle, np.int32)
                parts = [(a[:last].encode("utf-8"), whole), ((tail + b[:at]).encode("utf-8"), joint), (b[at:].encode("utf-8"), right_ids[ids_before[at] :])]
                return [p for p in parts if p[0]]
        return [p for p in ((a[:last].encode("utf-8"), whole), ((tail + b).encode("utf-8"), None)) if p[0]]

    def _document(self, chunks: list[bytes], splits: list[bool]) -> np.ndarray:
        """Ids of one text; splits: whether the edge before a chunk may split a word."""
        parts: list[tuple[bytes, np.ndarray | None]] = []
        for chunk, split in zip(chunks, splits):
            ids = self._ids(chunk)
            if parts and (split or parts[-1][0][-1] >= 0x80 and parts[-1][0].decode("utf-8")[-1].isspace()):
                parts += self._repaired(*parts.pop(), chunk, ids)
            else:
                parts.append((chunk, ids))
        ids = [p if p is not None else self._open(parts, n) for n, (_, p) in enumerate(parts)]
        return np.concatenate(ids) if len(ids) != 1 else ids[0]

    def _open(self, parts: list[tuple[bytes, np.ndarray | None]], n: int) -> np.ndarray:
        """Ids of an open part, split with the start of the text behind it in view, on which the split of white space depends."""
        text = parts[n][0].decode("utf-8")
        after = parts[n + 1][0].decode("utf-8")[:1] if n + 1 < len(parts) else ""
        ids: list[int] = []
        for m in self.pattern.finditer(text + after):
            if m.start() < len(text):
                ids += self.encoding.encode_ordinary(m.group()[: len(text) - m.start()])
        return np.array(ids, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Offsets and arrays of ids for a column of texts; null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        edges, splits = chunk_edges(data, offsets)
        raw = data.tobytes()
        first = np.searchsorted(edges, offsets)
        edge_list = edges.tolist()
        ids: list[np.ndarray] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for n in range(len(texts)):
            i, j = int(first[n]), int(first[n + 1])
            if i < j:
                chunks = [raw[edge_list[k] : edge_list[k + 1]] for k in range(i, j)]
                ids.append(self._document(chunks, splits[i:j].tolist() if j - i > 1 else [False]))
                counts[n + 1] = len(ids[-1])
        return np.cumsum(counts), ids


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text in a public byte-level BPE, special strings being ordinary text.

    Null and empty texts give an empty list; every row of df gives one row, also
    repeated ones and those with a null key. Other columns are ignored. Texts are
    encoded whole; the ids equal those of encoding each text at once.

    Method: texts are cut into chunks at places that a rolling hash of their
    content defines; a chunk that a task has met before, in whatever document, is
    taken from a cache of bounded size. Where a cut lies before white space that
    follows something else, the pattern that splits words begins a word there in
    any case, so the ids of both sides just follow each other. Any other join is
    repaired: re-encoded from the last word before it until both sides agree. There
    is no shuffle; memory is that of one Arrow batch and the cache.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            offsets, ids = encoder.encode(batch.column(1))
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df without text, with n_tokens: the number of ids that encode_texts gives."""
    path = vocabulary or default_vocabulary()
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            offsets, _ = encoder.encode(batch.column(len(rest)))
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets), pa.int64())], [*rest, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, n_tokens long")


def decoded(ids: str, vocabulary: str | None = None) -> Column:
    """The text that ids stand for; null for null."""
    path = vocabulary or default_vocabulary()

    def run(rows: pd.Series) -> pd.Series:
        encoding, _ = _encoding(path)
        return pd.Series([None if x is None else encoding.decode_bytes(list(x)).decode("utf-8", "replace") for x in rows], dtype=object)

    return F.pandas_udf(run, "string")(ids)
