"""Summaries of long texts by a model in two steps: pieces first, then their answers joined."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.packing import pack_lines
from voxloom.functions.text import estimate_tokens

MAP_FROM = 6000  # fixed value: tokens above which a text is summarised in pieces

Model = Callable[[list[str]], list[str]]


def mock_model(prompts: list[str]) -> list[str]:
    """A stand-in for a model: an answer that depends on the whole prompt and on nothing else."""
    return [f"(mock) {hashlib.sha256(p.encode()).hexdigest()[:16]} of {len(p)}" for p in prompts]


def summary_plan(documents: DataFrame, map_from: int = MAP_FROM) -> DataFrame:
    """(session_id, tokens, in_pieces): of each session the estimated tokens of its texts, and whether it is summarised in pieces.

    documents: (session_id, part, text), as documents_of gives them. Null texts
    count as empty.
    """
    rows = documents.groupBy("session_id").agg(F.sum(estimate_tokens(F.coalesce("text", F.lit("")))).alias("tokens"), F.count("*").alias("_parts"))
    return rows.select("session_id", "tokens", ((F.col("tokens") > map_from) | (F.col("_parts") > 1)).alias("in_pieces"))


def pieces_of(documents: DataFrame) -> DataFrame:
    """(session_id, part, piece, text): the texts of documents packed by lines into pieces."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, part, n, x) for s, part, text in zip(frame["session_id"], frame["part"], frame["text"]) for n, x in enumerate(pack_lines(text))]
            yield pd.DataFrame(rows, columns=["session_id", "part", "piece", "text"])

    return documents.select("session_id", F.col("part").cast("long").alias("part"), "text").mapInPandas(cut, "session_id string, part long, piece long, text string")


def ask(prompts: DataFrame, model: Model, batch: int = 32) -> DataFrame:
    """prompts with answer: the model's, asked with at most batch prompts at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[str] = []
            for at in range(0, len(frame), batch):
                found += model(frame["prompt"].iloc[at : at + batch].tolist())
            yield frame.assign(answer=found)

    return prompts.mapInPandas(run, f"{schema}, answer string")


def summarise(documents: DataFrame, model: Model = mock_model, heading: str = "Summarise this recording.", map_from: int = MAP_FROM) -> DataFrame:
    """(session_id, summary, in_pieces, pieces): one summary a session.

    A short text goes to the model with heading. A long one goes in pieces, each
    with heading and its number; their answers, at most 40 a part of the text, then
    go together in the order of the pieces.
    """
    rows = documents.join(summary_plan(documents, map_from), "session_id")
    short = rows.where("not in_pieces").select("session_id", F.lit(False).alias("in_pieces"), F.lit(1).cast("long").alias("pieces"), F.concat(F.lit(f"{heading}\n\n"), F.coalesce("text", F.lit(""))).alias("prompt"))
    number = F.format_string("\n[part %d.%d]\n\n", F.col("part") + 1, F.col("piece") + 1)
    parts = ask(pieces_of(rows.where("in_pieces")).select("session_id", "part", "piece", F.concat(F.lit(heading), number, "text").alias("prompt")), model)
    answers = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "answer"))), lambda x: x["answer"]), "\n\n")
    joined = parts.groupBy("session_id").agg(F.count("*").alias("pieces"), F.concat(F.lit(f"{heading}\n[join]\n\n"), answers).alias("prompt"))
    last = short.unionByName(joined.select("session_id", F.lit(True).alias("in_pieces"), "pieces", "prompt"))
    return ask(last, model).select("session_id", F.col("answer").alias("summary"), "in_pieces", "pieces")
