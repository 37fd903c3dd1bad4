"""Texts of diagrams (mind maps, graphs) and JSON in the answers of models: checks, repair, extraction, as columns in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a diagram begins with; pairs of brackets; what begins a node whose id is missing.
HEADS = ("mindmap", "graph", "flowchart")
PAIRS = ("[]", "()", "{}")
BARE = ("((", "[[", "{{", "))", "]]", "}}")

_BREAK = re.compile(r"\r?\n")


def _lines(text: str) -> list[str]:
    out = _BREAK.split(text)
    return out[:-1] if out and not out[-1] else out


def _headed(line: str) -> bool:
    return line.strip().lower().startswith(HEADS)


def _bare(line: str) -> bool:
    return line.strip().startswith(BARE)


def diagram_issues(text: str) -> list[str]:
    """What keeps a diagram from being drawn: empty, head, unbalanced <pair>, quotes, and line <n> for a node without id."""
    text = text.strip()
    if not text:
        return ["empty"]
    lines, found = _lines(text), []
    if not _headed(lines[0]):
        found.append("head")
    outside = "".join(text.split('"')[::2])
    for pair in PAIRS:
        depth = lowest = 0
        for c in outside:
            depth += (c == pair[0]) - (c == pair[1])
            lowest = min(lowest, depth)
        if depth or lowest:
            found.append(f"unbalanced {pair}")
    if text.count('"') % 2:
        found.append("quotes")
    return found + [f"line {n}" for n, line in enumerate(lines, 1) if n > 1 and _bare(line)]


def repaired_diagram(text: str) -> str:
    """With ids n1, n2, ... put before nodes that lack one; the first line stays."""
    out, given = [], 0
    for n, line in enumerate(_lines(text)):
        if n and _bare(line):
            given += 1
            body = line.strip()
            line = f"{line[: len(line) - len(line.lstrip())]}n{given}{body}"
        out.append(line)
    return "\n".join(out).rstrip()


def extracted_diagram(text: str) -> str:
    """The diagram in a model's answer: without fences and what precedes its first line."""
    text = re.sub(r"^```(?:mermaid|Mermaid|mmd)?", "", text.strip())
    text = text[: text.rfind("```")] if "```" in text else text
    lines = _lines(text.strip())
    first = next((n for n, line in enumerate(lines) if _headed(line)), None)
    return text.strip() if first is None else "\n".join(lines[first:]).rstrip()


def _enclosed(text: str) -> str | None:
    """What the last square or curly bracket encloses."""
    close = max(text.rfind("]"), text.rfind("}"))
    if close < 0:
        return None
    opening, depth = {"]": "[", "}": "{"}[text[close]], 0
    for at in range(close, -1, -1):
        depth += (text[at] == text[close]) - (text[at] == opening)
        if depth == 0:
            return text[at + 1 : close].strip() or None
    return None


def node_text(text: str) -> str:
    """The label of a node, without id, shape, style and arrows."""
    text = re.sub("-->|---|->", " ", text.strip().partition(":::")[0]).strip()
    if (inner := _enclosed(text)) is not None:
        return inner
    m = re.fullmatch(r"([A-Za-z0-9_-][A-Za-z0-9_ -]*?)\s*(\(.*\))", text, re.DOTALL)
    if m and " " not in m[1]:
        text = m[2].lstrip("(").rstrip(")").strip()
    while len(text) > 1 and text[0] == "(" and text[-1] == ")" and text[1:-1].strip():
        text = text[1:-1].strip()
    return text.lstrip("-> ").strip()


def diagram_outline(text: str) -> str:
    """A diagram as an indented list, two blanks a level, the least indented node being at the first."""
    lines = _lines(text)
    first = next((n for n, line in enumerate(lines) if _headed(line)), len(lines))
    nodes = [(len(line) - len(line.lstrip(" ")), node_text(line)) for line in lines[first + 1 :] if line.strip() and not line.strip().startswith("%%")]
    nodes = [(indent, label) for indent, label in nodes if label]
    least = min((indent for indent, _ in nodes), default=0)
    return "\n".join(f"{'  ' * ((indent - least) // 2)}- {label}" for indent, label in nodes).rstrip()


def balanced_object(text: str) -> str | None:
    """The first JSON object in a text, by balanced braces outside of strings."""
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.DOTALL).finditer(text, start):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0:
            return text[start : m.end()]
    return None


def _column(function, kind: str):
    def of(text: str | Column) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else function(t) for t in texts], dtype=object)

        return F.pandas_udf(run, kind)(F.col(text) if isinstance(text, str) else text)

    of.__doc__ = f"{function.__doc__} Null stays null."
    return of


issues_of = _column(diagram_issues, "array<string>")
repaired = _column(repaired_diagram, "string")
extracted = _column(extracted_diagram, "string")
outline_of = _column(diagram_outline, "string")
label_of = _column(node_text, "string")
json_of = _column(balanced_object, "string")

_VERDICT = "struct<scene: string, confidence: float, evidence: string, suggested_focus: array<string>>"
# Kinds of recordings.
SCENES = ("lecture", "meeting", "interview", "other")


def scene_verdict(text: str | Column) -> Column:
    """(scene, confidence, evidence, suggested_focus) from a model's answer with a JSON object; null without one or without a scene.

    A scene that isn't known is 'other'; confidence is 0.5 if absent and lies within 0 and 1.
    """
    x = F.from_json(json_of(text), _VERDICT)
    scene = F.lower(F.trim(x["scene"]))
    out = F.struct(
        F.when(scene.isin(*SCENES), scene).otherwise("other").alias("scene"),
        F.least(F.greatest(F.coalesce(x["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).cast("float").alias("confidence"),
        F.coalesce(x["evidence"], F.lit("")).alias("evidence"), F.coalesce(x["suggested_focus"], F.array().cast("array<string>")).alias("suggested_focus"),
    )
    return F.when(x["scene"].isNotNull(), out)
