"""Packing of lines into pieces for a model's context."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

ENDS = "。!?….;"  # fixed values: signs at which a piece may end


def _cuts(lines: list[str], target: int) -> list[tuple[int, int]]:
    """(first, behind the last) of the lines of each piece, none of which is longer than target."""
    before = [0, *accumulate(len(line) + 1 for line in lines)]  # characters before each line, with line ends
    at_end = [line.rstrip()[-1:] in {*ENDS} for line in lines]
    filled = [n for n, line in enumerate(lines) if line]
    out, first = [], 0
    while (n := bisect_right(filled, first - 1)) < len(filled):
        first = filled[n]  # no piece begins with an empty line
        soft, hard = (max(bisect_right(before, before[first] + 1 + room) - 1, first + 1) for room in (target, target * 3 // 2))
        behind = next((i for i in range(soft, min(hard, len(lines))) if at_end[i - 1]), min(hard, len(lines)))
        out.append((first, behind))
        first = behind
    return out


def pack_lines(text: str | None, target: int = 4000, most_pieces: int = 40) -> list[str]:
    """Lines packed in order into pieces of about target characters.

    A line above target stands alone. A piece ends before a line that would take it
    beyond target if it ends a sentence, or beyond one and a half times target in
    any case. More than most_pieces are joined in equal groups of neighbours. Null
    and empty texts give none.
    """
    if not text:
        return []
    lines = [line.removesuffix("\r") for line in text.removesuffix("\n").split("\n")]
    pieces: list[str] = []
    large = [n for n, line in enumerate(lines) if len(line) > target]
    for first, behind in zip([0, *(n + 1 for n in large)], [*large, len(lines)]):
        stretch = lines[first:behind]
        pieces += ["\n".join(stretch[a:b]) for a, b in _cuts(stretch, target)] + lines[behind : behind + 1]
    per = -(-len(pieces) // most_pieces)
    return ["\n".join(pieces[i : i + per]) for i in range(0, len(pieces), per)] if pieces else []
