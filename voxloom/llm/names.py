"""Names of speakers: spellings, default names and who is meant."""

from __future__ import annotations

import re
import unicodedata

# Titles before names, and words of default names, in lower case.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "mx", "miss", "sir", "herr", "frau", "mme", "mlle", "sr", "sra", "señor", "señora", "don", "doña"}
DEFAULT_WORDS = "speaker|spk|说话人|說話人|发言人|讲话人|sprecher|sprecherin|locuteur|intervenant|hablante|orador|locutor|спикер|говорящий|participant"
UNKNOWN = {"unknown", "unknown speaker", "unbekannt", "inconnu", "desconocido", "неизвестно", "未知", "n/a", "none", "null"}

_DEFAULT = re.compile(rf"(?:{DEFAULT_WORDS})[\s_#:-]*0*(\d+)")
_ROLE = re.compile(r"[(\[{<（【][^)\]}>）】]*[)\]}>）】]")
_PART = re.compile(r"[^\W\d_]+", re.UNICODE)


def default_id(name: str | None) -> int | None:
    """The speaker_id of a default name, which counts from 1; None for other names."""
    m = _DEFAULT.fullmatch(unicodedata.normalize("NFKC", name or "").strip().lower())
    return max(int(m[1]) - 1, 0) if m and len(m[1]) < 18 else None


def name_parts(name: str | None) -> tuple[str, ...]:
    """The parts of a name in lower case, sorted, without titles, roles and signs; () if it is default or no name."""
    if not name or default_id(name) is not None:
        return ()
    text = unicodedata.normalize("NFKC", name).casefold()
    text = _ROLE.sub(" ", text)
    if text.strip() in UNKNOWN:
        return ()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    parts = [p for p in _PART.findall(text) if p not in TITLES]
    return tuple(sorted(parts))


def one_slip(a: str, b: str) -> bool:
    """Equal but for one letter added, left out, replaced or swapped with its neighbour; both of four letters or more."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def _part_fits(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    return one_slip(a, b)


def fits(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether a and b can be spellings of one name: each part of the shorter fits another part of the longer; a single part fits no initial."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return any(one_slip(a[0], x) for x in b)

    place: dict[int, int] = {}  # of each part of a, the part of b that it fits
    taken: dict[int, int] = {}
    for i in range(len(a)):
        came: dict[int, int] = {}
        queue, free = [i], None
        for x in queue:
            for j, part in enumerate(b):
                if j not in came and _part_fits(a[x], part):
                    came[j] = x
                    if j not in taken:
                        free = j
                        break
                    queue.append(taken[j])
            if free is not None:
                break
        if free is None:
            return False
        while free is not None:  # parts along the path move on to their next place
            x = came[free]
            taken[free], place[x], free = x, free, place.get(x)
    return bool(a)


def _rank(parts: tuple[str, ...]) -> int:
    """0: at least two full parts, 1: two parts with initials, 2: one part."""
    return 2 if len(parts) < 2 else int(any(len(p) == 1 for p in parts))


class Persons:
    """Who the labels of one session name.

    Full names that fit each other, directly or through others, are one person;
    initials and single names join the one person that they fit, and are a
    person of their own if none or more than one does. An id without a name, or
    with a default one, is a person of its own. persons maps each id to the
    smallest id of its person.
    """

    def __init__(self, labels: dict[int, str | None]):
        known = {i: p for i, n in labels.items() if (p := name_parts(n))}
        groups: list[dict] = []
        for parts in sorted(set(known.values()), key=lambda p: (_rank(p), p)):
            ids = [i for i, p in known.items() if p == parts]
            rank = _rank(parts)
            near = [g for g in groups if any(fits(parts, q) and (rank or len(q) == len(parts)) for q in g["names"])]
            if near and (len(near) == 1 or not rank):
                for g in near[1:]:
                    near[0]["names"] += g["names"]
                    near[0]["ids"] += g["ids"]
                    groups.remove(g)
                near[0]["names"].append(parts)
                near[0]["ids"] += ids
            else:
                groups.append({"names": [parts], "ids": ids})
        self._groups = groups
        self.persons = {i: i for i in labels} | {i: min(g["ids"]) for g in groups for i in g["ids"]}

    def who(self, name: str) -> int | None:
        """The person a name in a text means; None if it names none or may name several."""
        if (n := default_id(name)) is not None:
            return self.persons.get(n, n)
        if not (parts := name_parts(name)):
            return None
        near = [g for g in self._groups if parts in g["names"]] or [g for g in self._groups if any(fits(parts, q) for q in g["names"])]
        if len(near) > 1 and _rank(parts) == 0:
            near = [g for g in near if any(_rank(q) == 0 for q in g["names"])]
        return min(near[0]["ids"]) if len(near) == 1 else None
