"""Statistics of the text quality of documents, and labels of their lines by a hidden Markov model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import materialize

# Function words (articles, pronouns, prepositions, conjunctions, auxiliaries, particles) of each language.
ENGLISH = "a an the and or but nor so yet if then than as because while when where although of to in on at by for from with without about into over under after before between through during against am is are was were be been being do does did have has had will would shall should can could may might must i you he she it we they me him her us them my your his its our their this that these those who whom whose which what how there not no"
GERMAN = "der die das den dem des ein eine einen einem einer eines und oder aber denn sondern doch wenn dann als weil dass ob wie wo was wer ich du er sie es wir ihr mich dich ihn uns euch ihnen mein dein sein unser nicht kein keine in im an am auf aus bei mit nach von vom vor zu zum zur für um durch gegen ohne über unter zwischen ist sind war waren bin wird werden wurde hat haben hatte kann können muss soll auch nur noch schon so sehr man sich"
SPANISH = "el la los las un una unos unas lo al del de a en con por para sin sobre entre desde hasta hacia y e o u pero sino ni que si como cuando donde porque aunque yo tú él ella nosotros ellos ellas me te se nos le les su sus mi tu este esta estos estas ese esa eso no es son era eran fue está están ha han hay ser muy más ya también"
FRENCH = "le la les l un une des du de d au aux à en dans par pour sur sous avec sans chez entre vers et ou mais ni car donc que qu qui dont où si comme quand lorsque je tu il elle on nous vous ils elles me te se lui leur son sa ses mon ma mes notre votre ce cet cette ces ne n pas plus est sont était étaient a ont avait sera être très aussi y"
RUSSIAN = "и в во на не ни но а да или что чтобы как так же ли бы если когда где то за из от до по под над при про для без о об у к ко с со я ты он она оно мы вы они меня его её их нас вам им мой свой этот эта это эти тот та те был была было были есть уже ещё только тоже все"
CHINESE = "的了是我你他她它们这那有在和与或不就也都要会能可以把被给对从到向着过得地而但因为所如果很吗呢吧啊"
COMMON = frozenset(" ".join((ENGLISH, GERMAN, SPANISH, FRENCH, RUSSIAN)).split())
COMMON_HAN = frozenset(CHINESE)

STATES = ("prose", "list", "table", "junk")
#: What a line looks like, and how likely that is in each state before anything is fitted.
LOOKS: dict[str, tuple[float, float, float, float]] = {
    "sentence": (0.55, 0.004, 0.002, 0.003),
    "fragment": (0.25, 0.04, 0.01, 0.01),
    "marked item": (0.004, 0.30, 0.005, 0.004),
    "short item": (0.06, 0.40, 0.06, 0.02),
    "inline list": (0.004, 0.16, 0.03, 0.004),
    "row": (0.003, 0.02, 0.55, 0.01),
    "cells": (0.01, 0.03, 0.20, 0.01),
    "number": (0.01, 0.02, 0.08, 0.02),
    "rule": (0.02, 0.01, 0.04, 0.10),
    "code": (0.002, 0.002, 0.002, 0.25),
    "token": (0.003, 0.002, 0.003, 0.25),
    "noise": (0.004, 0.002, 0.004, 0.15),
    "repeat": (0.001, 0.002, 0.002, 0.15),
    "garbled": (0.002, 0.002, 0.002, 0.25),
    "other": (0.10, 0.05, 0.03, 0.05),
}
_LOOK = {name: n for n, name in enumerate(LOOKS)}
PRIOR = np.array(list(LOOKS.values()))
STAY = 0.9  # of the prior: the next line has the same state
ROUNDS = 8
WEIGHT = 5.0  # of the prior, in times of the lines given
LEAST_LINES = 5000
PART_LINES = 1 << 18  # lines of the documents that are handled in step, unless one has more


class LineModel:
    """The probabilities of a hidden Markov model of lines: start of each state, transitions, and looks in each state."""

    def __init__(self, start: np.ndarray, transition: np.ndarray, emission: np.ndarray):
        self.start, self.transition, self.emission = start, transition, emission

    @classmethod
    def prior(cls) -> LineModel:
        return cls(np.array([0.5, 0.3, 0.1, 0.1]), np.where(np.eye(4, dtype=bool), STAY, (1 - STAY) / 3), PRIOR / PRIOR.sum(axis=0))

    def values(self) -> list[float]:
        return np.concatenate([self.start, self.transition.ravel(), self.emission.ravel()]).tolist()

    @classmethod
    def of(cls, values) -> LineModel:
        v = np.asarray(values, np.float64)
        return cls(v[:4], v[4:20].reshape(4, 4), v[20:].reshape(-1, 4))

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.log(self.start), np.log(self.transition), np.log(self.emission)

    @classmethod
    def fitted(cls, looks: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS, weight: float = WEIGHT) -> LineModel:
        """By expectation and maximisation from the prior, which counts as much as weight times the lines given, or LEAST_LINES if these are fewer.

        looks: of the lines of documents, one behind the other; lengths: lines of
        each. The prior keeps the states what their names say; the data tell how
        often each look and each change of state occurs. Without lines, the prior.
        """
        lengths = lengths[lengths > 0]
        return cls.iterated(lambda now: now._expected(looks, lengths), int(lengths.sum()), len(lengths), rounds, weight)

    @classmethod
    def iterated(cls, expected: Callable[[LineModel], tuple], lines: int, docs: int, rounds: int = ROUNDS, weight: float = WEIGHT) -> LineModel:
        """As fitted, by the sums of _expected over docs documents with lines lines, wherever they are taken."""
        prior = now = cls.prior()
        n, d = max(float(lines), LEAST_LINES), max(float(docs), LEAST_LINES / 10)
        for _ in range(rounds if lines else 0):
            start, pairs, seen = expected(now)
            start = start + weight * d * prior.start
            pairs = pairs + weight * n * 0.25 * prior.transition
            seen = seen + weight * n * 0.25 * prior.emission
            now = cls(start / start.sum(), pairs / pairs.sum(axis=1, keepdims=True), seen / seen.sum(axis=0))
        return now

    def _expected(self, looks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often, by the model, each state comes first, each pair of states in a row, and each look in a state."""
        firsts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        firsts, lengths = firsts[order], lengths[order]
        e = self.emission[looks]
        forward, scale = np.zeros((len(looks), 4)), np.ones(len(looks))
        backward = np.ones((len(looks), 4))
        counts = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]  # documents of more than t lines
        for t, n in enumerate(counts):
            at = firsts[:n] + t
            f = e[at] * (self.start if t == 0 else forward[at - 1] @ self.transition)
            scale[at] = f.sum(axis=1)
            forward[at] = f / scale[at, None]
        pairs = np.zeros((4, 4))
        for t in range(len(counts) - 1, 0, -1):
            at = firsts[: counts[t]] + t
            later = e[at] * backward[at] / scale[at, None]
            pairs += forward[at - 1].T @ later * self.transition
            backward[at - 1] = later @ self.transition.T
        share = forward * backward
        share /= share.sum(axis=1, keepdims=True)
        seen = np.stack([np.bincount(looks, share[:, s], len(LOOKS)) for s in range(4)], axis=1)
        return share[firsts].sum(axis=0), pairs, seen

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_MARK = re.compile(r"(?:[-–—*•·◦‣▪●○■□→»›?✓✔+]|\[[ xX✓]?\]|\(?\d{1,3}[.)]|\(\d{1,3}\)|[a-zA-Z][.)])\s+")
_TAG = re.compile(r"#\w+(?:[\s,;]+#\w+)*")
_SPLIT = re.compile(r"\t|\s*\|\s*|\s{2,}|[;,](?=\s{2,}|\S)|[;,]\s*")
_MENU = re.compile(r"\s+[|/»›>·•?–—-]\s+|\s{2,}|\t|\s*[|]\s*|,\s*(?=#)")
_CELL_NUMBER = re.compile(r"[€$£¥+-]?\s*\d[\d.,\s'’]*\s*[%€$£¥]?|[-–—]?|n/a", re.IGNORECASE)
_ENDS = tuple(".!?…。！？:;,，；")
_CLOSERS = "'\"”’»)]"
_LONG_TOKEN = re.compile(r"(?=\S*[A-Z0-9+/])[A-Za-z0-9+/=_-]{24,}")
_HEX = re.compile(r"[0-9a-fA-F]{2}|(?=\w*\d)[0-9a-f]{4,}|(?=\w*\d)[0-9A-F]{4,}")
_INNER = re.compile(r"(?<=\S)[.,;\[\]](?=\S)")
_CODE = re.compile(r"[{}<>=;()\[\]|&!\\]")
_DIGIT = re.compile(r"\d")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_ACCENTED = re.compile("[\u00c0-\u00ff]")
_GARBLE = re.compile("[\x80-\x9f\xa1-\xa6\xa8-\xaa\xac-\xaf\xb1-\xb6\xb8-\xba\xbc-\xbe\xc2\xc3\xd0\xd1\xe2-\xe7\xec-\xef\ufffd\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u201a\u201e\u2020\u2021\u2030\u2122\u2500-\u257f]")
_LATIN = re.compile(r"[A-Za-z]")
_CASE_JUMP = re.compile(r"[а-яё][А-ЯЁ]|[РС][^а-яА-ЯёЁ\s\w]|[РС][А-ЯЁ]?[^\W\d_]?(?=[РС])")


def readable(text: str, words: list[str]) -> bool:
    """Whether wrong decoding left words that can be read: most letters belong to a script as it is spelled."""
    if text.isascii():
        return True
    letters = sum(map(len, words))
    odd = len(_GARBLE.findall(text))
    plain = len(_LATIN.findall(text))
    if odd > 3 and odd > plain:
        return False
    cyrillic = len(_CYRILLIC.findall(text))
    if cyrillic > 5 and len(_CASE_JUMP.findall(text)) * 6 > cyrillic:
        return False
    if cyrillic >= 12 and sum(map(text.lower().count, "оеаинт")) < 0.36 * cyrillic:  # letters that are half of any Russian text
        return False
    accented = len(_ACCENTED.findall(text))
    return not (accented > 5 and accented * 2 > letters)


def look_of(line: str) -> tuple[str, int, int, int, int, int]:
    """What a line looks like, with its numbers of words, common words and their letters, and of visible characters and digits."""
    text = line.strip()
    words = _WORD.findall(text)
    n_words = len(words)
    han = 0 if text.isascii() else len(_HAN.findall(text))
    lower = " ".join(words).lower().split()
    common = len([w for w in lower if w in COMMON])
    size = len(text)
    tokens = text.split()
    visible = sum(map(len, tokens))
    letters = sum(map(len, words))
    digits = len(_DIGIT.findall(text))
    if letters < 2.5 * n_words and not han:  # single letters of a code are no words
        common = 0

    def out(name: str) -> tuple[str, int, int, int, int, int]:
        return name, n_words, common, letters, visible, digits

    if not visible:
        return out("other")
    if (n_words >= 4 or visible > 12) and not readable(text, words):
        return out("garbled")
    if han and han * 3 >= letters:
        core = _MARK.sub("", text, count=1)
        marked = core != text
        parts = [p for p in _SPLIT.split(core) if p.strip()]
        menu = [p for p in _MENU.split(core) if p.strip()]
        parts = max(parts, menu, key=len)
        if len(parts) >= 3 and max(len(p) for p in parts if _HAN.search(p)) <= 10 and not re.search("[，。！？]", core):
            numbers = sum(bool(_CELL_NUMBER.fullmatch(p.strip())) for p in parts)
            return out("row" if numbers * 3 >= len(parts) else "inline list")
        usual = sum(c in COMMON_HAN for c in core)
        if han >= 9 and (usual * 8 >= han or re.search("[，。！？]", core)):
            top = max(core.count(c) for c in set(core) if _HAN.match(c))
            return out("repeat" if han >= 12 and top * 2.2 > han else "sentence")
        if re.search("[，。！？]$", core):
            return out("fragment")
        if han <= 8:
            return out("marked item" if marked else "short item")
        return out("garbled" if usual == 0 and han >= 9 else "other")
    if n_words >= 4 and len(set(lower)) <= 0.4 * n_words + 1:  # else no word can make up so much
        top = max(Counter(lower).values())
        if top >= 4 and top > 0.6 * n_words and letters * 2 > visible:
            return out("repeat")
    marked = _MARK.match(text)
    core = text[marked.end() :] if marked else text
    longest = max(map(len, tokens), default=0)
    if longest >= 24 and (m := _LONG_TOKEN.search(text)) and len(m.group()) * 2 > visible:
        return out("token")
    if len(tokens) >= 6 and common * 5 < len(tokens) and sum(bool(_HEX.fullmatch(t)) for t in tokens) > 0.8 * len(tokens) and digits < visible:
        return out("token")
    inner = 0 if digits or not _INNER.search(text) else sum(len(t) for t in tokens if len(t) >= 8 and len(_INNER.findall(t)) >= 2)
    if inner * 2 > visible and not digits and len(set(_INNER.findall(text))) >= 2:
        return out("noise")
    if _TAG.fullmatch(core):
        return out("marked item" if len(core.split()) <= 2 else "inline list")
    ended = core.rstrip(_CLOSERS).endswith(_ENDS)
    sentence = common >= 2 and common * 7 >= n_words and n_words >= 5 and letters * 2 > visible
    if sentence and ended:
        return out("sentence")
    parts = [p for p in _MENU.split(core) if p.strip()]
    menu = len(parts) >= 3 and common <= len(parts) // 2 + 1 and max(len(_WORD.findall(p)) for p in parts) <= 4
    if sentence and not menu:
        return out("sentence")
    if digits == visible or _CELL_NUMBER.fullmatch(text) and digits:
        return out("number")
    cells = [c.strip() for c in _SPLIT.split(core.rstrip("\r"))] if not common or menu or common * 7 < n_words or digits * 4 > visible else [core]
    if len(cells) >= 2:
        numbers = sum(bool(_CELL_NUMBER.fullmatch(c)) for c in cells)
        with_digits = sum(any(x.isdigit() for x in c) and bool(_CELL_NUMBER.fullmatch(c)) for c in cells)
        if set(text) <= set("-|=+: \t") and "-" in text and "|" in text:
            return out("row")
        if with_digits and numbers * 4 >= len(cells) and max(map(len, cells)) <= 40:
            return out("row")
    signs = len(_CODE.findall(text))
    if signs >= 4 and signs * 5 > visible or re.search(r"function\s*\(|\bvar \w|=>|</?\w+>.*</|[\w-]+:[^;{}]+;[^;{}]*}|\w\(\w*[,)\[].*;$", text):
        return out("code")
    if letters + digits == 0 or (letters + digits) * 3 < visible:
        return out("rule" if len(set(text)) <= 4 and visible <= 100 else "noise")
    if marked and n_words <= 6 and common <= 1:
        return out("marked item")
    if menu:
        return out("inline list")
    if len(cells) >= 3 and max(len(c) for c in cells) <= 40 and max(len(_WORD.findall(c)) for c in cells) <= 3 and not re.search(r"[.!?…]$", core):
        return out("cells")
    if visible >= 12 and (visible - letters - digits) * 10 > visible * 3:
        return out("noise")
    if n_words == 1 and letters >= 26:
        return out("token")
    if n_words and (common * 4 >= n_words or ended) and not (n_words <= 2 and not ended and text[:1].isupper()):
        return out("sentence" if n_words >= 6 and common else "fragment")
    if n_words <= 4 and size <= 48:
        return out("short item")
    return out("other" if n_words < 6 else "fragment")


def viterbi(model: LineModel, looks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest state of each line; looks holds the lines of documents one behind the other, of lengths each."""
    start, transition, emission = model.logs()
    states = np.zeros(len(looks), np.int8)
    if not len(looks):
        return states
    firsts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths = firsts[order], lengths[order]
    deepest = int(lengths[0])
    score = start + emission[looks[firsts[lengths > 0]]]
    back = np.zeros((len(looks), 4), np.int8)
    final = np.zeros((len(lengths), 4))
    final[: len(score)] = score
    for t in range(1, deepest):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # documents of more than t lines
        at = firsts[:n] + t
        steps = final[:n, :, None] + transition[None]
        back[at] = steps.argmax(axis=1)
        final[:n] = steps.max(axis=1) + emission[looks[at]]
    now = final.argmax(axis=1).astype(np.int8)
    for t in range(deepest - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        at = firsts[:n] + t
        states[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return states


_LINES = re.compile("[\n\r\x0b\x0c\x85  ]+")
_STATISTICS = {
    "lines": "long", "words": "long", "mean_word_length": "double", "symbol_share": "double", "digit_share": "double",
    "ended_line_share": "double", "common_word_share": "double", **{f"{s}_share": "double" for s in STATES},
}


_READ = {c: t for c, t in _STATISTICS.items() if c.removesuffix("_share") not in STATES}


def _read(texts: list[str | None]) -> dict[str, list]:
    """Statistics of texts that need no model, and of their lines the looks, a byte each, and the visible characters, four bytes each."""
    out: dict[str, list] = {c: [] for c in (*_READ, "_looks", "_visible")}
    for text in texts:
        looks: list[int] = []
        visible: list[int] = []
        words = common = letters = ended = signs = digits = seen = 0
        for line in _LINES.split(text or ""):
            if not line or line.isspace():
                continue
            look, w, c, x, v, d = look_of(line)
            looks.append(_LOOK[look])
            visible.append(v)
            words, common, letters, seen, digits = words + w, common + c, letters + x, seen + v, digits + d
            signs += max(v - x - d, 0)
            ended += line.rstrip().endswith((".", "!", "?", "…", "。", "！", "？", '"', "”"))
        lines = len(looks)
        out["lines"].append(lines)
        out["words"].append(words)
        out["mean_word_length"].append(letters / words if words else None)
        out["symbol_share"].append(signs / seen if seen else None)
        out["digit_share"].append(digits / seen if seen else None)
        out["ended_line_share"].append(ended / lines if lines else None)
        out["common_word_share"].append(common / words if words else None)
        out["_looks"].append(bytes(looks))
        out["_visible"].append(np.array(visible, np.uint32).tobytes())
    return out


def _shares(looks: list[bytes], visible: list[bytes], model: LineModel) -> dict[str, list]:
    """Shares of the visible characters of each document in lines of each state."""
    lengths = np.array([len(x) for x in looks], np.int64)
    states = viterbi(model, np.frombuffer(b"".join(looks), np.uint8).astype(np.int64), lengths)
    sizes, edges = np.frombuffer(b"".join(visible), np.uint32).astype(np.float64), np.concatenate([[0], np.cumsum(lengths)])
    whole = np.concatenate([[0.0], np.cumsum(sizes)])
    whole = whole[edges[1:]] - whole[edges[:-1]]
    out = {}
    for s, name in enumerate(STATES):
        sums = np.concatenate([[0.0], np.cumsum(sizes * (states == s))])
        out[f"{name}_share"] = [float(a / b) if b else None for a, b in zip(sums[edges[1:]] - sums[edges[:-1]], whole)]
    return out


def _parts(looks: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Looks and lengths of documents with lines, PART_LINES lines at a time or one document."""
    part: list[bytes] = []
    size = 0
    for own in [*looks, None]:
        if part and (own is None or size + len(own) > PART_LINES):
            yield np.frombuffer(b"".join(part), np.uint8).astype(np.int64), np.array([len(x) for x in part], np.int64)
            part, size = [], 0
        if own:
            part.append(own)
            size += len(own)


def _fitted(read: DataFrame) -> LineModel:
    """The model of all lines of read (_looks), which is read once a round: sums are taken per task and added on the driver."""

    def expected(now: LineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(20 + 4 * len(LOOKS))
            for frame in frames:
                for looks, lengths in _parts(frame["_looks"]):
                    sums += np.concatenate([x.ravel() for x in now._expected(looks, lengths)])
            yield pd.DataFrame({"sums": [sums.tolist()]})

        found = LineModel.of(sum(np.array(r["sums"]) for r in rows.mapInPandas(run, "sums array<double>").collect()))
        return found.start, found.transition, found.emission

    rows = read.select("_looks").where(F.length("_looks") > 0)
    docs, lines = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("_looks")), F.lit(0))).first()
    return LineModel.iterated(expected, lines, docs)


def _read_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_key": frame["_key"], **_read([t if isinstance(t, str) else None for t in frame["_text"]])})

    schema = ", ".join([f"_key {df.schema[key].dataType.simpleString()}", *(f"{c} {t}" for c, t in _READ.items()), "_looks binary, _visible binary"])
    return df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInPandas(run, schema)


def line_model(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int | None = None) -> DataFrame:
    """(model): one row with the values of a LineModel fitted on all lines of all documents.

    The looks of lines are written to the scratch area, a byte a line, and read in
    each of ROUNDS passes, which run here. With sample, only about so many
    documents are used, those whose key's hash, modulo the number of documents, is
    below it.
    """
    if sample is not None:
        count = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
        df = df.where(F.pmod(F.xxhash64(key), count.scalar()) < sample)
    model = _fitted(materialize(_read_rows(df, key, text).select("_looks"), "looks"))
    return df.sparkSession.createDataFrame([(model.values(),)], "model array<double>")


def text_quality(df: DataFrame, key: str = "doc_id", text: str = "text", model: DataFrame | None = None) -> DataFrame:
    """Statistics of each document, and kind: 'prose', 'list', 'table', 'junk' or null.

    One row per row of df: key, lines, words, mean_word_length, symbol_share and
    digit_share (of visible characters), ended_line_share (lines that end in
    punctuation), common_word_share (words that are common function words), and
    the shares of visible characters in lines of each state. kind is the state of
    more than half of the text; it is null if none reaches that, and for null,
    empty and blank texts, whose shares are null as well. Texts are read whole;
    other columns are ignored.

    Method: each line gets one of a few looks from its statistics; a hidden Markov
    model with the states prose, list, table and junk labels the lines of a
    document by the likeliest path, so a line that could be anything goes with its
    neighbours. All documents of a batch are decoded in step. model is the result of
    line_model; its probabilities come from the corpus, held to the states by a
    prior. Without it, one is fitted on all lines of df: what has been read of each
    line goes to the scratch area, so texts are read once, and the passes of the
    fitting run here.
    """
    read = _read_rows(df, key, text)
    kind = df.schema[key].dataType.simpleString()
    own = None
    if model is None:
        read = materialize(read, "lines-read")
        own = _fitted(read)
    else:
        read = read.withColumn("_model", model.scalar())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            given = own or LineModel.prior()
            if own is None and len(frame) and frame["_model"].iloc[0] is not None:
                given = LineModel.of(frame["_model"].iloc[0])
            yield pd.DataFrame({key: frame["_key"], **{c: frame[c] for c in _READ}, **_shares(list(frame["_looks"]), list(frame["_visible"]), given)})

    schema = ", ".join([f"`{key}` {kind}", *(f"{c} {t}" for c, t in _STATISTICS.items())])
    out = read.mapInPandas(run, schema)
    label = F.lit(None).cast("string")
    for s in STATES:
        label = F.when(F.col(f"{s}_share") > 0.5, F.lit(s)).otherwise(label)
    return out.withColumn("kind", label)
