import random
import re

import numpy as np

from voxloom.llm.pieces import audio_pieces, merge_weakest, pieces, text_pieces


def brute_merge(sizes, strengths, limit):
    groups = [[i] for i in range(len(sizes))]
    total = lambda g: sum(sizes[i] for i in g)
    while True:
        pairs = [(strengths[a[-1]], total(a) + total(b), a[0], n) for n, (a, b) in enumerate(zip(groups, groups[1:])) if total(a) + total(b) <= limit]
        if not pairs:
            return [g[0] for g in groups]
        n = min(pairs)[3]
        groups[n : n + 2] = [groups[n] + groups[n + 1]]


def test_merging():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 25)
        sizes, strengths = [rng.randint(1, 30) for _ in range(n)], [rng.randint(0, 3) for _ in range(n)]
        assert merge_weakest(sizes, strengths, 40) == brute_merge(sizes, strengths, 40)


def cover(places, size, limit, overlap):
    assert places[0][0] == 0 and places[-1][1] == size
    assert all(b - a <= limit for a, b in places)
    assert all(c == max(b - overlap, 0) for (_, b), (c, _) in zip(places, places[1:]))


def test_texts():
    assert text_pieces("") == ([], 0) and text_pieces("x" * 4000) == ([(0, 4000)], 0)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", ". ", "\n", "字", "。", "\r\n", "x" * rng.choice([3, 50]), "　", " "]) for _ in range(rng.randint(10, 900)))
        places, _ = text_pieces(text, 100, 10)
        cover(places, len(text), max(100, len(text) if len(places) == 1 else 100), 10)
    sentence = "One two three four five. " * 400
    places, forced = text_pieces(sentence, 1000, 100)
    assert not forced and all(sentence[:b].endswith(". ") for _, b in places[:-1])
    lines = ("a" * 50 + " b. c d\n") * 300
    assert all(lines[:b].endswith("\n") for _, b in text_pieces(lines)[0])
    for text, forced in (("x" * 4001, 1), ("x" * 4000 + ".", 0), ("x" * 4000 + "\x85" + "x" * 4000, 0), ("x" * 3900 + ",x" * 60, 1), ("x " * 3000 + "字" * 4001, 1)):
        assert text_pieces(text)[1] == forced
    big = "long text with words " * 100_000
    cover(text_pieces(big)[0], len(big), 4000, 200)


def test_no_avoidable_cut_at_the_start():
    text = "x" * 3900 + ". " + "hello world. " * 50
    places, forced = text_pieces(text)
    cover(places, len(text), 4000, 200)
    assert forced == 0 and places[0][1] >= 3902 and all(text[b - 1] == " " for _, b in places[:-1])
    places, forced = text_pieces("x" * 4000 + " y" * 900)
    assert forced == 0 and places[0] == (0, 4000)
    sound = np.full(5000, 0.5)
    sound[2960:2990] = 0
    places, forced = audio_pieces(sound, 100, 1)
    cover(places, 5000, 3000, 100)
    assert forced == 0 and places[0] == (0, 2975)


def test_forced_is_told_from_the_cuts():
    rng = random.Random(6)
    for _ in range(80):
        text = "".join(rng.choice(["ab ", "c.", "\n", "x" * rng.choice([30, 95, 100, 101, 240])]) for _ in range(rng.randint(3, 60)))
        places, forced = text_pieces(text, 100, 10)
        assert forced == int(len(text) > 100 and any(len(run) > 100 for run in re.split(r"[\s.]", text)))
        cover(places, len(text), 100, 10) if text else None


def test_audio():
    loud = np.full(3100, 0.5)
    assert audio_pieces(np.zeros(0), 100, 1) == ([], 0) and audio_pieces(loud, 0, 1) == ([], 0) and audio_pieces(loud[:3000], 100, 1) == ([(0, 3000)], 0)
    places, forced = audio_pieces(loud, 100, 1)
    cover(places, 3100, 3000, 100)
    assert forced == 1
    x = loud.copy()
    x[1500:1520] = 0.02
    places, forced = audio_pieces(x, 100, 1)
    assert forced == 0 and places == [(0, 1510), (1410, 3100)]
    x[1500:1520] = 0.0201
    assert audio_pieces(x, 100, 1)[1] == 1
    x[1500:1519] = 0
    assert audio_pieces(x, 100, 1)[1] == 1
    stereo = np.column_stack([np.full(4000, 0.001), np.full(4000, 0.5)]).ravel()
    assert audio_pieces(stereo, 100, 2)[1] == 1
    quiet = np.zeros(9000)
    places, forced = audio_pieces(quiet, 100, 1)
    cover(places, 9000, 3000, 100)
    assert forced == 0


def test_operator(spark):
    texts = spark.createDataFrame([("a", "y" * 5000, 1), ("a", "y" * 5000, 1), ("b", None, 1), ("c", "", 1), ("d", "z" * 4000, 1), (None, "w " * 2500, 1)], "session_id string, raw_text string, piece int")
    schema = "session_id string, idx long, sample_rate int, channels int, samples array<float>"
    chunks = spark.createDataFrame([("a", 0, 10, 1, [0.5] * 301), ("a", 1, 0, 1, [0.5] * 400), ("a", 2, 10, 2, [0.5] * 600), ("a", 3, None, None, None), ("a", 4, 10, None, [None] + [0.5] * 400), ("a", 5, 10, 1, [])], schema)
    out = pieces(texts, chunks)
    assert {(r.item, r.session_id, r.idx, r.forced) for r in out.where("piece = 0").collect()} == {("text", "a", -1, 1), ("text", None, -1, 0), ("audio", "a", 0, 1), ("audio", "a", 4, 1)}
    assert out.groupBy("item", "session_id", "idx", "piece").count().where("count > 1").count() == 0
    assert pieces(texts.limit(0), chunks.limit(0)).count() == 0
