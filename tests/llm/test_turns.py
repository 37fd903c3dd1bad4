import itertools
import os
import random

import pytest

from tests.comparing import DATA, connection
from voxloom.llm.captions import Line, clean_text
from voxloom.llm.names import Persons, default_id, fits, name_parts, one_slip
from voxloom.llm.turns import spoken_segments, turns

SEG = "session_id string, seg_id long, start_ms long, end_ms long, text string, speaker_id long"
LABEL = "session_id string, labels_version long, speaker_id long, display_name string"
INTERVAL = "interval_id long, session_id string, start_ms long, end_ms long, speaker_id long"


@pytest.mark.parametrize(
    "text, spoken, names",
    [
        ("Hello there", True, []), ("", False, []), (None, False, []), ("um... [laughter] ♪♪ — uhh,", False, []), ("呃... 【听不清】", False, []), ("00:00:45,563 - ♪ x ♪", False, []),
        ("[00:06:11] Je pense", True, []), ("Mirka X.: (bruit)", False, ["Mirka X."]), (">> Eskra Mandrup: Je", True, ["Eskra Mandrup"]), ("<v Rasmi K.> There", True, ["Rasmi K."]),
        ("**Jorrik:** creo", True, ["Jorrik"]), ("0h10m47s Arvik Culverd：wir", True, ["Arvik Culverd"]), ("[Corvo Undrey [chair]] ", False, ["Corvo Undrey [chair]"]),
        ("[applause] Ann — yes", True, ["applause", "Ann"]), ("00:01:00,1 - — SPEAKER 1: it", True, ["SPEAKER 1"]), ("她说：嗯", False, ["她说"]), ("Umbrella", True, []), ("10:30", False, []),
    ],
)
def test_lines(text, spoken, names):
    line = Line(text)
    assert line.spoken is spoken and line.names == names


def test_clean_text():
    t = "[00:01] >> Ann Lee: so um, we [laughter] went ♪ x ♪ home ."
    assert clean_text(t, Line(t).body) == "so we went home."
    assert clean_text(None) == "" and clean_text("呃，好") == "好"
    assert len(clean_text("word " * 200_000)) == 999_999


def test_names():
    assert default_id("Speaker 1") == 0 and default_id("SPEAKER_02") == 1 and default_id("说话人 3") == 2 and default_id("Ann 3") is None and default_id(None) is None
    assert name_parts("Dr. Ｘｉｌｏ  Tolmasch (host)") == name_parts("Tolmasch, Xilo") == name_parts("@xilo.tolmasch") == ("tolmasch", "xilo")
    assert name_parts("Speaker 3") == name_parts(None) == name_parts("unknown") == ()
    assert one_slip("undrey", "undery") and one_slip("hobbric", "hobbbric") and not one_slip("mirka", "vesna") and not one_slip("abc", "abd")
    assert fits(("d", "elquist"), ("delmi", "elquist")) and not fits(("elquist",), ("e", "x"))
    p = Persons({0: "Ann Lee", 1: "A. Lee", 2: "Speaker 3", 3: None, 4: "LEE, ANN", 5: "Bob Ray", 6: "Bob Roy", 7: "Bob", 8: "Kestrow", 9: "Isstrop Kelda", 10: "Kelda Isrtop", 11: "kelda.istrop"})
    assert p.persons == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9, 11: 9}
    assert p.who("Ann L.") == 0 and p.who("Speaker 2") == 0 and p.who("Bob") is None or p.who("Bob") == 7
    assert p.who("Zed") is None and p.who("Speaker 99") == 98


def test_names_of_many_parts():
    long = "Anna Berta Clara Dora Emma Frida Greta Hanna Irma Lindqvist"
    p = Persons({0: long, 1: "A. B. C. D. E. F. G. H. I. Lindqvist", 2: long.replace("Lindqvist", "Lindqvits"), 3: "Otto Lindqvist"})
    assert p.persons == {0: 0, 1: 0, 2: 0, 3: 3} and p.who("Anna B. Lindqvist") == 0
    assert not fits(name_parts(long), name_parts(long.replace("Dora", "Vera")))
    assert fits(tuple("a" * 25 + "b"), tuple("a" * 25 + "b")) and not fits(tuple("a" * 25 + "c"), tuple("a" * 25 + "b"))


def test_fits_finds_a_placing_if_there_is_one():
    rng, parts = random.Random(1), ["a", "b", "anna", "anne", "annie", "bert", "berta", "brta"]
    one = lambda x, y: x[0] == y[0] if 1 in (len(x), len(y)) else one_slip(x, y)
    for _ in range(2_000):
        a, b = (tuple(sorted(rng.choices(parts, k=rng.randint(2, 5)))) for _ in range(2))
        less, more = sorted((a, b), key=len)
        assert fits(a, b) == any(all(map(one, less, p)) for p in itertools.permutations(more, len(less)))


def brute(segments, labels, intervals):
    persons = {}
    for s in {x[0] for x in segments}:
        own = [x for x in labels if x[0] == s and x[2] is not None]
        top = max((x[1] for x in own), default=None)
        spelled = {}
        for x in sorted((x for x in own if x[1] == top), key=lambda x: (x[2], x[3] or "")):
            spelled[x[2]] = x[3]
        persons[s] = Persons(spelled)
    by_session = {}
    for s, seg, start, end, text, speaker in set(segments):
        line = Line(text)
        if not line.spoken:
            continue
        person = speaker if speaker is None else persons[s].persons.get(speaker, speaker)
        if speaker is None:
            person = next((w for n in line.names if (w := persons[s].who(n)) is not None), None)
        if person is None:
            sums = {}
            for _, t, a, b, who in set(intervals):
                if t == s and None not in (a, b, who, end) and b > a and end > start and min(b, end) > max(a, start):
                    sums[who] = sums.get(who, 0) + min(b, end) - max(a, start)
            if not sums:
                continue
            who = min(sums, key=lambda w: (-sums[w], w))
            person = persons[s].persons.get(who, who)
        by_session.setdefault(s, []).append((start, seg, person))
    out = []
    for s, rows in by_session.items():
        rows.sort()
        run = []
        for r in rows:
            if run and (run[-1][2] != r[2] or r[0] - run[-1][0] >= 3_600_000):
                out.append((s, run[0][2], run[0][1], run[-1][1]))
                run = []
            run.append(r)
        out.append((s, run[0][2], run[0][1], run[-1][1]))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_against_brute_force(spark):
    c = connection()
    get = lambda sql: c.execute(sql).fetchall()
    segments = get("select session_id, seg_id, start_ms, end_ms, text, speaker_id from segments")
    labels = get("select session_id, labels_version, speaker_id, display_name from speaker_labels")
    intervals = get("select interval_id, session_id, start_ms, end_ms, speaker_id from speaker_intervals")
    spoken = spoken_segments(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("segments", "speaker_labels", "speaker_intervals")))
    found = turns(spoken).select("session_id", "speaker_id", "first_seg", "last_seg").collect()
    assert sorted(map(tuple, found)) == brute(segments, labels, intervals)


def test_across_slices_and_ties(spark):
    rows = [("s", i, i * 100, 1) for i in range(40)] + [("s", 50, 4100, 2), ("s", 51, 4100, 1), ("s", 52, 4100, 1), ("s", 60, 9000, 1), ("t", 70, 0, 3)]
    df = spark.createDataFrame(rows + rows[:9], "session_id string, seg_id long, start_ms long, person long")
    found = sorted((r.first_seg, r.last_seg, r.speaker_id) for r in turns(df, max_step=700).collect())
    assert found == [(0, 39, 1), (50, 50, 2), (51, 52, 1), (60, 60, 1), (70, 70, 3)]


def test_empty_tables_and_clashing_columns(spark):
    segments = spark.createDataFrame([("s", 1, 0, 10, "yes", 4), ("s", 2, 20, None, "Ann: no", None), ("s", 3, 30, 40, "what", None), (None, 4, 1, 2, "x", 1)], SEG).selectExpr("*", "1 as person", "2 as names", "3 as _b")
    empty = spark.createDataFrame([], LABEL), spark.createDataFrame([], INTERVAL)
    assert [tuple(r) for r in turns(spoken_segments(segments, *empty)).select("speaker_id", "first_seg", "last_seg").collect()] == [(4, 1, 1)]
    assert turns(spoken_segments(segments.limit(0), *empty)).count() == 0
    labels = spark.createDataFrame([("s", 1, 4, "Old"), ("s", 2, 4, "Ann Lee"), ("s", 2, None, "x")], LABEL)
    out = turns(spoken_segments(segments, labels, empty[1], with_text=True)).collect()
    assert [(r.speaker_id, r.first_seg, r.last_seg, r.text) for r in out] == [(4, 1, 2, "yes no")]
