import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from voxloom.functions import diagrams as D
from voxloom.functions import text as T
from voxloom.operators import correction, profiles


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_diagrams():
    good = "mindmap\n  root((Trip))\n    a[Food]\n    Plain words\n      (round)\n    %% note\n    b{Six}"
    assert D.diagram_issues(good) == [] and D.repaired_diagram(good) == good
    assert D.diagram_outline(good) == "- Trip\n  - Food\n  - Plain words\n    - round\n  - Six"
    bad = 'Mind map\n  ((Trip))\n  [[Food"\n  %% ((no))\n    }}x'
    assert D.diagram_issues(bad) == ["head", "unbalanced []", "quotes", "line 2", "line 3", "line 5"]
    assert D.repaired_diagram(bad).split("\n")[1:3] == ["  n1((Trip))", '  n2[[Food"'] and D.repaired_diagram(bad).split("\n")[4] == "    n3}}x"
    assert D.diagram_issues("  \n") == ["empty"] and D.diagram_issues('graph TD\n a["x)"]') == [] and D.diagram_issues("graph\n a)b(") == ["unbalanced ()"]
    assert D.extracted_diagram("```mermaid\nSure:\nflowchart LR\n  A --> B\n```\nbye") == "flowchart LR\n  A --> B" and D.extracted_diagram(" none ") == "none"
    assert D.diagram_outline("no head\n  x") == "" and D.diagram_outline("graph\n A --> B:::big") == "- A   B"
    assert [D.node_text(t) for t in ("((a))", "([a])", "x1(a (b))", "id{{a}}", "[]", "-> a", "a b(c)")] == ["a", "a", "a (b", "{a}", "[]", "a", "a b(c)"]


@pytest.mark.parametrize(
    "text, found",
    [
        ('x {"a":{"b":"}"}} y {', '{"a":{"b":"}"}}'), ('```json\n{"q":"\\"{"}\n```', '{"q":"\\"{"}'), ("{", None), ("none", None), ("", None), ('{"open', None), ("}{}", "{}"),
    ],
)
def test_balanced_objects(text, found):
    assert D.balanced_object(text) == found


def test_verdicts(spark):
    texts = ['{"scene":"LECTURE","confidence":7}', 'ok {"scene":"ball","suggested_focus":["a"]}', '{"scene":"other","confidence":-1,"evidence":"e"}', "{}", None, "text"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(D.scene_verdict("t").alias("v")).collect()
    assert [r.v and (r.v.scene, r.v.confidence, r.v.evidence, r.v.suggested_focus) for r in rows] == [("lecture", 1.0, "", []), ("other", 0.5, "", ["a"]), ("other", 0.0, "e", []), None, None, None]


def test_small_functions(spark):
    s = F.lit
    assert [one(spark, T.title_of(s(x))) for x in ("2025-05-17_choir_3", "2025-05-17_choir_123", "2025-05-17_", "notes_2", "a", "2025-05-17_5_7")] == ["choir", "choir_123", "2025-05-17_", "notes", "a", "5"]
    assert [one(spark, T.dated(s(x))) for x in ("2025-05-17_x", "2025-05-17", "x_y")] == ["2025-05-17", None, None]
    assert [one(spark, T.is_placeholder(s(x))) for x in (" ", "Recording", "audio (2)", "input_3", "audios", "42", "my audio", None)] == [True, True, True, True, False, True, False, True]
    assert [one(spark, T.masked(s(x))) for x in ("", "12345678", "abcd-secret-wxyz")] == ["*", "*" * 8, "abcd****wxyz"] and one(spark, T.shortened(s("abcdef"), 4)) == "abc…"
    assert [one(spark, T.progress_share(s(x))) for x in ("progress = 7%", "progress 240% 150%", "7%", "progress", "progress 9% x")] == [0.07, 1.0, None, None, 0.09]
    assert [one(spark, T.slice_total(s(x))) for x in ("processing 12 slice(s)", "processing", "processing x")] == [12, None, None]
    assert [one(spark, T.format_length(s(x).cast("long"))) for x in (0, 61_000, 3_600_000, None)] == ["0:00", "1:01", "1:00:00", None]
    assert [one(spark, T.spoken_length(s(x).cast("long"))) for x in (5000, 61_000, 3_600_000, 7_320_000, None)] == ["about 5 s", "about 1 min", "about 1 h", "about 2 h 2 min", None]
    assert one(spark, T.format_minute(s(951_782_400_000))) == "2000-02-29 00:00" and one(spark, T.format_minute(s(-5))) == "1970-01-01 00:00"
    assert [one(spark, T.safe_path(s(x))) for x in ("a/b", "", "/a", "a/../b", "C:\\x", "..", "a..b")] == ["a/b", None, None, None, None, None, "a..b"]
    split = lambda x: one(spark, T.split_service_url(s(x), ["/webdav"]))
    assert tuple(split("https://h/u/webdav/a/b/")) == ("https://h/u/webdav", "a/b") and tuple(split("http://h/x/y")) == ("http://h/x", "y")
    assert split("https://h/webdav") is None and split("https://h/x") is None and split("https://h") is None and split("ftp://h/x/y") is None
    assert one(spark, T.format_time(s(None).cast("long"))) is None
    assert one(spark, T.scene_sample(s("x" * 2100))) == "x" * 2100 and one(spark, T.scene_sample(s("a" * 1000 + "b" * 1000 + "c" * 1000))).count("b") == 700
    assert tuple(one(spark, T.guessed_scene(s("作业 考试 进度")))) == ("lecture", 0.8) and tuple(one(spark, T.guessed_scene(s("议题")))) == ("meeting", 0.75) and tuple(one(spark, T.guessed_scene(s("")))) == ("other", 0.3)


def test_keys(spark):
    words = ["north", "südwind"]
    digest = hashlib.sha256(b"".join(w.encode() + b"\n" for w in words)).digest()
    version = one(spark, T.words_version(F.array(*map(F.lit, words))))
    assert version == struct.unpack("<I", digest[:4])[0] and one(spark, T.words_version(F.array().cast("array<string>"))) == 0
    key = T.transcript_key(F.lit("h"), F.lit("m"), F.lit("b"), F.lit(None), F.lit(True), F.lit(None), F.lit(3), F.lit(False), F.lit(version), F.lit(None))
    want = b"|".join([b"h", b"m", b"b", b"auto", b"\x01", b"-", b"fixed3", b"\x00", struct.pack("<I", version), b"\xff" * 4])
    assert one(spark, key) == hashlib.sha256(want).hexdigest()
    assert one(spark, T.diarize_key(F.lit("h"), F.lit("s"), F.lit("e"), F.lit("b"))) == hashlib.sha256(b"h|diarize|s|e|b").hexdigest()


def test_corrections(spark):
    rows = [("s", i, 100 - i, f"word {i}") for i in range(45)] + [("t", 99, 1, "alone"), ("t", 98, None, "no start"), (None, 97, 1, "no session")]
    batched = correction.batches(spark.createDataFrame(rows, "session_id string, seg_id long, start_ms long, text string"), width=7)
    assert sorted((r.session_id, r.batch, r.segments) for r in batched.collect()) == [("s", 0, 20), ("s", 1, 20), ("s", 2, 5), ("t", 0, 1)]
    first = batched.where("session_id = 's' and batch = 0").first()
    assert first.prompt.split("\n")[0] == "1. word 44" and [p.no for p in first.parts] == list(range(1, 21))
    replies = [("s", 0, "\n".join(f"{n}) {'Word ' + str(45 - n) if n == 2 else first.parts[n - 1].text}" for n in range(1, 21))), ("s", 1, "1. only one"), ("t", 0, "1. " + "very long " * 9)]
    applied = correction.apply_replies(batched, spark.createDataFrame(replies, "session_id string, batch long, reply string"))
    assert {(r.seg_id, r.text) for r in applied.where("changed").collect()} == {(43, "Word 43")}
    assert {(r.session_id, r.batch, r.outcome) for r in applied.collect()} == {("s", 0, "applied"), ("s", 1, "mismatch"), ("s", 2, "failed"), ("t", 0, "unchanged")}
    assert applied.count() == 46 and tuple(correction.correction_stats(applied).first()) == (4, 1, 1, 1, 1, 1)


def test_profiles(spark):
    schema = "profile_id string, session_id string, start_ms long, end_ms long, quality double, vector array<float>"
    rows = [("p", "s", 0, 500, 1.0, [1.0, 0.0]), ("p", "s", 10, 10_010, 1.0, [3.0, 0.0]), ("p", "s", 10, 10_010, 0.5, [0.0, 9.0]), ("p", "s", 20, 12_020, 0.0, [1.0, 0.0]), ("p", "t", 0, 4000, 0.25, [0.0, 5.0]), ("p", "u", 0, 9000, 1.0, []), ("q", "s", 0, None, 1.0, [1.0])]
    samples = spark.createDataFrame(rows, schema)
    stored = profiles.enroll(samples)
    assert sorted((r.sample_id, r.duration_ms, round(r.weight, 3)) for r in stored.collect()) == [("p-s-10", 10_000, 3.162), ("p-t-0", 4000, 0.5)]
    more = profiles.enroll(spark.createDataFrame([("p", "t", 0, 9000, 9.0, [7.0, 7.0]), ("r", "t", 0, 9000, 9.0, [7.0, 7.0])], schema), stored)
    assert sorted((r.sample_id, r.quality) for r in more.collect()) == [("p-s-10", 1.0), ("p-t-0", 0.25), ("r-t-0", 9.0)]
    found = profiles.profile_centroids(more).where("profile_id = 'p'").first()
    assert found.sample_count == 2 and found.centroid[0] / found.centroid[1] == pytest.approx(10**0.5 / (0.25 * 2))
    kept, rest = profiles.delete_profiles(more.select("profile_id").distinct(), more, spark.createDataFrame([("p",), ("p",)], "profile_id string"))
    assert [r[0] for r in kept.collect()] == ["r"] and [r.sample_id for r in rest.collect()] == ["r-t-0"]
    assert samples.where(profiles.acceptable()).count() == 3 and json.dumps(sorted(r.samples for r in profiles.profile_stats(samples.select("profile_id").distinct(), more).collect())) == "[0, 2]"
