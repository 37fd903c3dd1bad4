import datetime as dt
import json
import struct

import numpy as np

from pyspark.sql import functions as F

from voxloom.functions.text import correction_accepted, decode_path, encode_path, glob_match, href_path, is_audio_path, numbered_lines, parse_size, slugify
from voxloom.operators.listings import insert_missing, merge_manifests, tree_totals, upsert
from voxloom.operators.sync import MIRROR, Selection, plan
from voxloom.sources.files import dav_listing, even_segments, list_files, read_manifest, read_sharded, recognised_segments, write_sharded
from voxloom.sources.wav import format_wav, parse_wav, plan_cuts, read_wav, resampled, to_mono
from voxloom.streaming.streams import maintain_manifest, newest_manifest, speech_sessions

ENTRY = "rel_path string, etag string, synced_at long, deleted_at long, origin string"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_wav_round_trip(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 1.5, -2.0, 0.25], np.float32)
    found, rate, channels = parse_wav(format_wav(x, 16000, 2))
    assert (rate, channels) == (16000, 2) and np.abs(found - np.clip(x, -1, 1)).max() < 1e-4
    body = np.array([0.1, -0.2], "<f4").tobytes()
    head = struct.pack("<4sI4s4sI5s", b"RIFF", 0, b"WAVE", b"JUNK", 5, b"12345") + b"\0" + struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 3, 1, 8000, 32000, 4, 32, b"data", len(body))
    assert np.allclose(parse_wav(head + body)[0], [0.1, -0.2])
    assert parse_wav(b"no") is None and parse_wav(None) is None
    (tmp_path / "a.wav").write_bytes(format_wav(x, 100, 2))
    (tmp_path / "b.wav").write_bytes(b"damaged")
    rows = {r.path.rpartition("/")[2]: r for r in read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].sample_rate == 100 and len(rows["a.wav"].samples) == 6 and rows["b.wav"].samples is None
    mono = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0, 9.0], 2), ([], 1), (None, 1)], "s array<float>, c int").select(to_mono("s", "c")).collect()
    assert [r[0] for r in mono] == [[2.0, 6.0], [], None]
    tone = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], 4, 8), ([1.0, 5.0, 9.0], 2, 2), ([], 1, 2), ([0.0, 4.0, 8.0, 12.0, 16.0], 10, 4)], "s array<float>, a int, b int")
    assert [r[0] for r in tone.select(resampled("s", "a", "b")).collect()] == [[0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0], [1.0, 5.0, 9.0], [], [0.0, 10.0]]


def test_cuts_fall_into_quiet_places():
    x = np.full(8000 * 40, 0.3)
    x[8000 * 13 : 8000 * 13 + 1200] = 0.001
    cuts = plan_cuts(x, 8000, 12_000)
    assert cuts[0][0] == 0 and cuts[-1][1] == 40_000 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert 13_000 <= cuts[0][1] <= 13_150
    assert plan_cuts(np.zeros(0), 8000, 500) == []


def test_listing_and_manifest(spark, tmp_path):
    for name in ("p/a.txt", "p/b.tmp", "p/.hidden", "audio/c.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("xy")
    assert sorted(r.rel_path for r in list_files(spark, str(tmp_path)).collect()) == ["audio/c.wav", "p/a.txt"]
    assert [r.rel_path for r in list_files(spark, str(tmp_path), audio=False).collect()] == ["p/a.txt"]
    good = tmp_path / "m.json"
    good.write_text("﻿" + json.dumps({"files": {"a": {"etag": "1", "size": 2, "synced_at": 3}}}))
    assert [tuple(r) for r in read_manifest(spark, str(good)).collect()] == [("a", "1", 2, 3, None, None)]
    (tmp_path / "bad.json").write_text("{nope")
    assert read_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    df = spark.createDataFrame([("abc", 1), ("abd", 2), ("xyz", 3)], "id string, v int")
    write_sharded(df, str(tmp_path / "t"), "id")
    assert [tuple(r) for r in read_sharded(spark, str(tmp_path / "t"), "id", "abd").collect()] == [("abd", 2)]


def test_dav_listing(spark):
    node = lambda href, inside: f"<d:response><d:href>{href}</d:href><d:propstat><d:prop>{inside}</d:prop></d:propstat></d:response>"
    folder = "<d:resourcetype><d:collection/></d:resourcetype>"
    nodes = [
        node("/store/top/", folder), node("/store/top/winter%20trip/", folder), node("/elsewhere/x", ""),
        node("http://nas:8080/store/top/q%3F/l&amp;r%23.txt", "<d:resourcetype/><d:getetag>&quot;e7&quot;</d:getetag><d:getcontentlength>\n81 </d:getcontentlength>"),
    ]
    xml = '<?xml version="1.0"?><d:multistatus xmlns:d="DAV:">' + "\n".join(nodes) + "</d:multistatus>"
    rows = dav_listing(spark.createDataFrame([(xml,), (None,), ("",), ("<d:response><d:href>/store/top/cut",)], "xml string"), "xml", "/store/top")
    assert sorted(map(tuple, rows.collect())) == [("q?/l&r#.txt", False, 81, '"e7"'), ("winter trip", True, None, None)]


def test_text_functions(spark):
    s = lambda x: F.lit(x)
    assert one(spark, slugify(s(' a<b>:c\t　d.. '))) == "a b c d"
    assert one(spark, slugify(s("字" * 90), 80)) == "字" * 80 and one(spark, slugify(s("..."))) == "untitled"
    for path in ("a b/ü+%.md", "课堂/x~y-_.", "100%25"):
        assert one(spark, decode_path(encode_path(s(path)))) == path
    assert one(spark, decode_path(s("a+b%zz%20"))) == "a+b%zz "
    assert one(spark, href_path(s("http://h/x/y%20z/"), "/x")) == "y z" and one(spark, href_path(s("/xy"), "x")) is None
    assert [one(spark, is_audio_path(s(p))) for p in ("a.WMA", "audio/x.txt", ".wav", "d.wav/x")] == [True, False, False, False]
    assert [one(spark, glob_match(s(t), p)) for t, p in (("note7/v2/end", "note?/*end"), ("mix.flac", "*.flac"), ("mix.flac.bak", "*.flac"), ("a+b(1)", "a+b(?)"), ("Q", "q"), ("", "*"))] == [True, True, False, True, False, True]
    assert [one(spark, parse_size(s(x))) for x in (" 12 ", "-1", "1.5", "", None)] == [12, None, None, None, None]
    assert one(spark, numbered_lines(s("1. a\n\n 2) b\n12、c\nplain\n3 : d"))) == ["a", "b", "c", "d"]
    assert one(spark, numbered_lines(s("only text\nmore"))) == ["only text"]
    assert [one(spark, correction_accepted(s(a), s(b))) for a, b in (("abc", "abd"), ("abc", "abc"), ("abc", " "), ("abc", "a" * 10), ("abc", "a" * 9))] == [True, False, False, False, True]


def test_segments_of_a_recogniser(spark):
    text = json.dumps({"result": {"language": "en"}, "transcription": [{"offsets": {"from": 5, "to": 3}, "text": " a "}, {"text": "b"}, {"offsets": {"from": 1, "to": 9}, "text": " "}]})
    found = spark.createDataFrame([(text,), ("{}",)], "j string").select(recognised_segments("j", "100")).collect()
    assert [(x.start_ms, x.end_ms, x.text) for x in found[0][0]] == [(105, 105, "a"), (100, 100, "b")] and found[1][0] == []
    rows = spark.createDataFrame([(2500,), (0,), (None,)], "n long").select(F.inline(even_segments("n", 1000))).collect()
    assert [tuple(r) for r in rows] == [(0, 1000), (1000, 2000), (2000, 2500)]


def test_manifests_and_plan(spark):
    local = spark.createDataFrame([("a", "1", 10, None, "me"), ("b", "1", 10, 10, "me"), (None, "1", 1, None, "me")], ENTRY)
    remote = spark.createDataFrame([("a", "2", 10, None, "you"), ("b", "2", 9, None, "you"), ("c", "3", 1, None, None)], ENTRY)
    assert {r.rel_path: (r.etag, r.deleted_at) for r in merge_manifests(local, remote).collect()} == {"a": ("2", None), "b": ("1", 10), "c": ("3", None)}
    manifest = spark.createDataFrame([("dead", "1", 0, 5, "me"), ("same", "1", 0, None, "me"), ("new", "1", 0, None, "me"), ("gone", "1", 0, None, "me"), ("theirs", "1", 0, None, "you"), ("lost", "1", 0, None, "you"), ("blank", None, 0, None, "me"), ("bare", "1", 0, None, "me"), ("gone.wav", "1", 0, None, "me"), ("buried", "1", 0, 4, "me")], ENTRY)
    there = spark.createDataFrame([("dead", "1"), ("same", "1"), ("new", "2"), ("theirs", "1"), ("blank", "1"), ("odd", "1"), ("bare", None), ("gone.wav", "1"), ("buried", "2")], "rel_path string, etag string")
    here = ("dead", "same", "new", "fresh", "blank", "odd", "bare")
    have = spark.createDataFrame([(n, 7) for n in here], "rel_path string, size_bytes long")
    run = lambda selection, remote=there: {r.rel_path: r.action for r in plan(have, manifest, remote, "me", selection).collect()}
    own = {"dead": "upload", "same": "skip", "new": "download", "fresh": "upload", "blank": "skip", "odd": "skip", "bare": "upload"}
    assert run(MIRROR) == {**own, "gone": "delete_remote", "gone.wav": "delete_remote", "theirs": "download"}
    assert run(Selection()) == {**own, "gone.wav": "download", "theirs": "download"}
    assert run(Selection(deletion="text")) == {**own, "gone": "delete_remote", "gone.wav": "download", "theirs": "download"}
    assert run(Selection(direction="download", deletion="mirror")) == {**{k: "skip" if v == "upload" else v for k, v in own.items()}, "gone.wav": "download", "theirs": "download"}
    assert run(Selection(direction="upload", deletion="text")) == {**{k: "skip" if v == "download" else v for k, v in own.items()}, "gone": "delete_remote"}
    assert run(MIRROR, None) == {**{k: "upload" for k in own}, "gone": "delete_remote", "gone.wav": "delete_remote"}
    assert run(Selection(include=("*e*",), exclude=("d*",), excluded=("fresh/", "new"), audio=False)) == {"same": "skip", "bare": "upload", "theirs": "download"}
    assert run(Selection(exclude=("*",))) == {}
    cur, new = spark.createDataFrame([("a", 1, "x")], "k string, v int, w string"), spark.createDataFrame([("a", 2, "y"), ("b", 3, "z")], "k string, v int, w string")
    assert sorted(map(tuple, upsert(cur, new, "k", ["w"]).collect())) == [("a", 2, "x"), ("b", 3, "z")]
    assert sorted(map(tuple, insert_missing(cur, new.union(new), ["k"]).collect())) == [("a", 1, "x"), ("b", 3, "z")]
    files = spark.createDataFrame([("x/y/a", 1), ("x/b", None), (None, 4)], "rel_path string, n long")
    assert sorted(map(tuple, tree_totals(files, "n").collect())) == [("", 2, 1), ("x", 2, 1), ("x/y", 1, 1)]


def test_streams(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [("s", 1, i, t + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 60, 61])] + [("s", 1, 0, t)]
    schema = "session_id string, speaker_id long, seg_id long, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = speech_sessions(stream, "at").writeStream.outputMode("append").format("memory").queryName("spoken").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.segments for r in speech_sessions(spark.read.parquet(str(tmp_path / "in")), "at").collect()) == [2, 3]
    spark.createDataFrame([("a", "1", 10, None, "me")], ENTRY).write.parquet(str(tmp_path / "feed"))
    for more in ([("a", "2", 11, None, "you")], [("b", "1", 5, None, "me"), ("a", "0", 9, None, "me")]):
        maintain_manifest(spark.readStream.schema(ENTRY).parquet(str(tmp_path / "feed")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
        spark.createDataFrame(more, ENTRY).write.mode("append").parquet(str(tmp_path / "feed"))
    maintain_manifest(spark.readStream.schema(ENTRY).parquet(str(tmp_path / "feed")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted((r.rel_path, r.etag) for r in newest_manifest(stream, str(tmp_path / "out")).collect()) == [("a", "2"), ("b", "1")]
