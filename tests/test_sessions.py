from pyspark.sql import functions as F

from voxloom.operators import summaries
from voxloom.operators.recognition import in_chunk_order, resume_points, transcribe
from voxloom.operators.utterances import documents_of
from voxloom.sources import stores
from voxloom.sources.files import first_etag


def test_summaries_ask_once_for_short_texts_and_join_pieces_in_order(spark):
    long = "\n".join(f"Sentence number {i} of this talk." for i in range(900))
    docs = spark.createDataFrame([("a", 0, "short"), ("b", 0, long), ("c", 0, None), ("d", 0, "x"), ("d", 1, "y")], "session_id string, part int, text string")

    def model(prompts):
        return [p.split("\n", 1)[0] + "|" + p[-30:] for p in prompts]

    found = {r.session_id: r for r in summaries.summarise(docs, model, "Sum up").collect()}
    assert len(found) == 4 and found["a"].summary == "Sum up|" + "Sum up\n\nshort"[-30:] and not found["a"].in_pieces and found["a"].pieces == 1
    assert found["b"].in_pieces and found["b"].pieces == 8 and found["b"].summary.endswith("number 899 of this talk.")
    assert found["d"].in_pieces and found["d"].pieces == 2 and found["c"].summary.startswith("Sum up|")
    assert {r.session_id: r.in_pieces for r in summaries.summary_plan(docs).collect()} == {"a": False, "b": True, "c": False, "d": True}
    assert summaries.mock_model(["a", "a", "b"])[0] == summaries.mock_model(["a"])[0] != summaries.mock_model(["b"])[0]
    assert summaries.summarise(docs.limit(0)).count() == 0


def test_stored_documents(spark, tmp_path):
    labels = spark.createDataFrame([("s", 3, 1, "Ann", "#1", None), ("s", 3, 0, None, "#2", "p"), ("t", 0, None, "x", "#", None)], "session_id string, labels_version long, speaker_id long, display_name string, color string, profile_id string")
    docs = stores.labels_json(labels)
    assert sorted(map(tuple, docs.select(F.inline(stores.labels_of("json"))).collect())) == [("s", 3, 0, None, "#2", "p"), ("s", 3, 1, "Ann", "#1", None)]
    odd = spark.createDataFrame([('﻿{"session_id":"u","labels":{"7":{"display_name":"B"},"-1":{},"q":{}}}',), ("{broken",), (None,)], "json string")
    assert [tuple(r) for r in odd.select(F.inline(stores.labels_of("json"))).collect()] == [("u", None, 7, "B", None, None)]
    assert [r[0] for r in odd.select(F.size(stores.state_of("json"))).collect()] == [0, 0, 0]
    people = spark.createDataFrame([("p", "Ann", [1.0]), ("q", None, [2.0]), (None, "x", [])], "profile_id string, display_name string, centroid array<double>")
    assert stores.registry_json(people).select(stores.registry_of("json")).first()[0].get("p") == "Ann" and "centroid" not in stores.registry_json(people).first()[0]
    stores.write_documents(docs, str(tmp_path / "labels"), "session_id", "json")
    assert '"Ann"' in stores.read_document(spark, str(tmp_path / "labels"), "s") and stores.read_document(spark, str(tmp_path / "labels"), "sx") is None
    parts = spark.createDataFrame([("p", "transcript.md", "text"), ("p", "notes.md", "  "), ("q", "a.srt", None), ("q", "b.srt", "1")], "project string, name string, text string")
    stores.write_artifacts(parts, str(tmp_path / "projects"))
    assert sorted((r.project, r.name) for r in spark.read.parquet(str(tmp_path / "projects")).collect()) == [("p", "transcript.md"), ("q", "b.srt")]


def test_documents_without_rows(spark):
    empty = spark.createDataFrame([], "session_id string, first_seg long, start_ms long, block string")
    assert documents_of(empty).count() == 0


def test_resume_points_and_order_of_chunks(spark):
    done = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 3), ("b", 2), ("c", None), (None, 0), ("d", 0)], "session_id string, idx long")
    assert sorted(map(tuple, resume_points(done).collect())) == [("a", 3, 2), ("b", 1, 0), ("d", 1, 1)]
    raw = spark.createDataFrame([("a", 2, 0), ("a", 1, 5), ("b", 1, 7), ("b", None, 1)], "session_id string, chunk_id int, pos long")
    assert [(r.session_id, r.pos) for r in in_chunk_order(raw).orderBy("session_id", "order").collect()] == [("a", 5), ("a", 0), ("b", 1), ("b", 7)]


def test_recognisers_are_exchangeable(spark):
    rows = [("s", 0, 100, 10, 1, [0.5] * 40), ("s", 1, None, 10, 2, [0.1] * 10), ("s", 2, 0, 0, 1, [1.0]), ("s", 3, 0, 10, 1, None), ("s", 4, 0, 10, 1, [])]
    chunks = spark.createDataFrame(rows, "session_id string, idx long, start_ms long, sample_rate int, channels int, samples array<float>")

    def loud(samples, rate, channels):
        return [(10, 5, f" {len(samples)} "), (20, 30, " ")]

    assert sorted(map(tuple, transcribe(chunks, loud).collect())) == [("s", 0, 0, 110, 110, "40"), ("s", 1, 0, 10, 10, "10")]
    assert sorted((r.idx, r.start_ms, r.end_ms) for r in transcribe(chunks).collect()) == [(0, 100, 4100), (1, 0, 500)]


def test_first_etag(spark):
    texts = ["<d:getetag></d:getetag><getetag> W/&quot;1&quot; </getetag>", "<x/>", None, "<o:getetag a='1'>q</o:getetag>"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(first_etag("t")).collect()] == ['W/"1"', None, None, "q"]
