import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxloom.operators.sync import ADDITIVE, STATUSES, Selection, file_group, inventory, known_files, missing_artifacts, needs_attention, project_matches, status, unique_names

FILE = "rel_path string, local_size long, synced_size long, last_synced_at long, remote_exists boolean"


@pytest.mark.parametrize(
    "selector, folder, found",
    [
        ("2025-05-17_choir", "2025-05-17_choir", True), ("2025-05-17_ch", "2025-05-17_choir", True), ("2025-05-17", "2025-05-17_choir", True), ("2025-05-17", "2025-05-17", True), ("2025-05-1", "2025-05-17_choir", False),
        ("2025-05-17", "2025-05-17b", False), ("choir", "2025-05-17_choir", False), (" ", "x", False), ("2025-05-17 ", "2025-05-17_a", True), ("2025-o5-17", "2025-o5-17_a", False), ("x", None, False),
    ],
)
def test_projects(spark, selector, folder, found):
    assert spark.createDataFrame([(folder,)], "d string").select(project_matches("d", selector)).first()[0] is found


def test_selection_of_single_paths():
    s = Selection().without("a/b/").without("a/b/c").without("z").without("")
    assert s.excluded == ("a/b", "z") and s.with_again("a").excluded == ("z",) and s.with_again("z/").excluded == ("a/b",)
    assert Selection(excluded=("a/b/c", "a/bc")).with_again("a/b").excluded == ("a/bc",)
    assert Selection(deletion="mirror").deletes_anything and not Selection(deletion="mirror", direction="download").deletes_anything
    assert not Selection(audio=False).downloads_audio and Selection().downloads_audio


def test_every_status(spark):
    rows = [
        ("gone", None, 1, 5, True, "pending_delete"), ("gone.mp3", None, 1, 5, None, "deleted_local_kept_remote"), ("both gone", None, 1, 5, False, "synced"), ("never here", None, None, None, True, "never_synced"),
        ("fresh", 1, None, None, None, "never_synced"), ("changed", 2, 1, 5, True, "pending_upload"), ("changed offline", 2, 1, 5, None, "pending_upload"), ("lost there", 1, 1, 5, False, "pending_upload"),
        ("fine", 1, 1, 5, True, "synced"), ("fine offline", 1, None, 5, None, "synced"), ("out/a", 1, 1, 5, True, "excluded"), ("out", None, 1, 5, True, "deleted_local_kept_remote"),
    ]
    files = spark.createDataFrame([r[:5] for r in rows], FILE)
    found = status(files, Selection(excluded=("out/",), deletion="text"))
    assert {r.rel_path: r.status for r in found.collect()} == {r[0]: r[5] for r in rows}
    assert {r.rel_path for r in found.where(needs_attention("status")).collect()} == {r[0] for r in rows if r[5].startswith("pending") or r[5] == "excluded"}
    assert set(r[5] for r in rows) == set(STATUSES) - {"conflict", "pending_download"}
    assert status(files.limit(0), ADDITIVE).count() == 0


def test_inventory(spark):
    names = ["projects/p/summary-brief.md", "projects/p/mindmap.mmd", "projects/p/mindmap-outline.md", "projects/p/transcript.srt", "projects/p/audio/x.OPUS", "projects/p/my summary.md", "other.json", "projects/q/summary-detailed.md"]
    files = spark.createDataFrame([(n, 10 if i else None, "synced" if i else "pending_delete", i != 7) for i, n in enumerate(names)], "rel_path string, local_size long, status string, in_scope boolean")
    rows = {(r.project, r.file_group): (r.files, r.bytes, r.in_scope, r.status, r.attention) for r in inventory(files).collect()}
    assert rows[None, None] == (8, 70, True, "pending_delete", 1) and rows["p", None] == (6, 50, True, "pending_delete", 1) and rows["q", "detailed"] == (1, 10, False, "synced", 0)
    assert rows["p", "mindmap"] == (2, 20, True, "synced", 0) and rows["p", "meta"][0] == 1 and rows["", "meta"][0] == 1 and rows["p", "audio"][0] == 1
    assert spark.createDataFrame([("a/summary-brief.md.bak",)], "p string").select(file_group("p")).first()[0] == "meta"
    local = spark.createDataFrame([("a", 1)], "rel_path string, size_bytes long")
    state = spark.createDataFrame([("a", 2, 9), ("b", 3, 9), ("c", 4, 9)], "rel_path string, size_bytes long, last_synced_at long")
    manifest = spark.createDataFrame([("b", None), ("c", 5)], "rel_path string, deleted_at long")
    assert sorted((r.rel_path, r.local_size, r.synced_size) for r in known_files(local, state, manifest).collect()) == [("a", 1, 2), ("b", None, 3)]


def test_missing_parts(spark):
    names = ["projects/p/audio/x.m4a", "projects/p/transcript.md", "projects/q/audio/audio.sha256", "projects/q/mindmap.mmd", "projects/q/sub/transcript.md", "elsewhere/transcript.md", None]
    rows = missing_artifacts(spark.createDataFrame([(n,) for n in names], "rel_path string")).collect()
    assert {r.project: r.missing for r in rows} == {"p": ["detailed", "brief", "mindmap"], "q": ["audio", "transcript", "detailed", "brief"]}


def test_unique_names(spark):
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b_2", 5), ("c", 6)], "stem string, id long")
    taken = spark.createDataFrame([("a",), ("a_3",), ("a_x",), ("b_2",), ("a",), (None,)], "name string")
    assert {r.id: r.name for r in unique_names(wanted, taken).collect()} == {1: "a_2", 2: "a_4", 3: "a_5", 4: "b", 5: "b_2_2", 6: "c"}
    full = spark.range(1, 4).select(F.concat(F.lit("c"), F.when(F.col("id") == 1, "").otherwise(F.concat(F.lit("_"), "id"))).alias("name"))
    assert {r.id: r.name for r in unique_names(wanted, full, most=3).collect()}[6] is None
