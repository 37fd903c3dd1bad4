import numpy as np
import pytest

from voxloom.functions.packing import pack_lines
from voxloom.operators.overlap import annotate_segments
from voxloom.operators.utterances import documents_of, merge_utterances, render_srt, repair_timeline
from voxloom.operators.vectors import _cosines, agglomerate_labels, centroids, cluster_sessions, cosine, first_appearance, identify, kmeans_labels, moved

SEG = "session_id string, seg_id long, start_ms long, end_ms long, text string, speaker_id long, overlapped boolean"
INTERVAL = "interval_id long, session_id string, start_ms long, end_ms long, speaker_id long"


def merged(spark, rows):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], SEG)
    return [tuple(r) for r in merge_utterances(df, width=5000).select("first_seg", "start_ms", "end_ms", "text", "speaker_id", "overlapped").orderBy("start_ms").collect()]


def test_each_rule_of_merging(spark):
    a = (3000, 6000, "ab", 0, False)
    assert merged(spark, [a, (6000, 11000, "cd", 0, True)]) == [(0, 3000, 11000, "abcd", 0, True)]
    assert len(merged(spark, [a, (6000, 7000, "cd", 1, False)])) == 2
    assert len(merged(spark, [a, (6000, 7000, "cd", None, False)])) == 2
    assert len(merged(spark, [a, (8500, 9000, "cd", 0, False)])) == 2
    assert len(merged(spark, [a, (8499, 9000, "cd", 0, False)])) == 1
    assert len(merged(spark, [(3000, 6000, "ab.", 0, False), (6000, 7000, "cd", 0, False)])) == 2
    assert len(merged(spark, [(3000, 6000, "ab！", 0, False), (6000, 7000, "cd", 0, False)])) == 1
    assert len(merged(spark, [a, (6000, 63001, "cd", 0, False)])) == 2
    assert len(merged(spark, [a, (6000, 63000, "cd", 0, False)])) == 1
    assert len(merged(spark, [a, (6000, 7000, "c" * 199, 0, False)])) == 2
    assert merged(spark, [a, (6000, 7000, " 　", 1, False), (7000, 8000, "x", 0, False)]) == [(0, 3000, 8000, "abx", 0, False)]
    assert merged(spark, [(0, None, None, 0, False)]) == []
    assert len(merged(spark, [(i * 100, i * 100 + 90, "y" * 7, 1, None) for i in range(100)])) == 4


def test_votes(spark):
    segments = spark.createDataFrame([("s", 1, 1000, 5000, "a", 9, True), ("s", 2, 0, 1000, "b", None, None), ("s", 3, 9000, 9500, "c", None, None), ("s", 4, 100, 100, "d", None, None)], SEG)
    first = [(1, "s", 0, 2000, 7), (2, "s", 2000, 5000, 3), (2, "s", 2000, 5000, 3), (3, "s", 1500, 1600, None), (4, "s", 3, 2, 5)]
    out = annotate_segments(segments, spark.createDataFrame(first, INTERVAL))
    assert {r.seg_id: (r.speaker_id, r.overlapped) for r in out.collect()} == {1: (3, False), 2: (7, False), 3: (None, False), 4: (None, False)}
    out = annotate_segments(segments, spark.createDataFrame([(1, "s", 0, 505, 1), (2, "s", 495, 1000, 0)], INTERVAL))
    assert {r.seg_id: (r.speaker_id, r.overlapped) for r in out.collect()}[2] == (0, True)


def test_timeline(spark):
    rows = [("a", i, t, "x") for i, t in enumerate([1700, 9050, 9051, 40_000])] + [("b", 0, 7000, "abcdef"), ("b", 1, 2000, "ab"), ("c", 0, 0, "x"), ("b", 2, 9, " ")]
    rows += [("d", i, t, "yy") for i, t in enumerate([10, 10, 40])] + [("e", 0, -5, "z"), ("e", 1, 8, "z")]
    out = repair_timeline(spark.createDataFrame(rows, "session_id string, pos long, to_ms long, text string"), width=2)
    found = {(r.session_id, r.pos): (r.start_ms, r.end_ms) for r in out.collect()}
    assert found == {
        ("a", 0): (0, 1700), ("a", 1): (1700, 9050), ("a", 2): (9050, 9051), ("a", 3): (9051, 40_000), ("b", 0): (0, 5250), ("b", 1): (5250, 7000),
        ("d", 0): (0, 13), ("d", 1): (13, 26), ("d", 2): (26, 39), ("e", 0): (0, 4), ("e", 1): (4, 8),
    }


def test_documents_are_parts_of_bounded_size(spark):
    rows = [("s", i, i * 1000, f"line {i}") for i in range(500)] + [("t", 900, 5, "x" * 300), ("t", 901, None, "lost")]
    df = spark.createDataFrame(rows, "session_id string, first_seg long, start_ms long, block string")
    for width in (5000, 10**9):
        parts = {}
        for r in documents_of(df, "|", 100, width).collect():
            parts.setdefault(r.session_id, {})[r.part] = r.text
            assert len(r.text) < 110 or r.blocks == 1
        assert "|".join(parts["s"][n] for n in sorted(parts["s"])) == "|".join(f"line {i}" for i in range(500)) and parts["t"] == {0: "x" * 300}


def test_srt(spark):
    df = spark.createDataFrame([("s", 1, 3_725_456, 3_726_000, "hello", None, False), ("s", 2, 3_800_000, 3_801_000, "you", 4, False)], SEG)
    labels = spark.createDataFrame([("s", 1, 4, "Ann")], "session_id string, labels_version long, speaker_id long, display_name string")
    blocks = [r.block for r in render_srt(merge_utterances(df), labels).orderBy("first_seg").collect()]
    assert blocks == ["1\n01:02:05,456 --> 01:02:06,000\nhello", "2\n01:03:20,000 --> 01:03:21,000\nAnn:you"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0]
    schema = "p string, id long, vector array<double>, start_ms long, end_ms long, quality double"
    rows = [("p", 0, [1.0, 0.0], 0, 9000, 10.0)] + [("p", i, [-1.0, 0.0], 0, 9000, 0.01) for i in range(1, 6)] + [("q", 7, [], 0, 1, 1.0), ("r", 8, None, 0, 1, 1.0), ("z", 9, [0.0, 0.0], 0, 1, 1.0)]
    one = {r.p: r.centroid for r in centroids(spark.createDataFrame(rows, schema), ["p"], "id", 1).collect()}
    assert set(one) == {"p"} and one["p"][0] > 0.9
    mixed = [("m", 1, [0.0, 2.0], 0, 9000, 0.1), ("m", 2, [1.0, 0.0, 0.0], 0, 9000, 9.0), ("m", 3, [3.0], 0, 1, 0.9), ("n", 1, [], 0, 1, 1.0), ("n", 2, [1.0], 0, 1, 1.0)]
    assert [(r.p, r.centroid, r.used) for r in centroids(spark.createDataFrame(mixed, schema), ["p"], "id", 3).collect()] == [("m", [0.0, 1.0], 1)]
    found = identify(spark.createDataFrame([("c", [2.0, 0.0]), ("d", [0.0, 0.0]), ("e", [1.0, 1.9])], "c string, centroid array<double>"), spark.createDataFrame([("B", [1.0, 0.0]), ("A", [1.0, 0.0]), ("C", [0.0])], "p string, centroid array<double>"), "c", "p")
    assert {r.c: (r.p, r.confidence) for r in found.collect()} == {"c": ("A", "confirmed"), "d": (None, "new"), "e": (None, "new")}
    with pytest.raises(ValueError):
        identify(found.selectExpr("c", "array(1d) as centroid"), spark.range(5).selectExpr("id as p", "array(1d) as centroid"), "c", "p", most_profiles=3)


def all_pairs(x, threshold, least, most):
    """The same by comparing all pairs of clusters each time."""
    sums, members = [v.copy() for v in x], [[i] for i in range(len(x))]
    while len(members) > least:
        pairs = [(float(_cosines(sums[i][None], sums[j][None])[0, 0]), -i, -j) for i in range(len(sums)) for j in range(i + 1, len(sums))]
        best, i, j = max((round(c, 12), i, j) for c, i, j in pairs)
        if best < threshold and len(members) <= most:
            break
        i, j = -i, -j
        sums[i], members[i] = sums[i] + sums[j], members[i] + members[j]
        del sums[j], members[j]
    labels = np.zeros(len(x), np.int64)
    for n, m in enumerate(members):
        labels[m] = n
    return first_appearance(labels).tolist()


def test_a_centre_without_vectors_goes_to_the_vector_nearest_to_the_centres_by_then():
    centres = np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])
    seen = []
    moved(centres, np.array([[0.0, 3.0], [0.0, 0.0], [2.0, 2.0]]), np.array([2, 0, 1]), lambda: seen.append(centres.copy()) or np.array([5.0, 5.0]))
    assert seen[0].tolist() == [[0.0, 1.0], [0.0, 1.0], [0.0, 1.0]] and centres[1].tolist() == [5.0, 5.0] and np.allclose(centres[2], [0.5**0.5] * 2)


def test_clusters(spark):
    x = np.array([[1.0, 0, 0]] * 4 + [[0, 1.0, 0]] * 4)
    assert kmeans_labels(x, 2).tolist() == [0] * 4 + [1] * 4
    assert agglomerate_labels(x).tolist() == [0] * 4 + [1] * 4
    assert agglomerate_labels(x[:1]).tolist() == [0]
    dealt = np.random.default_rng(3)
    for size in (2, 9, 40):
        y = np.round(dealt.normal(size=(size, 2)), 1)
        for threshold, least, most in ((0.62, 2, 8), (0.9, 1, 5), (-2.0, 1, 3)):
            assert agglomerate_labels(y, threshold, least, most).tolist() == all_pairs(y, threshold, least, most)
    rng = np.random.default_rng(0)
    assert 2 <= agglomerate_labels(rng.normal(size=(30, 3))).max() + 1 <= 8
    assert first_appearance(np.array([7, 3, 7, 1])).tolist() == [0, 1, 0, 2]
    rows = [("s", i, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(6)] + [("s", 9, 9, None), ("t", 10, 0, [1.0]), ("s", 0, 0, [0.0, 1.0])]
    out = cluster_sessions(spark.createDataFrame(rows, "session_id string, emb_id long, start_ms long, vector array<double>"), 2)
    assert {(r.session_id, r.emb_id): r.cluster for r in out.collect()} == {**{("s", i): i % 2 for i in range(6)}, ("t", 10): 0}


def test_clusters_found_by_cells_are_those_of_all_pairs():
    rng = np.random.default_rng(7)
    for size, d in ((1, 2), (2, 2), (40, 1), (300, 2), (700, 3), (700, 8), (300, 40)):
        centres = rng.normal(size=(4, d))
        x = centres[rng.integers(4, size=size)] + rng.normal(size=(size, d)) * 0.2
        x[rng.random(size) < 0.05] = 0.0
        x[size // 2 :: 7] = x[: len(x[size // 2 :: 7])]
        for y in (x, np.round(x, 1), np.ones_like(x)):
            for limits in ((0.62, 2, 8), (0.95, 1, 20), (-2.0, 1, 3)):
                assert agglomerate_labels(y, *limits, dense=0).tolist() == agglomerate_labels(y, *limits, dense=size).tolist()
    assert agglomerate_labels(np.array([[1.0, 0.0], [np.inf, 1.0], [np.nan, 1.0], [1.0, 0.1]] * 200)).max() <= 7


def test_sessions_beyond_100_000_vectors_are_clustered_without_a_number_of_clusters(spark):
    rows = spark.range(100_001).selectExpr("'s' as session_id", "id as emb_id", "id as start_ms", "case when id < 4 then array(1d, cast(id % 2 as double)) else array(1d) end as vector")
    assert {(r.emb_id, r.cluster) for r in cluster_sessions(rows).collect()} == {(0, 0), (1, 1), (2, 0), (3, 1)}


def test_large_sessions_are_clustered_by_the_same_rule(spark):
    rng = np.random.default_rng(5)
    rows = [(s, 1_000 * n + i, rng.choice([None, int(rng.integers(50))]), rng.normal(size=3).tolist()) for n, s in enumerate("abc") for i in range(300)]
    rows += [("same", 5_000 + i, i, [1.0, 2.0]) for i in range(60)] + [("few", 6_000 + i, i, [float(i), 1.0]) for i in range(2)]
    rows += [("mixed", 7_000 + i, i, [1.0, float(i)] if i % 3 else [1.0]) for i in range(60)] + [("zero", 8_000 + i, i, [0.0, float(i == 40)]) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:100], "session_id string, emb_id long, start_ms long, vector array<double>").repartition(3)
    clusters = lambda k, most: {(r.session_id, r.emb_id): r.cluster for r in cluster_sessions(df, k, most).collect()}
    for k in (1, 3, 5):
        assert clusters(k, 50) == clusters(k, 1_000) and clusters(k, 1) == clusters(k, 1_000)
    with pytest.raises(Exception, match="most_items"):
        cluster_sessions(df, None, 50).collect()


def test_packing():
    assert pack_lines(None) == pack_lines("") == []
    text = "\n".join(f"Sentence number {i}." for i in range(3000))
    pieces = pack_lines(text)
    assert "\n".join(pieces) == text and all(len(p) <= 4000 for p in pieces) and len(pieces) > 1
    assert pack_lines("a\n" + "x" * 9000 + "\nb") == ["a", "x" * 9000, "b"]
    assert len(pack_lines("\n".join(["y" * 3999 + "."] * 100))) <= 40
