import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators.scan import previous, running_sum, runs, salted_join, sliced
from voxloom.operators.utterances import merge_utterances


def test_sliced_scans(spark):
    rng = random.Random(4)
    rows = [("s", t, i, rng.random() < 0.2, rng.randint(0, 5)) for i, t in enumerate(sorted(rng.choices(range(-90, 500), k=120)))]
    df = spark.createDataFrame(rows, "k string, t long, i long, new boolean, v long")
    order = ["t", "i"]
    out = previous(sliced(df, ["k"], "t", 7), ["k"], order, {"v": "before"})
    out = runs(out, ["k"], order, lambda before, row: row["new"], "start", "place")
    out = running_sum(out, ["k"], order, "v", "total")
    found = {r.i: (r.before, tuple(r.start), r.place, r.total) for r in out.select("i", "before", "start", "place", "total").collect()}
    start, place, total = None, 0, 0
    for n, (_, t, i, new, v) in enumerate(rows):
        start, place = ((t, i), 0) if new or start is None else (start, place + 1)
        total += v
        assert found[i] == (rows[n - 1][4] if n else None, start, place, total)
    assert sliced(df.limit(0), ["k"], "t", 7).agg(F.count("*")).first()[0] == 0


def test_salted_join_keeps_every_row_once(spark):
    rows = spark.range(50).selectExpr("id", "case when id < 40 then 'a' when id < 45 then 'b' end as k")
    lookup = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    found = salted_join(rows, lookup, ["k"], "id").collect()
    assert sorted(r.id for r in found) == list(range(50)) and {(r.k, r.v) for r in found} == {("a", 1), ("b", None), (None, None)}


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_long_runs_are_folded_in_blocks(spark, block):
    rng = random.Random(block)
    rows, at = [], 0
    for i in range(400):
        at += rng.randint(1, 400)
        rows.append(("s", i, at, at + rng.choice([0, 300, 900]), "x" * rng.randint(1, 4) + ("." if rng.random() < 0.004 else ""), 1, rng.random() < 0.1))
    df = spark.createDataFrame(rows, "session_id string, seg_id long, start_ms long, end_ms long, text string, speaker_id long, overlapped boolean")
    want = []
    for _, seg, start, end, text, _, over in rows:
        if want and start - want[-1][2] < 2500 and end - want[-1][1] <= 3000 and len(want[-1][3]) + len(text) <= 7 and not want[-1][3].endswith("."):
            want[-1][2:] = [end, want[-1][3] + text, want[-1][4] or over]
        else:
            want.append([seg, start, end, text, over])
    for width in (1000, 10**7):
        out = merge_utterances(df.union(df.limit(30)), max_duration=3000, max_chars=7, width=width, block=block)
        assert sorted(list(r) for r in out.select("first_seg", "start_ms", "end_ms", "text", "overlapped").collect()) == want


def test_the_input_of_utterances_is_shuffled_once(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 0, 1, "a", 1, False)], "session_id string, seg_id long, start_ms long, end_ms long, text string, speaker_id long, overlapped boolean")
    df.write.parquet(str(tmp_path / "t"))
    rows = merge_utterances(spark.read.parquet(str(tmp_path / "t")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rows._jdf.queryExecution().sparkSession().sessionState().executePlan(rows._jdf.queryExecution().logical(), rows._jdf.queryExecution().mode()).executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("FileScan") <= 2 and plan.count("Exchange hash") <= 8
