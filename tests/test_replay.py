import random

import pytest

from voxloom.operators.replay import contiguous_watermark, replay, replay_parts

SCHEMA = "change_id long, rel_path string, synced_at long, deleted_at long, etag string"


def test_order_units_and_copies(spark):
    rows = [
        (1, "a", 1_700_000_000, None, "x"), (2, "a", 1_700_000_000_500, None, "y"), (2, "a", 1_700_000_000_500, None, "y"),
        (3, "b", 1_700_000_001, None, "x"), (4, "b", 1_700_000_001_000, 1_700_000_001_000, None), (5, None, 1_700_000_001, None, "x"),
        (6, "c", None, None, "z"), (7, "d", 1_700_000_000_000_000, None, "us"), (8, "d", 1_699_999_999, None, "late"),
    ]
    out = replay(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.rel_path, r.change_id, r.after_gap) for r in out.collect()) == [("a", 2, False), ("c", 6, False), ("d", 7, False)]
    assert replay(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("missing", [[], [5], [1], [40_000], [32_767], [32_768], [65_536, 70_000], list(range(30_000, 70_000))])
def test_watermark(spark, missing):
    ids = spark.range(1, 100_001)
    gone = spark.createDataFrame([(m,) for m in missing], "id long")
    ids = ids.join(gone, "id", "left_anti").withColumnRenamed("id", "change_id")
    left = sorted(set(range(1, 100_001)) - set(missing))
    expected = next((a for a, b in zip(left, left[1:]) if b != a + 1), left[-1])
    assert contiguous_watermark(ids.union(ids.limit(10)), "change_id").collect()[0][0] == expected


def test_watermark_of_large_numbers_and_of_none(spark):
    base = 2**61 - 5
    ids = spark.createDataFrame([(base + i,) for i in (0, 1, 2, 4)], "change_id long")
    assert contiguous_watermark(ids, "change_id").collect()[0][0] == base + 2
    assert contiguous_watermark(ids.limit(0), "change_id").collect()[0][0] is None
    assert contiguous_watermark(ids.selectExpr("-change_id - 40000 as change_id"), "change_id").collect()[0][0] == -base - 4 - 40000


def test_a_transaction_across_a_gap_is_held_as_a_whole(spark):
    rows = [(1, "a", 10, None, "t1", 1), (2, "b", 11, None, "t2", 2), (4, "b", 12, None, "t2", 2), (5, "a", 13, None, None, None), (7, "c", 14, None, "t3", 2)]
    df = spark.createDataFrame(rows, "change_id long, rel_path string, synced_at long, deleted_at long, tx string, size int")
    run = lambda frame, close: sorted((r.rel_path, r.change_id) for r in replay(frame, transaction="tx", transaction_size="size", close=close).collect())
    assert run(df, False) == [("a", 1)]
    assert run(df, True) == [("a", 5), ("b", 4)]  # t3 never became complete
    known = lambda close: sorted((r.rel_path, r.change_id) for r in replay(df, transaction="tx", close=close).collect())
    assert known(False) == [("a", 1)] and known(True) == [("a", 5), ("b", 4), ("c", 7)]  # without sizes what came of t3 is all
    filled = df.union(spark.createDataFrame([(3, "d", 11, None, None, None)], df.schema)).union(df.limit(2))
    assert run(filled, False) == [("a", 5), ("b", 4), ("d", 3)]


def test_held_changes_and_transactions(spark):
    rows = [(1, "a", 10, None, "1"), (2, "b", 11, None, "1"), (4, "a", 12, None, "2"), (5, "c", 13, None, "1")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.rel_path, r.change_id) for r in replay(df, close=False).collect()) == [("a", 1), ("b", 2)]
    assert sorted((r.rel_path, r.change_id, r.after_gap) for r in replay(df).collect()) == [("a", 4, True), ("b", 2, False), ("c", 5, True)]
    with_sizes = df.selectExpr("*", "case when change_id in (1, 2) then 't' else 'u' end as tx", "case when change_id in (1, 2) then 2 else 3 end as size")
    out = replay(with_sizes, transaction="tx", transaction_size="size")
    assert sorted((r.rel_path, r.change_id) for r in out.collect()) == [("a", 1), ("b", 2)]


def test_held_changes_are_merged_into_the_committed_state(spark):
    rows = [
        (1, "a", 10, None, "1"), (2, "b", 11, None, "1"), (3, "c", 20, None, "1"), (4, "d", 12, 12, None), (9, "a", 12, None, "2"),
        (8, "b", 13, 13, None), (7, "c", 15, None, "late"), (6, "d", 11, None, "late"), (10, "e", None, None, "1"), (11, "f", 1, 1, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = replay_parts(df, "rel_path", "change_id", "synced_at").collect()
    number = lambda x: x and x.order.q
    assert {r.rel_path: (number(r.committed), number(r.held)) for r in parts} == {"a": (1, 9), "b": (2, 8), "c": (3, 7), "d": (4, 6), "e": (None, 10), "f": (None, 11)}
    state = lambda close: sorted((r.rel_path, r.change_id, r.etag, r.after_gap) for r in replay(df, close=close).collect())
    assert state(False) == [("a", 1, "1", False), ("b", 2, "1", False), ("c", 3, "1", False)]
    assert state(True) == [("a", 9, "2", True), ("c", 3, "1", False), ("e", 10, "1", True)]


def test_shuffled_feed_gives_the_same_state(spark):
    rng = random.Random(2)
    rows = [(i, f"p{rng.randint(0, 9)}", rng.randint(1, 30), rng.choice([None, None, 3]), str(i)) for i in range(1, 200)]
    last = {}
    for r in rows:
        if r[1] not in last or (r[2], r[0]) > (last[r[1]][2], last[r[1]][0]):
            last[r[1]] = r
    want = sorted((r[1], r[0]) for r in last.values() if r[3] is None)
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    assert sorted((r.rel_path, r.change_id) for r in replay(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_columns_of_any_name(spark):
    names = ["_commit", "_seq", "_tx", "_whole", "_salt", "_x", "_later", "_value", "_key", "order", "change"]
    rows = [(1, "a", 10, None, "t", 2), (2, "b", 11, None, "t", 2), (3, "a", 12, None, None, None), (4, "c", 9, 9, "u", 1)]
    df = spark.createDataFrame(rows, "change_id long, rel_path string, synced_at long, deleted_at long, tx string, size int").selectExpr("*", *[f"'{n}' as {n}" for n in names])
    for given in ({}, {"transaction": "tx", "transaction_size": "size"}):
        found = replay(df, **given)
        assert found.columns == [*df.columns, "after_gap"]
        assert sorted((r.rel_path, r.change_id) for r in found.collect()) == [("a", 3), ("b", 2)]
        assert {tuple(r[n] for n in names) for r in found.collect()} == {tuple(names)}
