import random

from voxloom.operators.periods import periods_and_gaps


def brute(rows, max_gap):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        own = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e > s)
        merged = []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] < max_gap]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        s = rng.choice([rng.randint(0, 300), rng.randint(-50, 3000)])
        rows.append((rng.choice(["a", "b", "b", "b", None]), rng.choice([s, s, s, None]), rng.choice([s + rng.randint(-3, 40), s + rng.randint(0, 900), None])))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k string, start_ms long, end_ms long").selectExpr("*", "1 as kind", "2 as _b")
    found = sorted(map(tuple, periods_and_gaps(df, ["k"], max_gap=60, bucket_width=100).collect()))
    assert found == brute(rows, 60)


def test_touching_nested_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 2, 5), ("a", 21, 22), ("a", 30, 30)], "k string, start_ms long, end_ms long")
    assert sorted(map(tuple, periods_and_gaps(df, ["k"]).collect())) == [("a", "gap", 20, 21), ("a", "period", 0, 20), ("a", "period", 21, 22)]
    assert periods_and_gaps(df.limit(0), ["k"]).count() == 0
