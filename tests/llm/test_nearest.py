import os
import random

import pytest

from tests.comparing import DATA, check, connection
from voxloom.llm.nearest import nearest_by_ticks
from voxloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("tick", [None, 1, 7, 1000])
def test_against_brute_force(spark, tick):
    rng = random.Random(5)
    left = [(rng.choice("abb"), i, rng.choice([None, *range(0, 400)])) for i in range(150)] + [(None, 999, 5)]
    right = [(rng.choice("abc"), rng.randint(0, 300), rng.choice([None, *range(-20, 420, 3)])) for _ in range(120)]
    want = []
    for e, i, t in left:
        near = [(abs(u - t), u, j) for f, j, u in right if f == e and u is not None and t is not None and abs(u - t) <= 25]
        if near:
            d, _, j = min(near)
            want.append((i, "r", j, d))
    schema = "session_id string, {0} long, start_ms long"
    a = spark.createDataFrame(left + left[:20], schema.format("seg_id")).selectExpr("*", "1 as source", "2 as _t")
    b = spark.createDataFrame(right + right[:20], schema.format("id")).selectExpr("*", "3 as _e")
    found = nearest_by_ticks(a, {"r": (b, "id")}, tolerance=25, tick=tick)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert nearest_by_ticks(a, {"r": (b.limit(0), "id")}, tolerance=25).count() == 0
    assert nearest_by_ticks(a.limit(0), {"r": (b, "id")}, tolerance=0).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name], connection())
