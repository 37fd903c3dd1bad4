import random
from math import ceil

import pytest

from voxloom.llm.mixing import bucket_bits_for, mixture, pfair, quotas, slots_for

TARGET = "source string, weight double, max_repeats int"


def test_quotas():
    assert quotas({"a": (50, 1000), "b": (50, 10)}, 100) == {"a": 90, "b": 10}
    assert quotas({"a": (1, 5), "b": (0, 100), "c": (3, 0)}, 100) == {"a": 5, "b": 0, "c": 0}
    assert quotas({}, 5) == {}
    out = quotas({"a": (30, 40), "b": (20, 100), "c": (50, 100)}, 100)
    assert sum(out.values()) == pytest.approx(100) and out["b"] / out["c"] == pytest.approx(0.4)


def test_schedule_stays_within_one_block():
    rng = random.Random(1)
    for _ in range(40):
        blocks = {f"s{i}": rng.choice([0, rng.uniform(0.1, 5), rng.randint(1, 300)]) for i in range(rng.randint(1, 9))}
        blocks["z"] = 3.0
        counts = {s: ceil(n) for s, n in blocks.items()}
        order, total, seen = pfair(blocks), sum(counts.values()), {}
        assert len(order) == total
        for t, (s, j) in enumerate(order, 1):
            assert j == seen.get(s, 0)
            seen[s] = j + 1
            assert all(abs(seen.get(x, 0) * total - n * t) < total for x, n in counts.items())
    with pytest.raises(ValueError):
        pfair({"a": 100.0}, 10)


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Web", " web", "web\xa0", "web", "news", "tiny", "other", None]), rng.choice([0, None, 3, 10, 40])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").selectExpr("*", "1 as slot", "2 as _s")
    goals = spark.createDataFrame([("web", 40.0, 1), ("News", 50.0, 3), ("tiny", 10.0, 2), ("none", 5.0, 9), ("other", 0.0, 4), (None, 9.0, 1)], TARGET)
    mix, report = mixture(docs, goals)
    total = sum(r[2] or 0 for r in rows)
    found = mix.toPandas().sort_values(["slot", "place", "doc_id"])
    shares = {r.source: r for r in report.collect()}
    assert set(shares) == {"web", "news", "tiny", "none", "other"} and shares["none"].actual_tokens == shares["other"].actual_tokens == 0
    assert abs(found.n_tokens.sum() - total) < 200
    assert all(r.actual_tokens == found[found.source == s].n_tokens.sum() for s, r in shares.items())
    times = found.groupby(["source", "doc_id"]).size()
    for source, most in (("web", 1), ("news", 3), ("tiny", 2)):
        assert times[source].max() <= most and times[source].max() - times[source].reindex([i for i, s, _ in rows if (s or "").strip().lower() == source], fill_value=0).min() <= 1
    # Less than a block by the schedule, a document more at its edges, and what the last block of each source lacks.
    block = max(found.n_tokens.sum() / 4096, 8 * 40)
    slots = found.slot.max() + 1
    for source in ("web", "news", "tiny"):
        share = found[found.source == source].n_tokens.sum() / found.n_tokens.sum()
        off = ((found.source == source) * found.n_tokens).cumsum() - share * found.n_tokens.cumsum()
        rounding = abs(found[found.source == source].slot.nunique() - share * slots)
        assert off.abs().max() < block + 40 + rounding * block and rounding < 1
    again = mixture(docs, goals)[0].toPandas().sort_values(["slot", "place", "doc_id"])
    assert again.doc_id.tolist() == found.doc_id.tolist()
    assert mixture(docs.limit(0), goals)[0].count() == 0 and mixture(docs, goals.limit(0))[0].count() == 0
    assert mixture(docs.limit(0), goals)[1].count() == 5


def test_blocks_and_buckets_grow_with_the_corpus():
    assert slots_for(0) == slots_for(10**9) == 4096 and slots_for(10**12) == 59604 and slots_for(10**15) == 1 << 18
    assert bucket_bits_for(0) == 12 and bucket_bits_for(10**12) == 13 and bucket_bits_for(10**17) == 24
