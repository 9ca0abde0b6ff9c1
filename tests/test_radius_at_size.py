"""Radius joins whose tasks are bounded by pairs, and operators known by name and place."""

import math
import random

from tarn.operators import curation, nearest


def miles(a, b):
    (p, q), (r, s) = [[math.radians(x) for x in y] for y in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(h))


def test_a_radius_join_has_tasks_by_pairs(spark, monkeypatch):
    rng = random.Random(1)
    at = [(k, 40 + rng.random() / 2, -90 + rng.random() / 2) for k in range(300)]
    rows = spark.createDataFrame(at, "id long, lat double, lng double")
    monkeypatch.setattr(nearest, "TASK_PAIRS", 1000)
    found = nearest.within_radius(rows, rows, 5)
    assert found.rdd.getNumPartitions() > 8
    want = {(a, b) for a, *p in at for b, *q in at if a < b and miles(p, q) <= 5}
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_operators_are_known_by_alike_names_about(spark):
    rng = random.Random(2)
    names = ["Acme Grease Works", "Works Grease Acme", "Acme Grease Works North", "Best Septic", "Best Pumping", "Blue", "", None]
    some = lambda n: [(k, rng.choice(names), rng.choice([None, 0.0]) if rng.random() < 0.1 else 40 + rng.random() * 2, -90 + rng.random() * 2) for k in range(n)]
    own, other = some(120), some(60)
    table = lambda rows: spark.createDataFrame(rows, "id long, n string, lat double, lng double")
    alike = lambda a, b: bool(a and b) and len(set(a.split()) & set(b.split())) >= 0.7 * len(set(a.split()) | set(b.split()))
    want = {k: not n or not lat or any(m and alike(n, m) and la is not None and miles((lat, lng), (la, lo)) <= 12 for _, m, la, lo in other) for k, n, lat, lng in own}
    got = curation.known_operators(table(own), table(other), miles=12)
    assert {r["id"]: r["known"] for r in got.collect()} == want and 10 < sum(want.values()) < 110
    # names that nobody has alike meet nobody, however many are about
    assert curation.known_operators(table([(1, "Blue", 40.0, -90.0)]), table([(k, "Best Septic", 40.0, -90.0) for k in range(9)])).collect()[0]["known"] is False
