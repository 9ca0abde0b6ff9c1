"""Nearest plants and radius joins where most rows and plants lie in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import nearest

PLACES = "id long, lat double, lng double"


def miles(a, b):
    la, lb = np.radians(a), np.radians(b)
    h = np.sin((lb[..., 0] - la[..., 0]) / 2) ** 2 + np.cos(la[..., 0]) * np.cos(lb[..., 0]) * np.sin((lb[..., 1] - la[..., 1]) / 2) ** 2
    return 2 * 3958.8 * np.arcsin(np.sqrt(np.minimum(h, 1)))


@pytest.mark.parametrize("few", [True, False])
def test_nearest_in_a_dense_city_and_all_over_the_globe(spark, monkeypatch, few):
    rng = np.random.default_rng(2)
    city = lambda n: rng.normal((40.0, -90.0), 0.01, (n, 2))
    over = lambda n: np.stack((rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)), axis=1)
    rows = np.concatenate((city(200), over(150), [(90, 0), (-90, 180), (0, 180), (0, -180), (40, -90)]))
    plants = np.concatenate((city(1500), over(60), np.tile([(40.0, -90.0)], (200, 1)), [(0, 179.99), (89.9, 120)]))
    monkeypatch.setattr(nearest, "HOT_ROWS", 40)
    monkeypatch.setattr(nearest, "LEAF", 16)
    if not few:
        monkeypatch.setattr(nearest, "BROADCAST_ROWS", 10)
    frame = lambda x: spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], PLACES)
    got = {r["id"]: (r["np"], r["nd"]) for r in nearest.with_nearest(frame(rows), frame(plants)).collect()}
    d = miles(rows[:, None], plants[None])
    assert len(got) == len(rows)
    for k in range(len(rows)):
        assert got[k][1] == pytest.approx(d[k].min(), abs=1e-4) and d[k][got[k][0]] <= d[k].min() + 1e-6


def test_cells_of_the_tree_stay_small(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(nearest, "LEAF", 16)
    plants = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.normal((40.0, -90.0), 0.001, (3000, 2)))]
    tree = nearest.cell_tree(spark.createDataFrame(plants, "np long, p_lat double, p_lng double"))
    held = sum(level.select(F.explode("holds").alias("c")).where("c.cy is null").count() for level in tree)
    assert held == 3000 and max(level.agg(F.max(F.size("holds"))).first()[0] for level in tree) <= 64
    monkeypatch.setattr(nearest, "LEVELS", 1)  # what can't be split is cut
    (only,) = nearest.cell_tree(spark.createDataFrame(plants, "np long, p_lat double, p_lng double"))
    assert only.count() > 100 and only.select(F.explode("holds")).count() == 3000 and only.agg(F.max(F.size("holds"))).first()[0] <= 64


def test_rows_of_a_hot_key_are_several_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(nearest, "HOT_ROWS", 100)
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    a, b = nearest.spread(left, right, ["k"], "id")
    sizes = [r["count"] for r in a.where("k = 0").groupBy("_part").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 200 and a.where("k > 0 and _part > 0").count() == 0
    assert a.join(b, ["k", "_part"]).count() == 1000


def test_pairs_of_a_dense_cell(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal((40.0, -90.0), 0.3, (300, 2))
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], PLACES)
    d = miles(x[:, None], x[None])
    want = {(a, b) for a, b in zip(*np.nonzero(d <= 10), strict=True) if a < b}
    for hot in (nearest.HOT_ROWS, 20):
        monkeypatch.setattr(nearest, "HOT_ROWS", hot)
        assert {(r["a"], r["b"]) for r in nearest.within_radius(rows, rows, 10).collect()} == want
