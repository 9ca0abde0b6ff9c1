"""Places by ranges, samples by quotas, and audits by content."""

import random

from pyspark.sql import functions as F

from tarn.operators import audit, facilities
from tarn.operators.order import placed


def test_places_are_those_of_one_sort_and_many_tasks_share_the_work(spark):
    rng = random.Random(5)
    rows = [(k, "hot" if k % 3 else rng.choice("abc"), rng.choice([None, *range(9)])) for k in range(3000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "id long, a string, b int").repartition(7)
    got = placed(table, F.asc("a"), F.desc_nulls_last("b"), "id", ranges=12).collect()
    want = sorted(rows, key=lambda r: (r[1], r[2] is None, -(r[2] or 0), r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in want] and sorted(r["rank"] for r in got) == list(range(1, 3001))
    parts = table.repartitionByRange(12, F.asc("a"), F.desc_nulls_last("b"), "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 1000  # two thirds of the rows have one value
    assert placed(table.limit(0), "id").count() == 0


def test_quotas_and_what_falls_short(spark):
    rows = spark.createDataFrame([(k, "a" if k < 90 else "b" if k < 95 else None) for k in range(100)], "id long, tier string")
    quotas = {"a": 10, "b": 8, "c": 2}
    sample = facilities.stratified(rows, quotas)
    assert sorted(tuple(r) for r in facilities.shortfall(sample, quotas).collect()) == [("a", 10, 10, 0), ("b", 8, 5, 3), ("c", 2, 0, 2)]
    assert sorted(sample.collect()) == sorted(facilities.stratified(rows.repartition(5), quotas).collect())
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()


def test_audits_by_content(spark):
    rows = spark.createDataFrame([(1, 2), (None, 3), (4, None)], "a int, b int")
    meta = spark.createDataFrame([("n", 3), ("m", 5)], "field string, value long")
    weights = spark.createDataFrame([("x", "a", 0.4), ("x", "b", 0.6), ("y", "a", 0.9)], "profile string, criterion string, weight double")
    one = lambda df: tuple(df.first())
    assert one(audit.complete(10, rows, ["a", "b"], 5)) == (10, False, 4) and one(audit.complete(10, rows, ["a"], 1)) == (10, False, 1)
    assert one(audit.weights_fine(11, weights)) == (11, False, 1)
    assert [one(audit.counted_as(16, rows, meta, f)) for f in "nmx"] == [(16, True, 0), (16, False, 2), (16, False, 3)]
    assert sorted(tuple(r) for r in audit.counts_by(7, rows, "a").collect()) == [(7, "a", "1", 1), (7, "a", "4", 1), (7, "a", "?", 1)]
