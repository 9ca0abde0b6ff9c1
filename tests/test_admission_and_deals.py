"""Greedy admission by components, and deals that match, against the rule gone through pair by pair."""

import datetime
import random

from pyspark.sql import functions as F

from tarn.operators import match
from tarn.operators.components import components
from tarn.sources.scratch import written


def in_turn(ids, pairs):
    entered = set()
    for k in sorted(ids):
        if not any(b == k and a in entered for a, b in pairs):
            entered.add(k)
    return sorted(entered)


def test_admission_of_components_and_rounds(spark):
    rng = random.Random(1)
    for in_order in (1_000_000, 3, 1):
        pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)})
        got = match.admitted(spark.range(70), spark.createDataFrame(pairs, "a long, b long"), in_order)
        assert sorted(r["id"] for r in got.collect()) == in_turn(range(70), pairs)
    words = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert sorted(r["id"] for r in match.admitted(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string"), words).collect()) == ["a", "c", "d"]
    assert match.admitted(spark.range(3), spark.createDataFrame([], "a long, b long")).count() == 3


def test_a_long_chain_takes_few_jobs(spark):
    n = 100_000
    pairs = written(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "chain")
    group = "chain-of-matches"
    spark.sparkContext.setJobGroup(group, group)
    got = match.admitted(spark.range(n), pairs)
    assert got.agg(F.count("*"), F.sum(F.col("id") % 2)).first() == (n // 2, 0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs < 400


def names_match(a, b, threshold):
    x, y = set(a.split(" ")), set(b.split(" "))
    return bool(a and b) and (a in b or b in a or len(x & y) / min(len(x), len(y)) >= threshold)


def same(a, b, placed):
    if not (a[1] and a[2] and b[1] and b[2]) or not names_match(a[2], b[2], 0.7):
        return False
    close = a[3] is not None and b[3] is not None and abs((a[3] - b[3]).days) <= 60
    near = placed and None not in (a[4], b[4]) and 69.09 * abs(a[4] - b[4]) <= 50
    return names_match(a[1], b[1], 0.8) or names_match(a[1], b[1], 0.5) and close or names_match(a[1], b[1], 0.3) and close and bool(near)


def some_deals(rng, n):
    words = ["acme", "best", "north", "river", "oil", "x", "ab", "acm", "waste water", "grease", "blue", "green", "county", "river oil"]
    name = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0 if rng.random() < 0.05 else 1, most)))
    day = lambda: None if rng.random() < 0.05 else datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(700))
    return [(k, name(4), name(3), day(), rng.choice([None, 30 + rng.randrange(60) / 20])) for k in range(n)]


DEAL = "id long, target_key string, acquirer_key string, date date, lat double"


def test_deal_pairs_are_those_of_the_rule(spark):
    deals = some_deals(random.Random(2), 220)
    table = spark.createDataFrame(deals, DEAL).withColumn("lng", F.lit(10.0))
    for placed, rows in ((True, table), (False, table.drop("lat", "lng"))):
        want = {(a[0], b[0]) for k, b in enumerate(deals) for a in deals[:k] if same(a, b, placed)}
        assert {tuple(r) for r in match.deal_pairs(rows).collect()} == want and len(want) > 100
        whole = components(spark.createDataFrame(sorted(want), "a long, b long"))
        assert sorted(components(match.deal_links(rows)).collect()) == sorted(whole.collect())


def test_a_class_of_equal_deals_hangs_on_one(spark):
    rows = spark.range(500).selectExpr("id", "'acme grease' AS target_key", "'north' AS acquirer_key", "date_add(date'2024-01-01', cast(id % 5 AS int)) AS date")
    assert match.deal_links(rows).count() == 499


def test_alike_names_find_names_inside_others(spark):
    names = ["a", "ab", "abc", "xaby", "abc d", "d", "zz top", "top zz", "q"]
    got = {tuple(r) for r in match.NameIndex(spark.createDataFrame([(n,) for n in names + ["", None]], "n string")).pairs(0.7).collect()}
    assert got == {(a, b) for a in names for b in names if names_match(a, b, 0.7)}
