"""What the reviewer of round 1 found wrong in the analytics operators, and the operators added since."""

import math

import pytest
from pyspark.sql import functions as F

from tarn import queries_more  # noqa: F401
from tarn.operators import curation, ingest, match, nearest, verification
from tarn.operators.components import components
from tarn.queries import v_news
from tarn.sources.scratch import written
from tarn.streaming import feed

PLACES = "id long, lat double, lng double"


def test_nearest_goes_round_the_globe(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 10.0, 179.95), (2, 10.0, -179.9), (3, 50.0, 0.0)], PLACES)
    plants = spark.createDataFrame([(7, 10.0, -179.95), (8, 10.5, 179.6), (9, 10.0, 178.0), (10, 50.3, 0.2)], PLACES)
    want = {r["id"]: (r["np"], round(r["nd"], 6)) for r in nearest.with_nearest(rows, plants).collect()}
    monkeypatch.setattr(nearest, "BROADCAST_ROWS", 2)
    assert {r["id"]: (r["np"], round(r["nd"], 6)) for r in nearest.with_nearest(rows, plants).collect()} == want and want[1][0] == 7
    assert {(r["a"], r["b"]) for r in nearest.pairs_within(rows, plants, 20).collect()} == {(1, 7), (2, 7)}


def test_nearest_market_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 39.77, -86.16), (1, 39.77, -86.16), (2, None, None)], PLACES)
    markets = spark.createDataFrame([("Here", 39.77, -86.15), ("There", 45.0, -100.0)], "name string, lat double, lng double")
    got = nearest.nearest_market(rows, markets).collect()
    assert len(got) == 3 and [r["target_market_name"] for r in got if r["id"] == 1] == ["Here (1 mi)"] * 2 and not any(r["is_target_market"] for r in got if r["id"] == 2)
    with pytest.raises(ValueError):
        nearest.nearest_market(rows, markets, most=1)


def test_admission_settles_a_chain(spark):
    n = 24
    pairs = written(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "chain")
    assert sorted(r["id"] for r in match.admitted(spark.range(n), pairs).collect()) == list(range(0, n, 2))


def test_known_operators_by_hand(spark):
    schema = "id long, n string, lat double, lng double"
    old = spark.createDataFrame([(1, "Acme Septic Services LLC", 40.0, -90.0), (2, "Best Grease", 40.0, -90.0), (3, None, 40.0, -90.0)], schema)
    new = spark.createDataFrame([(1, "ACME septic services inc.", 40.01, -90.0), (2, "Acme Septic Services", 41.0, -90.0), (3, "Acme Pumping", 40.0, -90.0), (4, "LLC", 40.0, -90.0), (5, "Good Name", 0.0, -90.0), (6, "Good Name", None, None)], schema)
    assert dict(curation.known_operators(new, old).collect()) == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_splicing_without_markers_is_an_error(spark):
    page = spark.createDataFrame([("x",)], "page string")
    with pytest.raises(Exception, match="markers"):
        page.select(curation.spliced_block(F.col("page"), "/*S*/", "/*E*/", F.lit("y"))).collect()


def test_last_verdict_counts_and_empties(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    verdicts = spark.createDataFrame([("1", "NOT_FOG", "a", 1), ("1", "CONFIRMED_FOG", "b" * 300, 2)], "id string, classification string, reason string, at int")
    got = {r["id"]: (r["classification"], r["reason"]) for r in verification.with_verdicts(rows, verdicts, F.lit(False)).collect()}
    assert got == {1: ("CONFIRMED_FOG", "b" * 200), 2: ("UNCLEAR", "no verdict returned"), None: ("UNCLEAR", "no verdict returned")}
    assert verification.with_verdicts(rows.where("false"), verdicts, F.lit(False)).count() == 0


def test_streams_drop_late_and_repeated_rows(spark, tmp_path):
    """feed's functions on a real stream: the second file repeats a row, the third has a late one, by when the watermark
    of the first counts."""
    schema = "id long, ts timestamp, kind string"
    make = lambda rows: spark.createDataFrame(rows, "id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    make([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-10 00:00:00", "b")]).coalesce(1).write.json(f"{tmp_path}/in/1")
    make([(2, "2024-01-10 00:00:00", "b"), (4, "2024-01-10 01:00:00", "c")]).coalesce(1).write.json(f"{tmp_path}/in/2")
    make([(3, "2024-01-01 00:00:00", "late"), (5, "2024-01-10 02:00:00", "c")]).coalesce(1).write.json(f"{tmp_path}/in/3")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")

    def ran(out, name):
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return [tuple(r) for r in spark.table(name).collect()]

    assert sorted(r[0] for r in ran(feed.deduplicated(stream, ["id"], "ts", "1 day"), "seen")) == [1, 2, 4, 5]
    counts = feed.windowed_counts(stream, "ts", "1 hour", "1 day", "kind")  # sets its own watermark; a stream may have one
    assert [(r[1], r[2]) for r in ran(counts, "counted")] == [("a", 1)]


def test_nearest_of_far_rows_without_joining_all(spark):
    """Rows far from every plant, ties and rows without coordinates, against brute force; no plan has a join with all."""
    rows = [(k, -80 + k * 37 % 160 + 0.25, -180 + k * 101 % 360 + 0.5) for k in range(30)] + [(100, None, 5.0), (101, 10.0, None)]
    plants = [(k, 30 + k * 7 % 20 + 0.1, -120 + k * 11 % 50 + 0.2) for k in range(12)] + [(50, 30.1, -119.8), (51, 95.0, 0.0), (52, None, None), (53, -60.0, 179.9)]

    def miles(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        return 2 * 3958.8 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))

    usable = [p for p in plants if p[1] is not None and abs(p[1]) <= 90]
    out = nearest.with_nearest(spark.createDataFrame(rows, PLACES), spark.createDataFrame(plants, PLACES))
    got = {r["id"]: (r["np"], r["nd"]) for r in out.collect()}
    for row in rows:
        if row[1] is None or row[2] is None:
            assert got[row[0]] == (None, None)
        else:
            nd, np = min((miles(row, p), p[0]) for p in usable)
            assert got[row[0]][0] == np and abs(got[row[0]][1] - nd) < 1e-6
    none = nearest.with_nearest(spark.createDataFrame(rows, PLACES), spark.createDataFrame([], PLACES))
    assert none.count() == len(rows) and none.where("np is not null").count() == 0


def test_links_have_the_components_of_the_pairs(spark, sf):
    news = v_news(spark, sf).withColumn("url", F.concat(F.lit("u/"), F.col("id") % 40))
    again = news.withColumns({"id": F.col("id") + 1_000_000, "date": F.lit("2025-01-05"), "headline": F.upper("headline")}).where("id % 3 = 0")
    keyed = written(ingest.news_keys(news.unionByName(again)), "keyed")
    links, pairs = match.news_links(keyed), match.news_pairs(keyed)
    assert sorted(components(links).collect()) == sorted(components(pairs.select("a", "b")).collect())
    same = spark.createDataFrame([(k, "Acme buys Bravo Rendering", f"u/{k % 3}", "2026-01-01") for k in range(300)], "id long, headline string, url string, date string")
    assert match.news_links(ingest.news_keys(same)).count() == 299
