"""Search by grams, places in texts, and lines of JSON that vary, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import geocode, search
from tarn.streaming import landing


def test_first_hits_are_those_of_a_scan(spark):
    plants = [(k, f"Plant {k} Works") for k in range(30)] + [(99, None), (98, "")]
    operators = [(k, f"Oper {k} works", ("PE", "LOC", None)[k % 3]) for k in range(30)]
    index = search.name_index([(spark.createDataFrame(plants, "id long, name string"), "plant"), (spark.createDataFrame(operators, "id long, name string, bucket string"), "operator")], ("LOC", "PE"))
    terms = ["WORKS", " plant 7 ", "oper 2", "r 29", "7", "9 ", "zz", "zebra", "r 4 w", "", None, "works", "ant 30"]
    names = [((0, 0, k), "plant", n) for k, n in plants if n] + [((1, {"LOC": 0, "PE": 1}.get(b, 2), k), "operator", n) for k, n, b in operators]
    want = set()
    for q in {(x or "").strip().lower() for x in terms} - {""}:
        hits = [x for x in names if q in x[2].lower()]
        if hits:
            (order, layer, name) = min(hits)
            want.add((q, layer, order[2], name))
    out = search.first_hits(index, spark.createDataFrame([(x,) for x in terms], "term string"))
    assert {tuple(r) for r in out.collect()} == want and len(want) >= 7
    assert "PartitionFilters: [part" in out._jdf.queryExecution().toString()
    none = search.name_index([(spark.createDataFrame([], "id long, name string"), "plant")])
    assert search.first_hits(none, spark.createDataFrame([("works",), ("a",)], "term string")).count() == 0
    with pytest.raises(ValueError, match="terms"):
        search.first_hits(index, spark.range(search.TERMS + 1).select(F.col("id").cast("string").alias("term")))


def test_places_in_texts(spark, monkeypatch):
    states = {"new york": "NY", "york": "YK", "west virginia": "WV", "virginia": "VA", "ohio": "OH"}
    places = spark.createDataFrame([("Troy, OH", 1.0), ("Irving, TX", 2.0), ("OH", 3.0), ("NY", 4.0), ("WV", 5.0), ("VA", 6.0), ("B, OH", 7.0)], "place string, lat double").withColumn("lng", F.lit(0.0))
    said = [
        ("Troy, Ohio", 1.0, "narrow"), ("Nationwide (Irving, TX)", 2.0, "narrow"), ("Irving, TX (main)", 2.0, "narrow"), ("X / Troy, OH", 1.0, "wide"), ("near Old Troy, OH", 1.0, "narrow"), ("Nowhere, OH", 3.0, "wide"),
        ("parts of new york", 4.0, "wide"), ("Virginia Beach, West Virginia area", 5.0, "wide"), ("in ZZ or VA", 6.0, "wide"), ("nowhere", None, None), ("", None, None), (None, None, None), ("A and B, OH / C, TX", 7.0, "narrow"), ("midwest (OH)", 3.0, "wide"),
    ]
    rows = spark.createDataFrame([(k, s[0]) for k, s in enumerate(said)], "id int, location string")
    for sent in (200_000, 2):
        monkeypatch.setattr("tarn.sources.scratch.SENT_ROWS", sent)
        got = {r["id"]: (r["lat"], r["zoom"]) for r in geocode.geocoded(rows, places, states).collect()}
        assert got == {k: s[1:] for k, s in enumerate(said)}


def test_lines_land_or_are_set_aside(spark, tmp_path):
    source, items, bad = (tmp_path / x for x in ("in", "items", "bad"))
    source.mkdir()
    first = [{"headline": "a", "deal_summary": "one"}, {"headline": "b", "deal_summary": ["x", "", "<b>y</b>"], "relevance_score": "7", "is_deal": "yes", "new_field": 3}, {"headline": "c", "relevance_score": "high", "is_deal": True, "deal_summary": []}]
    (source / "1.json").write_text("\n".join([*map(json.dumps, first), "{broken", "[1, 2]", '"text"', "null"]) + "\n")
    run = lambda: landing.landing(spark, str(source), str(items), str(bad), str(tmp_path / "at")).awaitTermination()
    run()
    run()  # nothing new
    (source / "2.json").write_text(json.dumps({"headline": "d", "buyer": 5, "deal_summary": [1, 2]}) + "\n")
    run()
    got = {r["headline"]: r for r in spark.read.parquet(str(items)).collect()}
    assert got.keys() == {"a", "b", "c", "d"}
    assert [got[k]["deal_summary"] for k in "abcd"] == [["one"], ["x", "y"], None, ["1", "2"]]
    assert [got[k]["relevance_score"] for k in "abcd"] == [None, 7, None, None] and [got[k]["is_deal"] for k in "abc"] == [None, True, True]
    assert got["b"]["extra"] == {"new_field": "3"} and got["a"]["extra"] is None and got["d"]["buyer"] == "5"
    assert sorted((r["line"], r["problem"]) for r in spark.read.parquet(str(bad)).collect()) == sorted([("{broken", "not JSON"), ("[1, 2]", "no object"), ('"text"', "no object"), ("null", "no object")])
