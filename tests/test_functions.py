"""Expected values of the normalisers, dates, distances and predicates on tiny rows."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import dates, geo, text
from tarn.operators import facilities, match, views
from tarn.plans import packs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("said", "key"), [("Acme Inc. Announces Q1 2026 Results", "acme announces results"), ("The Acme Corp announces results for FY2026", "acme announces results"), (None, ""), ("", ""), ("   ", "")])
def test_headlines(spark, said, key):
    assert one(spark, text.normalized_headline("h"), h=said) == key


@pytest.mark.parametrize(("said", "key"), [("Acme Septic Services, LLC", "acme"), ("R Crews Family Septic", "r crews family"), ("Environmental Services Group Inc", ""), ("The Wind River Group", "wind river"), ("Wind River Environmental", "wind river")])
def test_companies(spark, said, key):
    assert one(spark, text.normalized_company("c"), c=said) == key


@pytest.mark.parametrize(("a", "b", "t", "hit"), [("mahopac", "r crews family", 0.3, False), ("john matthes", "matthes", 0.8, True), ("a b c", "a b d", 0.7, False), ("a b c", "a b d", 0.5, True), ("art", "martin pumping", 0.8, True), ("", "x", 0.1, False)])
def test_names_match(spark, a, b, t, hit):
    assert one(spark, match.names_match(F.col("a"), F.col("b"), t), a=a, b=b) is hit


def test_jaccard(spark):
    j = lambda a, b: one(spark, match.jaccard(text.headline_tokens("a"), text.headline_tokens("b")), a=a, b=b)
    assert j("Acme Inc. Announces Q1 2026 Results", "Acme announces first-quarter results") == 0.6
    assert j("City adopts FOG ordinance for restaurants", "City council adopts new FOG ordinance") == pytest.approx(4 / 7)


def test_urls(spark):
    for u in ("https://www.Pehub.com/2026/Deal/?utm=1#x", "HTTP://pehub.com/2026/deal"):
        assert one(spark, text.normalized_url("u"), u=u) == "pehub.com/2026/deal"
    for u in ("https://pehub.com", "https://pehub.com/news/", "https://pehub.com/News", "not a url", "", "https://pehub.com/index.html?x=1"):
        assert one(spark, text.is_front_page("u"), u=u)
    for u in ("https://pehub.com/news/x", "https://x.com/blog/post"):
        assert not one(spark, text.is_front_page("u"), u=u)


@pytest.mark.parametrize(("d", "ok"), [("2026-01-05", True), ("20260105", True), ("2026-01-05T10:00:00", True), ("2026-1-5", False), ("2026", False), ("2026-02-30", False), ("", False), (None, False)])
def test_iso_dates(spark, d, ok):
    assert one(spark, dates.is_valid("d"), d=d) is ok


def test_age_limits(spark):
    as_of = F.lit("2026-01-20").cast("date")
    assert not one(spark, dates.too_old("d", as_of), d="2026-01-06")
    assert one(spark, dates.too_old("d", as_of), d="2026-01-05")
    assert not one(spark, dates.too_old("d", as_of), d=None)


def test_distances(spark):
    miles = lambda *p: one(spark, geo.haversine_miles(*[F.lit(x) for x in p]))
    assert miles(39.768, -86.158, 39.103, -84.512) == pytest.approx(99.1267, abs=1e-4)
    assert miles(38.627, -90.199, 38.253, -85.758) == pytest.approx(241.7016, abs=1e-4)


def test_zero_fill_and_title(spark):
    for z, want in (("501", "00501"), ("123456", "123456")):
        assert one(spark, text.zero_filled(F.col("z"), 5), z=z) == want
    assert one(spark, text.title_cased("n"), n="joe's septic-tank") == "Joe'S Septic-Tank"


def test_completeness(spark):
    row = spark.createDataFrame([(" abc ", "x" * 500, ["one", "two"], [], None, False, True, 0, 40.1, 0.0)], "a string, b string, c array<string>, d array<string>, e string, f boolean, g boolean, h int, i double, j double")
    assert row.select(match.completeness(dict(row.dtypes)).alias("v")).first()["v"] == 559


def test_buckets_and_tiers(spark):
    for o, b in (("", "LOC"), (None, "LOC"), ("Wind River Environmental", "WRE"), ("Public: X", "PUB"), ("Chuck's", "PE"), ("Independent", "LOC"), ("Regional: Y", "REG"), ("other", "PE")):
        assert one(spark, facilities.bucket(F.col("o")), o=o) == b
    assert [one(spark, views.tier(F.col("s")), s=s) for s in (3.5, 3.4999, 3.0, 2.9999999999999996)] == ["A", "B", "B", "C"]


def test_weights_sum_to_one():
    assert all(sum(w) == pytest.approx(1.0, abs=1e-9) and len(w) == len(packs.CRITERIA) for w in packs.WEIGHTS.values())


def test_csv_cells(spark):
    for c, want in (("plain", "plain"), ('a "b"', '"a ""b"""'), ("a,b", '"a,b"'), (None, "")):
        assert one(spark, views.csv_cell(F.col("c")), c=c) == want


def test_facility_cascade(spark):
    rows = [("Taylor Meat Company", "", "", "", "311613"), ("River Valley Ingredients Poultry", "", "", "", "311613;1"), ("City of X sewer", "", "", "", "562991"), ("Bob", "", "", "", "562991"), ("All City Environmental", "", "", "", "1"), ("Wind River", "", "", "", "")]
    got = [r["r"] for r in spark.createDataFrame(rows, "n string, op string, ot string, ct string, na string").select(facilities.cascade().alias("r")).collect()]
    assert got == ["dropped_311613_meat", "kept_311613_term", "dropped_municipal", "kept_562991", "kept_consolidator", "kept_consolidator"]  # the fifth is a brand of the whole list
