"""What the reviewer of round 1 found in the analytics queries."""

from tarn.operators import match
from tarn.queries import QUERIES


def test_deal_pairs_by_substring_and_by_place(spark, sf):
    near = [(1, "x a b", "buyer 1", 10.0), (2, "x c d", "buyer 12", 10.1), (3, "x e f", "buyer 100", 12.0)]
    deals = spark.createDataFrame(near, "id long, target_key string, acquirer_key string, lat double").selectExpr("*", "10D AS lng", "date'2024-01-01' AS date")
    assert match.deal_pairs(deals).collect() == [(1, 2)] and match.deal_pairs(deals.drop("lat", "lng")).count() == 0
    equal, whole = ({tuple(r) for r in QUERIES[q](spark, sf).collect()} for q in ("deal_fuzzy_pairs", "deal_fuzzy_pairs_whole"))
    assert equal < whole


def test_whole_texts_are_labelled_and_cover_deals(spark, sf):
    first, whole = ({r["id"]: r["n"] for r in QUERIES[q](spark, sf).collect()} for q in ("news_classify_multi", "news_classify_multi_whole"))
    assert first.keys() == whole.keys() and all(whole[k] >= n for k, n in first.items()) and whole != first
    has, more = ({r["id"] for r in QUERIES[q](spark, sf).collect()} for q in ("deal_has_news", "deal_has_news_whole"))
    missing = {r["id"] for r in QUERIES["deal_missing_news_whole"](spark, sf).collect()}
    assert has <= more and not more & missing and len(more | missing) == len(first)
