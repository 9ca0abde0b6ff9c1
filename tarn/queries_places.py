"""Queries of the search index, the places in texts and the landing zone, added to those of tarn.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import geocode, search
from tarn.plans import packs
from tarn.queries import query, quoted, t
from tarn.streaming import landing

TERMS_SQL = "SELECT DISTINCT lower(trim(x)) AS term FROM (SELECT right(s_name, 5) AS x FROM supplier UNION ALL SELECT left(p_name, 2) FROM part UNION ALL SELECT substr(p_name, 2, 6) FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT c_mktsegment FROM customer) WHERE trim(x) <> ''"
NAMES_SQL = f"SELECT 0 AS k, 0 AS b, 'plant' AS layer, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1, list_position([{quoted(reversed(packs.BUCKETS))}], ([{quoted(packs.BUCKETS)}])[1 + c_custkey % 10]), 'operator', c_custkey, c_name FROM customer UNION ALL SELECT 2, 0, 'works', p_partkey, p_name FROM part"


@query("facility_search_terms", f"SELECT term, layer, id, name FROM ({TERMS_SQL}) JOIN ({NAMES_SQL}) ON contains(lower(name), term) QUALIFY row_number() OVER (PARTITION BY term ORDER BY k, b, id) = 1")
def facility_search_terms(spark, d):
    """The first hit of every term over plants, operators (here in the buckets' reversed order) and works."""
    bucket = F.element_at(F.array(*[F.lit(b) for b in packs.BUCKETS]), (F.col("c_custkey") % 10 + 1).cast("int"))
    plants = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    operators = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), bucket.alias("bucket"))
    works = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    terms = t(spark, d, "supplier").select(F.substring("s_name", -5, 5).alias("term"))
    for c in (F.substring("p_name", 1, 2), F.substring("p_name", 2, 6), F.col("p_name")):
        terms = terms.union(t(spark, d, "part").select(c))
    terms = terms.union(t(spark, d, "customer").select("c_mktsegment"))
    return search.first_hits_of_all([(plants, "plant"), (operators, "operator"), (works, "works")], terms.distinct(), tuple(reversed(packs.BUCKETS)))


STATES = {"ohio": "OH", "new york": "NY", "york": "YK"}
# a form of text for each candidate: its words before and after the town, and the place and zoom that it leads to
FORMS = (
    ("", ", Ohio", "town", "narrow"), ("", ", OH", "town", "narrow"), ("National (HQ ", ", OH)", "town", "narrow"), ("Nationwide (", ", OH)", "town", "narrow"), ("", ", OH (main office)", "town", "narrow"),
    ("Nowhere, ZZ / ", ", Ohio", "town", "wide"), ("Elsewhere | ", ", OH", "town", "wide"), ("Elsewhere and ", ", OH", "town", "wide"), ("Elsewhere & ", ", OH", "town", "wide"), ("at Old ", ", OH", "town", "narrow"),
    ("the plant near ", " in Nowhere, OH today", "OH", "wide"), ("all of New York but ", "", "NY", "wide"), ("sites of ", " in XX or NY", "NY", "wide"), ("", "", "none", None),
)

def _forms_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, _, kind, _) in enumerate(FORMS))
    zooms = " ".join(f"WHEN {k} THEN '{zoom}'" for k, (*_, zoom) in enumerate(FORMS) if zoom)
    return f"SELECT c_custkey AS id, CASE kind WHEN 'town' THEN 30.0::DOUBLE + c_custkey WHEN 'OH' THEN -1.0::DOUBLE WHEN 'NY' THEN -2.0::DOUBLE END AS lat, zoom FROM (SELECT c_custkey, CASE c_custkey % {len(FORMS)} {cases} END AS kind, CASE c_custkey % {len(FORMS)} {zooms} END AS zoom FROM customer)"


@query("geocode_candidates", _forms_sql())
def geocode_candidates(spark, d):
    """A text that only each candidate resolves, for every customer; "(HQ Town, OH)" resolves by its last word alone."""
    key = F.col("c_custkey")
    town = F.concat(F.lit("T"), F.translate(key.cast("string"), "0123456789", "abcdefghij"))
    pick = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in FORMS]), (key % len(FORMS) + 1).cast("int"))
    rows = t(spark, d, "customer").select(key.alias("id"), F.concat(pick(0), town, pick(1)).alias("location"))
    towns = t(spark, d, "customer").select(F.concat(town, F.lit(", OH")).alias("place"), (key + 30.0).alias("lat"), F.lit(-90.0).alias("lng"))
    centres = spark.createDataFrame([("OH", -1.0, 0.0), ("NY", -2.0, 0.0)], "place string, lat double, lng double")
    return geocode.geocoded(rows, towns.union(centres), STATES).select("id", "lat", "zoom")


@query("news_landing", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'not JSON' WHEN o_orderkey % 17 = 0 THEN 'no object' END AS problem, CASE WHEN ok THEN 'Deal ' || o_orderkey END AS headline, CASE WHEN ok THEN o_orderkey % 11 END::INT AS score, CASE WHEN ok THEN CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || ' | ' || o_orderstatus WHEN 1 THEN o_orderpriority END END AS bullets, CASE WHEN ok AND o_orderkey % 5 = 0 THEN o_orderstatus END AS colour FROM (SELECT *, o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS ok FROM orders)")
def news_landing(spark, d):
    """Orders as raw items: scores as numbers and texts, summaries as lists, texts and none, fields unheard of, broken lines."""
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    head = F.concat(F.lit("Deal "), key.cast("string")).alias("headline")
    texts = F.to_json(F.struct(head, (key % 11).cast("string").alias("relevance_score"), F.when(key % 3 == 1, priority).alias("deal_summary"), F.when(key % 5 == 0, status).alias("colour")))
    lists = F.to_json(F.struct(head, (key % 11).alias("relevance_score"), F.array(priority, F.lit(""), status).alias("deal_summary"), F.when(key % 5 == 0, status).alias("colour")))
    line = F.when(key % 13 == 0, F.substring(lists, 1, 9)).when(key % 17 == 0, F.concat(F.lit("["), texts, F.lit("]"))).when(key % 3 == 0, lists).otherwise(texts)
    seen = landing.landed(t(spark, d, "orders").select(key.alias("id"), line.alias("value")))
    return seen.select("id", "problem", "headline", F.col("relevance_score").alias("score"), F.array_join("deal_summary", " | ").alias("bullets"), F.col("extra")["colour"].alias("colour"))
