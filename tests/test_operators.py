"""Operators against brute force, and every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn import queries_more, queries_rules  # noqa: F401  add to the queries
from tarn.functions import text
from tarn.operators import ingest, match, nearest
from tarn.operators.components import components
from tarn.queries import QUERIES, SQL
from tarn.sources import readers, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v if isinstance(v, int | str | bool | None) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = duck.execute(SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_components_are_those_of_union_find(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 8), (8, 9), (9, 7), (10, 10), (3, 11), (20, 19), (19, 18), (18, 17), (17, 16)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 11: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, **{k: 16 for k in range(16, 21)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_admission_is_greedy(spark):
    rows, pairs = [(k,) for k in range(6)], [(0, 1), (1, 2), (2, 3), (4, 5)]
    got = match.admitted(spark.createDataFrame(rows, "id long"), spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r["id"] for r in got.collect()) == [0, 2, 4]


def test_nearest_by_cells_equals_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(k, 25 + k * 7 % 24 + 0.1, -124 + k * 13 % 57 + 0.2) for k in range(40)], "id long, lat double, lng double")
    plants = spark.createDataFrame([(k, 25 + k * 5 % 24 + 0.3, -124 + k * 11 % 57 + 0.7) for k in range(15)], "id long, lat double, lng double")
    want = sorted(nearest.with_nearest(rows, plants).collect())
    monkeypatch.setattr(nearest, "BROADCAST_ROWS", 3)
    assert sorted(nearest.with_nearest(rows, plants).collect()) == want


def test_names_of_one_letter_are_found_inside_others(spark):
    deals = spark.createDataFrame([(1, "x y", "a", None), (2, "x y", "bab", None), (3, "x y", "zzz", None)], "id long, target_key string, acquirer_key string, date date")
    assert match.deal_pairs(deals).collect() == [(1, 2)]


def test_validation_and_synthesis(spark):
    deals = spark.createDataFrame([(1, "2026-01-01", "T", "A", "Merger", "X, OH", "$1", "", None, None), (2, "", "T", "A", None, "", "N/A", "", " noted ", ["b1", "b2"])], "id long, date string, target string, acquirer string, deal_type string, location string, deal_size string, sponsor string, notes string, deal_summary array<string>")
    assert [r["reason"] for r in ingest.validated_deals(deals).orderBy("id").collect()] == [None, "missing"]
    made = ingest.synthesized(deals).orderBy("id").collect()
    assert [(r["headline"], r["summary"]) for r in made] == [("A Merges With T", "Location: X, OH. Type: Merger. Size: $1"), ("A Acquires T", "b1 b2")]


def test_digest_mode():
    assert [ingest.digest_mode(*a) for a in ((0, 0, 0, 0), (4, 2, 1, 0), (5, 2, 0, 0), (3, 1, 1, 1))] == ["quiet", "maintenance", "digest", "maintenance"]


def test_splice_and_state(spark):
    page = spark.createDataFrame([("<!-- A_START -->x\n<!--A_END -->t",), ("none",)], "h string")
    assert [r[0] for r in page.select(sinks.spliced(F.col("h"), "A", "$1\\")).collect()] == ["<!-- A_START -->$1\\<!--A_END -->t", "none"]
    state = spark.range(1).select(sinks.read_state(sinks.screener_state(F.create_map(F.lit("a"), F.lit(0.5)), F.lit("s"), F.lit(None).cast("map<string,map<string,int>>"))).alias("s")).first()["s"]
    assert state["weights"] == {"a": 0.5} and state["strategy"] == "s"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,zip\n1,\xe9\nx,2\n".encode("latin-1"))
    assert readers.wide_csv(spark, str(tmp_path / "a.csv"), ["zip"]).collect() == [("é",), ("2",)]
    assert readers.typed_csv(spark, str(tmp_path / "a.csv"), {"id": "int"}).collect() == [(1,)]
    assert readers.optional_json(spark, str(tmp_path / "no.json"), "a int").count() == 0
    m = readers.matrix(spark.createDataFrame([('[["ESTAB","zip"],["3","501"]]',)], "value string"))
    assert sorted(m.collect()) == [(0, "ESTAB", "3"), (0, "zip", "501")]


def test_feed_stream_equals_one_batch(spark, tmp_path):
    from tarn.streaming import feed

    rows = [(1, "Acme buys Bravo", "u/1", "2026-01-01"), (2, "Acme buys Bravo", "u/2", "2026-01-02"), (3, "City adopts ordinance today", "u/3", "2026-01-02")]
    schema = "id long, headline string, url string, date string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], schema)
    q = feed.run_feed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "feed"), empty, str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "feed")).collect())
    assert got == sorted(r["id"] for r in ingest.merged_batch(spark.createDataFrame(rows, schema), empty, empty).collect()) == [1, 3]


def test_normalisers_are_idempotent(spark):
    once = spark.createDataFrame([("The Acme Co. of Q3 2025!",), (None,)], "h string").select(text.normalized_headline("h").alias("h"))
    assert once.collect() == once.select(text.normalized_headline("h").alias("h")).collect()
