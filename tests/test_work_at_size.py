"""Steps whose work grows with their input, not with its pairs, held against plain Python."""

import datetime
import random

from pyspark.sql import functions as F

from tarn.operators import geocode, ingest, match, nearest, search
from tarn.operators.components import components


def moved(spark, run):
    """run()'s result, and how many rows its stages shuffled."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = lambda: jvm.java.util.ArrayList()
    total = lambda: sum(s.shuffleWriteRecords() for s in [*_all(store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none()))])
    before = total()
    return run(), total() - before


def _all(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def day(k):
    return datetime.date(2024, 1, 1) + datetime.timedelta(k)


def test_coverage_asks_a_question_once(spark):
    rng = random.Random(4)
    words = ["acme", "best", "north", "river", "oil", "zinc", "blue", "rare1", "rare2", "inc"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 2)))
    deals = [(k, name(), name(), day(rng.randrange(300)) if rng.random() < 0.9 else None) for k in range(150)]
    news = [(k, name(), name(), day(rng.randrange(300)) if rng.random() < 0.9 else None) for k in range(60)]
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"id long, {a} string, {b} string, date date")
    own = lambda s: set(s.split()) - {"inc"}

    def covered(d):
        t, a = own(d[1]), own(d[2])
        near = [own(f"{n[1]} {n[2]}") for n in news if d[3] and n[3] and abs((d[3] - n[3]).days) <= 30]
        return not t or not a or any(t & w and a & w for w in near)

    got = {r["id"] for r in ingest.covered_deals(frame(deals, "target", "acquirer"), frame(news, "headline", "summary")).collect()}
    assert got == {d[0] for d in deals if covered(d)} and 20 < len(got) < 140
    many = [(k, "acme", "north", day(k % 9)) for k in range(3000)]
    out, rows = moved(spark, lambda: ingest.covered_deals(frame(many, "target", "acquirer"), frame(many, "headline", "summary")).count())
    assert out == 3000 and rows < 100_000


def test_many_terms_are_searched_in_one_pass(spark):
    n = search.TERMS + 500
    plants = spark.range(n).selectExpr("id", "concat('Plant ', lpad(id, 6, '0')) AS name")
    terms = spark.range(n).selectExpr("lpad(id, 5, '0') AS term")
    got = {r["term"]: r["id"] for r in search.first_hits_of_all([(plants, "plant")], terms).collect()}
    want = {}
    for k in range(n):
        for i in range(2):
            want.setdefault(f"{k:06d}"[i : i + 5], k)
    assert got == {t: k for t, k in want.items() if int(t) < n}


def test_bulk_search_is_that_of_the_index(spark):
    layers = [(spark.createDataFrame([(k, f"Plant {k} Works") for k in range(30)] + [(99, None), (98, "")], "id long, name string"), "plant"), (spark.createDataFrame([(k, f"Oper {k} works", ("PE", "LOC", None)[k % 3]) for k in range(30)], "id long, name string, bucket string"), "operator")]
    terms = spark.createDataFrame([(x,) for x in ["WORKS", " plant 7 ", "oper 2", "r 29", "7", "9 ", "zz", "zebra", "r 4 w", "", None, "works"]], "term string")
    one = search.first_hits(search.name_index(layers, ("LOC", "PE")), terms)
    assert sorted(search.first_hits_of_all(layers, terms, ("LOC", "PE")).collect()) == sorted(one.collect()) and one.count() >= 6


def test_places_too_many_to_be_sent_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr("tarn.sources.scratch.SENT_ROWS", 2)
    places = spark.range(10).selectExpr("concat('T', id, ', OH') AS place", "double(id) AS lat", "0D AS lng")
    out = geocode.geocoded(spark.range(10).selectExpr("id", "concat('T', id, ', OH') AS location"), places, {"ohio": "OH"})
    assert "BroadcastHashJoin [place" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["lat"] for r in out.collect()} == {k: float(k) for k in range(10)}


def test_near_copies_of_a_headline_are_not_all_paired(spark):
    head = F.concat(F.lit(" ".join(f"word{k}" for k in range(20)) + " "), F.col("id").cast("string"))
    news = ingest.news_keys(spark.range(600).select("id", head.alias("headline"), F.lit("").alias("url"), F.lit("2024-01-01").alias("date")))
    links, rows = moved(spark, lambda: match.news_links(news).collect())
    assert components(spark.createDataFrame(links)).where("component = 0").count() == 600 and rows < 100_000


def test_links_hang_together_as_the_pairs_do(spark):
    rng = random.Random(7)
    words = [f"Word{k}" for k in range(14)]
    news = [(k, " ".join(rng.sample(words, rng.choice((0, 2, 4, 5, 6, 7)))), rng.choice(("", "", "x.org/a", "x.org/b")), f"2024-01-{rng.randrange(1, 28):02d}") for k in range(160)]
    keyed = ingest.news_keys(spark.createDataFrame(news, "id long, headline string, url string, date string"))
    pairs = match.news_pairs(keyed)
    assert sorted(components(match.news_links(keyed)).collect()) == sorted(components(pairs).collect()) and pairs.count() > 40


def test_rows_of_one_place_are_looked_up_once(spark):
    place = ("30 + (id * 7919 % 40) / 10.0D AS lat", "-90 + (id * 31 % 40) / 10.0D AS lng")
    facilities, plants = spark.range(20_000).selectExpr("id", *place), spark.range(40).selectExpr("id", *place)
    out, rows = moved(spark, lambda: nearest.with_nearest(facilities, plants).where("nd = 0 and np = id % 40").count())
    assert out == 20_000 and rows < 45_000
