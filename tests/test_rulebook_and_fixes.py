"""Rulebooks against every pattern tried by itself, and what the reviewer of round 2 found wrong."""

import random
import re

from pyspark.sql import functions as F

from tarn import queries_rules  # noqa: F401
from tarn.operators import curation, facilities, nearest, verification
from tarn.plans import fixed, packs, rules
from tarn.plans.rulebook import Rulebook, needles


def texts(rng, n):
    words = [*queries_rules.PHRASES, *queries_rules.COLLECTOR_PHRASES, *queries_rules.NEWS_PHRASES, "ſeptic blue", "SEPTİC BLUE", "ßeptic", "b \\& p environmental", "brockwells septic"]
    cased = lambda w: rng.choice([w, w.upper(), w.title(), w.replace(" ", "  "), w[1:], "x" + w])
    return [" ".join(cased(rng.choice(words)) for _ in range(rng.randint(0, 3))) for _ in range(n)]


def test_rulebooks_find_what_each_pattern_finds(spark):
    patterns = [*(p for _, a in fixed.NEWS for p in a), *fixed.RENDERING, *fixed.MEAT, *fixed.CONFIRMED_BRANDS, *fixed.CONFIRMED_NAMES, r"x?y+z", r"(?:ab|cd)e", r"[kK]s", "a|bc|"]
    book = Rulebook([*facilities.FAMILY_RULES.rules, *((f"k{n % 7}", p) for n, p in enumerate(patterns))])
    some, find = texts(random.Random(1), 3000), book.finder()
    compiled = [re.compile(p, re.IGNORECASE) for _, p in book.rules]
    for text in some:
        assert find(text) == [n for n, p in enumerate(compiled) if p.search(text)]
    literal = Rulebook([("c", w) for w in fixed.CONSOLIDATORS], literal=True).finder()
    for text in some:
        assert literal(text) == [n for n, w in enumerate(fixed.CONSOLIDATORS) if w in text.lower()]
    assert find(None) == [] and needles(r"\bwind\s+river\b") == ["r"] or "" not in needles(r"\bwind\s+river\b")
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*some[:50], None])], "k int, t string")
    got = {r["k"]: (r["n"], r["kinds"], r["first"]) for r in table.select("k", book.found(F.col("t")).alias("n")).select("k", "n", book.kinds(F.col("n")).alias("kinds"), book.first_kind(F.col("n")).alias("first")).collect()}
    for k, text in enumerate([*some[:50], None]):
        own = find(text)
        assert got[k] == (own, list(dict.fromkeys(book.rules[n][0] for n in own)), book.rules[own[0]][0] if own else None)
    assert book.table(spark).count() == len(book.rules)


def test_labels_with_the_whole_pack(spark):
    some = texts(random.Random(2), 300)
    got = [r["l"] for r in spark.createDataFrame(list(enumerate(some)), "k int, t string").orderBy("k").select(rules.labels(F.col("t"), packs.NEWS).alias("l")).collect()]
    want = [[c for c, a in fixed.NEWS if re.search("|".join(a), text, re.IGNORECASE)] or ["Industry Events"] for text in some]
    assert got == want


def test_the_name_alone_speaks_for_a_facility(spark):
    rows = spark.createDataFrame([("plain landfill", "acme grease", "562991"), ("acme plant", "grease co", ""), ("hill foods", "tallow", "311613")], "n string, op string, na string")
    rows = rows.withColumns({"ot": F.lit(""), "ct": F.lit("")})
    assert [r[0] for r in rows.select(facilities.cascade()).collect()] == ["dropped_negative", "dropped_no_signal", "kept_311613"]


def test_nearest_keeps_repeated_keys_apart(spark):
    rows = spark.createDataFrame([(1, 40.0, -90.0), (1, 40.0, -90.0), (2, 40.0, -90.0), (2, 45.0, -100.0), (None, 40.0, -90.0), (3, None, 1.0)], "id long, lat double, lng double")
    plants = spark.createDataFrame([(7, 40.1, -90.0), (8, 45.3, -100.0)], "id long, lat double, lng double")
    got = sorted(((r["id"], r["lat"], r["np"]) for r in nearest.with_nearest(rows, plants).collect()), key=str)
    assert got == sorted([(1, 40.0, 7), (1, 40.0, 7), (2, 40.0, 7), (2, 45.0, 8), (None, 40.0, 7), (3, None, None)], key=str)


def test_short_records_hold_required_empties(spark):
    row = spark.createDataFrame([(None, "x", None, None, 1.5)], "i string, n string, z string, nd double, la double")
    columns = {c: F.col(c) for c in row.columns}
    assert row.select(curation.short_record(columns, ("z",))).first()[0] == '{"i":"","n":"x","la":1.5}'


def test_the_last_verdict_of_a_second_round_counts(spark):
    rows = spark.createDataFrame([(k, "UNCLEAR", "no verdict returned") for k in (1, 2, 3)], "id long, classification string, reason string")
    said = [("1", "UNCLEAR", "a", 1), ("1", "CONFIRMED_FOG", "b", 2), ("2", "CONFIRMED_FOG", "a", 1), ("2", "dunno", "b", 2)]
    got = verification.rerun(rows, spark.createDataFrame(said, "id string, classification string, reason string, at int")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "CONFIRMED_FOG", "b (re-run)"), (2, "UNCLEAR", "no verdict returned"), (3, "UNCLEAR", "no verdict returned")]


def test_files_may_share_ids(spark):
    schema = "id long, headline string, url string, date string, first_seen_date string"
    feed = spark.createDataFrame([(1, "Acme buys Bravo Rendering", "", "2026-01-01", "")], schema)
    archive = spark.createDataFrame([(1, "City adopts new ordinance", "", None, None), (2, "Acme buys Bravo Rendering", "", "2026-01-02", "2026-01-09")], schema)
    got = curation.deduplicated_files(feed, archive, F.length("headline")).orderBy("file", "id").collect()
    assert [(r["file"], r["id"], r["first_seen_date"]) for r in got] == [("archive", 1, "2000-01-01"), ("feed", 1, "2026-01-01")]
