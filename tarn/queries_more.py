"""More queries of the analytics operators: verification, audit, operators, files together, page text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import dates, geo, text
from tarn.operators import audit, curation, facilities, geocode, verification, views
from tarn.operators.order import placed
from tarn.plans import packs
from tarn.queries import AS_OF, BOX_SQL, CITY_SQL, CLUSTER_SQL, DEAL_SQL, FACILITY_SQL, MILES_SQL, NEWS_SQL, PLANT_SQL, SCORE_SQL, query, t, v_box, v_city, v_deal, v_facility, v_news, v_plant

NAMES, BRANDS = ("7$",), ("BUILDING",)
HIT_SQL = "regexp_matches(c_name, '(?i)7$')"


# operators ------------------------------------------------------------------------------------------------------------
def _named(spark, d):
    f = v_facility(spark, d)
    words = F.concat(F.lit("Acme "), F.element_at(F.array(*[F.lit(w) for w in ("Grease", "Septic", "Pumping", "")]), (F.col("id") % 4 + 1).cast("int")), F.lit(" Works LLC"))
    return f.select("id", F.when(F.col("id") % 11 == 0, F.lit("LLC")).otherwise(words).alias("n"), F.when(F.col("id") % 13 == 0, F.lit(0.0)).otherwise(F.col("lat")).alias("lat"), "lng")


KEYED_SQL = f"SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE 'acme ' || ['grease ', 'septic ', 'pumping ', ''][id % 4 + 1] || 'works' END AS k, CASE WHEN id % 13 = 0 THEN 0 ELSE lat END AS lat, lng FROM ({FACILITY_SQL})"


@query("operator_known", f"WITH f AS MATERIALIZED ({KEYED_SQL}), a AS (SELECT * FROM f WHERE id % 2 = 0), b AS (SELECT * FROM f WHERE id % 2 = 1 AND k <> '') SELECT a.id, a.lat = 0 OR a.k = '' OR EXISTS (SELECT 1 FROM b WHERE {MILES_SQL.format(a='a', b='b')} <= 25 AND len(list_intersect(string_split(a.k, ' '), string_split(b.k, ' '))) / len(list_distinct(list_concat(string_split(a.k, ' '), string_split(b.k, ' '))))::DOUBLE >= 0.7) AS known FROM a")
def operator_known(spark, d):
    both = _named(spark, d)
    return curation.known_operators(both.where("id % 2 = 0"), both.where("id % 2 = 1"), miles=25)


@query("operator_coerce", "SELECT c_custkey AS id, c_name AS n, CASE WHEN c_custkey % 3 = 0 THEN 'Reno' ELSE 'Elko' END AS c, 'NV' AS s, round(c_acctbal, 5) AS la FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def operator_coerce(spark, d):
    k = F.col("c_custkey")
    raw = t(spark, d, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("name"), F.lit(" ").alias("address"), F.when(k % 3 == 0, "").otherwise("Elko").alias("city"), F.lit(None).cast("string").alias("state"),
        F.when(k % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("latitude"), F.lit("-119.8").alias("longitude"), F.lit("").alias("services"), F.lit(None).cast("string").alias("size"), F.lit("Reno, NV").alias("metro"),
    )
    return curation.coerced_operators(raw).select("id", "n", "c", "s", "la")


@query("operator_short_record", "SELECT c_custkey AS id, '{\"i\":\"' || c_custkey || '\",\"n\":\"' || c_name || '\"' || CASE WHEN c_custkey % 2 = 0 THEN ',\"z\":\"' || c_nationkey || '\"' ELSE '' END || '}' AS record FROM customer")
def operator_short_record(spark, d):
    c = t(spark, d, "customer")
    columns = {"i": F.col("c_custkey").cast("string"), "n": text.text("c_name"), "z": F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(F.lit(None))}
    return c.select(F.col("c_custkey").alias("id"), curation.short_record(columns, ("z",)).alias("record"))


@query("url_dead", "SELECT DISTINCT url FROM pages WHERE page_id % 6 IN (0, 1, 3)")
def url_dead(spark, d):
    pages = t(spark, d, "pages").where("url is not null")
    answer = F.element_at(F.array(*[F.lit(x) for x in (404, 410, 200, None, 403)]), (F.col("page_id") % 6 + 1).cast("int"))
    return curation.dead_urls(pages.select(F.col("url").alias("source_url")), pages.where("page_id % 6 < 5").select("url", answer.alias("status")))


MARKERS_SQL = f"SELECT 'plant' AS layer, 0 AS rank, id, lat, lng FROM ({PLANT_SQL}) UNION ALL SELECT 'operator', 1, id, lat, lng FROM ({FACILITY_SQL}) WHERE id % 2 = 1"


@query("marker_nearest", f"SELECT id, layer, marker, round(mi, 4) AS miles FROM (SELECT a.id, b.layer, b.id AS marker, {MILES_SQL.format(a='a', b='b')} AS mi, row_number() OVER (PARTITION BY a.id ORDER BY {MILES_SQL.format(a='a', b='b')}, b.rank, b.id) AS r FROM ({FACILITY_SQL}) a JOIN ({MARKERS_SQL}) b ON {MILES_SQL.format(a='a', b='b')} < 40 WHERE a.id % 2 = 0 AND a.id % 3 <> 0) WHERE r = 1")
def marker_nearest(spark, d):
    f = v_facility(spark, d)
    rows = f.where("id % 2 = 0").select("id", "lat", "lng", F.when(F.col("id") % 3 == 0, "wide").otherwise("narrow").alias("zoom"))
    return curation.nearest_marker(rows, [("plant", v_plant(spark, d)), ("operator", f.where("id % 2 = 1"))], 40).withColumn("miles", F.round("miles", 4))


@query("marker_of_hit", f"SELECT f.id, p.id AS marker FROM ({PLANT_SQL}) f JOIN ({PLANT_SQL}) p USING (name, lat, lng)")
def marker_of_hit(spark, d):
    """A search hit finds its marker by name and coordinates, as it has no id of its own."""
    p = v_plant(spark, d)
    return p.join(p.select(F.col("id").alias("marker"), "name", "lat", "lng"), ["name", "lat", "lng"]).select("id", "marker")


# verification -----------------------------------------------------------------------------------------------------------
def _records(spark, d):
    c = F.col("c_custkey")
    return t(spark, d, "customer").select(c.alias("id"), F.when(c % 9 == 0, "MUN").when(c % 9 == 1, "PE").when(c % 9 == 2, "LOC").otherwise("XX").alias("bucket"), F.col("c_name").alias("n"), F.lit(None).cast("string").alias("op"), F.col("c_mktsegment").alias("ot"))


PRE_SQL = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'auto: MUN bucket (municipal WWTP)' WHEN {HIT_SQL} THEN 'auto: facility name matches wastewater/septic pattern' WHEN c_mktsegment = 'BUILDING' THEN 'auto: operator matches known FOG brand' END AS reason FROM customer"


@query("verify_pre_classify", f"SELECT id, 'CONFIRMED_FOG' AS classification, reason FROM ({PRE_SQL}) WHERE reason IS NOT NULL")
def verify_pre_classify(spark, d):
    return verification.pre_classified(_records(spark, d), NAMES, BRANDS)


def _results(spark, d):
    c = F.col("c_custkey")
    verdicts = t(spark, d, "customer").where("c_custkey % 4 < 3").select(c.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("at"))
    verdicts = verdicts.select(F.col("k").cast("string").alias("id"), F.when(F.col("at") == 0, "NOT_FOG").when(F.col("k") % 4 == 0, "CONFIRMED_FOG").when(F.col("k") % 4 == 1, "NOT_FOG").otherwise("maybe").alias("classification"), F.concat(F.lit("said "), F.col("at").cast("string")).alias("reason"), "at")
    rows = t(spark, d, "customer").select(c.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("operator"), F.when(c % 2 == 0, "A").otherwise("B").alias("tier"), F.col("c_nationkey").cast("string").alias("state"))
    return verification.with_verdicts(rows, verdicts, F.col("operator") == "MACHINERY")


RESULT_SQL = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS operator, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS tier, c_nationkey::VARCHAR AS state, CASE WHEN c_custkey % 4 >= 2 THEN 'UNCLEAR' WHEN c_custkey % 4 = 0 THEN 'CONFIRMED_FOG' WHEN c_mktsegment = 'MACHINERY' THEN 'UNCLEAR' ELSE 'NOT_FOG' END AS classification, CASE WHEN c_custkey % 4 >= 2 THEN 'no verdict returned' WHEN c_custkey % 4 = 1 AND c_mktsegment = 'MACHINERY' THEN 'DEMOTED: said 1' ELSE 'said 1' END AS reason FROM customer"


@query("verify_merge_last", f"SELECT id, classification, reason FROM ({RESULT_SQL})")
def verify_merge_last(spark, d):
    return _results(spark, d).select("id", "classification", "reason")


PROMOTED_SQL = f"SELECT id, CASE WHEN classification <> 'CONFIRMED_FOG' AND (regexp_matches(name, '7$') OR operator = 'BUILDING') THEN 'CONFIRMED_FOG' ELSE classification END AS classification, CASE WHEN classification = 'CONFIRMED_FOG' THEN reason WHEN regexp_matches(name, '7$') THEN 'auto: facility name matches FOG pattern (postprocess override)' WHEN operator = 'BUILDING' THEN 'auto: operator matches known FOG brand (postprocess override)' ELSE reason END AS reason FROM ({RESULT_SQL})"


@query("verify_promote", PROMOTED_SQL)
def verify_promote(spark, d):
    return verification.promoted(_results(spark, d), NAMES, BRANDS).select("id", "classification", "reason")


@query("verify_rerun", f"SELECT id, CASE WHEN reason = 'no verdict returned' AND id % 6 = 2 THEN 'NOT_FOG' ELSE classification END AS classification, CASE WHEN reason = 'no verdict returned' AND id % 6 = 2 THEN 'again (re-run)' ELSE reason END AS reason FROM ({PROMOTED_SQL})")
def verify_rerun(spark, d):
    results = verification.promoted(_results(spark, d), NAMES, BRANDS)
    asked = verification.to_rerun(results)
    second = asked.select("id", F.when(F.col("id") % 6 == 2, "NOT_FOG").otherwise("dunno").alias("classification"), F.lit("again").alias("reason"), F.lit(1).alias("at"))
    return verification.rerun(results, second).select("id", "classification", "reason")


@query("verify_class_changes", f"SELECT classification, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, sum(a - b)::BIGINT AS delta FROM (SELECT classification, 1 AS b, 0 AS a FROM ({RESULT_SQL}) UNION ALL SELECT classification, 0, 1 FROM ({PROMOTED_SQL})) GROUP BY 1")
def verify_class_changes(spark, d):
    before = _results(spark, d)
    return verification.class_changes(before, verification.promoted(before, NAMES, BRANDS))


@query("verify_refuted_top", f"SELECT id, tier, state, name FROM ({RESULT_SQL}) WHERE classification = 'NOT_FOG' ORDER BY tier, state, name, id LIMIT 20")
def verify_refuted_top(spark, d):
    return verification.refuted(_results(spark, d)).select("id", "tier", "state", "name")


@query("verify_tier_labels", "SELECT CASE c_custkey % 9 WHEN 1 THEN 'PE-Backed (Other)' WHEN 2 THEN 'Local / Family' ELSE 'Other' END AS tier, count(*) AS n FROM customer GROUP BY 1")
def verify_tier_labels(spark, d):
    return _records(spark, d).groupBy(verification.tier_label(F.col("bucket")).alias("tier")).agg(F.count("*").alias("n"))


@query("verify_question_lines", "SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' (operator: ' || c_mktsegment || ')' END || ' - , ' || c_nationkey AS line FROM customer")
def verify_question_lines(spark, d):
    operator = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_mktsegment"))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), verification.asked_line(F.col("c_name"), F.lit(""), F.col("c_nationkey").cast("string"), operator).alias("line"))


@query("verify_batches_whole", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 15 AS batch FROM (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def verify_batches_whole(spark, d):
    """All that is still to be asked about, in batches of 15 by id: places within ranges of ids, then sums over ranges."""
    left = t(spark, d, "documents").select(F.col("doc_id").alias("id")).join(t(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    span = F.floor(F.col("id") / 65536)
    ranges = left.groupBy(span.alias("span")).agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = left.withColumn("span", span).withColumn("r", F.row_number().over(Window.partitionBy("span").orderBy("id")))
    return placed.join(ranges.select("span", earlier.alias("before")), "span").select("id", F.floor((F.col("before") + F.col("r") - 1) / 15).alias("batch"))


# views, labels, sums ----------------------------------------------------------------------------------------------------
@query("deal_view_platform", f"SELECT id FROM ({DEAL_SQL}) WHERE acquirer = 'BUILDING' AND date[1:4]::INT < 1997 ORDER BY target DESC, id")
def deal_view_platform(spark, d):
    buyer = F.when(F.col("acquirer") == "BUILDING", "Darling Ingredients").otherwise("Other")
    deals = v_deal(spark, d).withColumns({c: F.lit("") for c in ("sponsor", "location", "services", "notes")}).where(views.platform(buyer, F.lit("")) == "Darling")
    return views.deals_view(deals.where("substring(date, 1, 4) < '1997'"), sort="target").select("id")


@query("deal_export", f"SELECT id || ',' || target || ',' || acquirer || ',' || CASE WHEN contains(deal_type, ',') THEN '\"' || deal_type || '\"' ELSE deal_type END || ',' || date AS line FROM ({DEAL_SQL}) WHERE date[1:4] = '1998'")
def deal_export(spark, d):
    """The lines of the export of a filtered view, cell by cell; sinks.csv_export writes them as files."""
    deals = v_deal(spark, d).withColumns({c: F.lit("") for c in ("sponsor", "location", "services", "notes")})
    shown = views.deals_view(deals, year="1998")
    return shown.select(F.concat_ws(",", *[views.csv_cell(F.col(c)) for c in ("id", "target", "acquirer", "deal_type", "date")]).alias("line"))


@query("screener_edited", f"SELECT id, s AS score FROM (SELECT id, {SCORE_SQL.replace('growth *', '(CASE WHEN id % 2 = 0 THEN 5 ELSE growth END) *')} AS s FROM ({CITY_SQL}))")
def screener_edited(spark, d):
    """Scores edited for a city override its own."""
    city = v_city(spark, d)
    edits = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("growth"), F.lit(5)))
    scores = {c: F.coalesce(edits[c], F.col(c)) for c in packs.CRITERIA}
    return city.select("id", views.weighted_score(scores, packs.WEIGHTS["collections"]).alias("score"))


@query("screener_weight_sums", " UNION ALL ".join(f"SELECT '{k}' AS profile, {round(sum(w), 9)}::DOUBLE AS total, {str(abs(sum(w) - 1) <= 0.001).lower()} AS fine" for k, w in packs.WEIGHTS.items()))
def screener_weight_sums(spark, d):
    rows = spark.createDataFrame([(k, list(w)) for k, w in packs.WEIGHTS.items()], "profile string, weights array<double>")
    total = F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 9)
    return rows.select("profile", total.alias("total"), (F.abs(total - 1) <= 0.001).alias("fine"))


@query("heat_scale", "SELECT c_nationkey AS id, round(ln(1.0 + n) / ln(1.0 + max(n) OVER ()), 6) AS heat FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def heat_scale(spark, d):
    counts = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("most")))).select("id", F.round(geo.heat(F.col("n")) / geo.heat(F.col("most")), 6).alias("heat"))


@query("public_breakdown", "SELECT coalesce(label, 'TOTAL') AS label, count(*) AS n FROM (SELECT 'Public: ' || p_brand AS label FROM part WHERE p_size % 3 = 0) GROUP BY ROLLUP (label)")
def public_breakdown(spark, d):
    label = F.concat(F.when(F.col("p_size") % 3 == 0, "Public: ").otherwise("Local: "), F.col("p_brand"))
    return curation.prefixed_labels(t(spark, d, "part").select(label.alias("ot")), "ot")


# files together, digest, page text ---------------------------------------------------------------------------------------
@query("news_files_dedupe", CLUSTER_SQL + f" SELECT id, CASE WHEN id % 3 = 0 THEN 'archive' ELSE 'feed' END AS file, CASE WHEN id % 5 = 0 THEN '2024-01-01' ELSE date END AS first_seen_date FROM (SELECT id, date, row_number() OVER (PARTITION BY cluster ORDER BY length(headline) DESC, (CASE WHEN id % 3 = 0 THEN 'archive' ELSE 'feed' END) DESC, id) AS r FROM c JOIN (SELECT id, headline, date FROM ({NEWS_SQL})) USING (id)) WHERE r = 1")
def news_files_dedupe(spark, d):
    news = v_news(spark, d).select("id", "headline", F.lit("").alias("url"), "date", F.when(F.col("id") % 5 == 0, "2024-01-01").otherwise("").alias("first_seen_date"))
    return curation.deduplicated_files(news.where("id % 3 != 0"), news.where("id % 3 = 0"), F.length("headline")).select("id", "file", "first_seen_date")


@query("digest_subject", "SELECT n_nationkey AS id, 'Industry Briefing — 2025-02-03' || CASE WHEN n_nationkey % 3 = 1 THEN ' (1 New Deal)' WHEN n_nationkey % 3 = 2 THEN ' (2 New Deals)' WHEN n_nationkey % 2 = 1 THEN '' WHEN n_nationkey % 4 = 0 THEN ' (Quiet Day)' ELSE ' (Recent Updates)' END AS subject FROM nation")
def digest_subject(spark, d):
    n = F.col("n_nationkey")
    return t(spark, d, "nation").select(n.alias("id"), curation.subject(AS_OF, n % 3, n % 2, n % 4).alias("subject"))


@query("run_delta", f"SELECT count(*) FILTER (id % 3 = 0 AND id % 2 <> 0) AS added, count(*) FILTER (id % 2 = 0 AND id % 3 <> 0) AS gone, count(*) FILTER (id % 6 = 0) AS kept FROM ({NEWS_SQL})")
def run_delta(spark, d):
    news = v_news(spark, d).select("id")
    return curation.run_delta(news.where("id % 2 = 0"), news.where("id % 3 = 0"))


@query("html_text_patches", "SELECT page_id, replace(coalesce(html, ''), 'TBD', '') AS html, (length(coalesce(html, '')) - length(replace(coalesce(html, ''), 'the', ''))) // 3 AS n, rpad(substr(coalesce(url, ''), 1, 24), 24, ' ') AS url FROM pages")
def html_text_patches(spark, d):
    page = F.concat(F.lit(" console.log('start', 1);\n"), F.replace(F.coalesce("html", F.lit("")), F.lit("TBD"), F.lit("")))
    clean = F.replace(curation.without_console_log(page), F.lit("\n"), F.lit("\n"))
    return t(spark, d, "pages").select("page_id", F.substr(clean, F.lit(2)).alias("html"), curation.occurrences(F.col("html"), "the").alias("n"), curation.padded(F.col("url"), 24).alias("url"))


@query("html_splice_block", "SELECT page_id, 'a /* S */' || chr(10) || 'const D = [' || page_id || '];' || chr(10) || '/* E */ b /* S */ c /* E */' AS page FROM pages")
def html_splice_block(spark, d):
    page = F.lit("a /* S */ old $1 \\ /* E */ b /* S */ c /* E */")
    inner = F.concat(F.lit("const D = ["), F.col("page_id").cast("string"), F.lit("];"))
    return t(spark, d, "pages").select("page_id", curation.spliced_block(page, "/* S */", "/* E */", inner).alias("page"))


@query("geocode_city_fallback", "SELECT n_nationkey AS id, 30.0::DOUBLE + n_nationkey AS lat FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 3 = 2")
def geocode_city_fallback(spark, d):
    n = F.col("n_nationkey")
    name = F.concat(F.lit("town"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))
    said = F.when(n % 3 == 0, F.concat(F.upper(name), F.lit(", OH"))).when(n % 3 == 1, F.concat(F.lit("Suburban "), name, F.lit(", OH (north)"))).otherwise(name)
    places = t(spark, d, "nation").select(F.concat(name, F.lit(", oh")).alias("place"), (n + 30.0).alias("lat"), F.lit(-90.0).alias("lng"))
    return geocode.by_city(t(spark, d, "nation").select(n.alias("id"), said.alias("location")), places).select("id", "lat")


# audit ------------------------------------------------------------------------------------------------------------------
def _ok(n: int, bad: str, source: str) -> str:
    return f"SELECT {n} AS check_id, n = 0 AS passed, n AS n_bad FROM (SELECT count(*) FILTER ({bad}) AS n FROM ({source}))"


AUDIT_SQL = " UNION ALL ".join([
    _ok(1, "date > '2025-01-30'", NEWS_SQL), _ok(2, "regexp_matches(headline || chr(10) || summary, '(?i)</?[a-z][^>]*>')", NEWS_SQL),
    f"SELECT 3, n = 0, n FROM (SELECT (count(*) - count(DISTINCT lower(trim(headline))))::BIGINT AS n FROM ({NEWS_SQL}) WHERE trim(headline) <> '')",
    f"SELECT 4, n = 0, n FROM (SELECT (count(*) - count(DISTINCT target || chr(1) || acquirer))::BIGINT AS n FROM ({DEAL_SQL}))", _ok(5, "date > '1998-01-01'", DEAL_SQL),
    _ok(6, "NOT (lat BETWEEN south - 0.5 AND north + 0.5 AND lng BETWEEN west - 0.5 AND east + 0.5)", f"SELECT * FROM ({FACILITY_SQL}) JOIN ({BOX_SQL}) USING (s)"),
    "SELECT 7, true, count(DISTINCT p_type)::BIGINT FROM part", _ok(8, "id % 7 = 0 OR id % 11 = 0", DEAL_SQL), _ok(9, "url IS NULL OR NOT starts_with(url, 'http')", "SELECT * FROM pages"),
    "SELECT 10, n >= 52, greatest(52 - n, 0) FROM (SELECT count(*) AS n FROM nation)",
    "SELECT 11, n = 0, n FROM (SELECT " + str(sum(abs(sum(w) - 1) > 0.001 for w in packs.WEIGHTS.values())) + "::BIGINT AS n)",
    "SELECT 12, n = 0, n FROM (SELECT sum((length(h) - length(replace(h, 'TBD', ''))) // 3)::BIGINT AS n FROM (SELECT coalesce(html, '') AS h FROM pages))",
    "SELECT 13, n = 0, n FROM (SELECT sum((length(h) - length(replace(h, 'console.log', ''))) // 11)::BIGINT AS n FROM (SELECT coalesce(html, '') AS h FROM pages))",
    "SELECT 14, n = 21, abs(n - 21) FROM (SELECT count(*) AS n FROM part WHERE p_type = 'SMALL')", "SELECT 15, n = 36, abs(n - 36) FROM (SELECT count(*) AS n FROM part WHERE p_type = 'PROMO')",
    "SELECT 16, n = 1000, abs(n - 1000) FROM (SELECT count(*) AS n FROM documents)", "SELECT 17, n = 1000, abs(n - 1000) FROM (SELECT count(*) AS n FROM orders)",
])


@query("audit_report_whole", AUDIT_SQL)
def audit_report_whole(spark, d):
    """All 17 checks; what one table answers is one pass over it, duplicates apart."""
    news, pages, deals, parts = v_news(spark, d), t(spark, d, "pages"), v_deal(spark, d), t(spark, d, "part")
    boxed = v_facility(spark, d).join(F.broadcast(v_box(spark, d)), "s")
    inside = geo.in_box(F.col("lat"), F.col("lng"), *[F.col(c) for c in ("south", "north", "west", "east")])
    h, long = F.coalesce("html", F.lit("")), lambda c: F.coalesce(c, F.lit(0)).cast("long")
    off = lambda c, want: F.abs(F.count_if(c) - want)
    wrong = sum(abs(sum(w) - 1) > 0.001 for w in packs.WEIGHTS.values())
    return audit.report(
        audit.several(news, {1: F.count_if(F.col("date") > "2025-01-30"), 2: F.count_if(text.bad_text_reason("headline", "summary") == "tag"), 16: F.abs(F.count("*") - 1000)}),
        audit.duplicates(3, news, F.lower(F.trim("headline"))), audit.duplicates(4, deals, F.col("target"), F.col("acquirer")),
        audit.several(deals, {5: F.count_if(F.col("date") > "1998-01-01"), 8: F.count_if(~geo.plausible(F.when(F.col("id") % 7 != 0, F.lit(40.0)), F.when(F.col("id") % 11 != 0, F.lit(-90.0)).otherwise(0.0)))}),
        audit.several(boxed, {6: F.count_if(~inside)}), audit.several(parts, {7: F.count_distinct("p_type"), 14: off(F.col("p_type") == "SMALL", 21), 15: off(F.col("p_type") == "PROMO", 36)}, never=(7,)),
        audit.several(pages, {9: F.count_if(F.col("url").isNull() | ~F.col("url").startswith("http")), 12: long(F.sum(curation.occurrences(h, "TBD"))), 13: long(F.sum(curation.occurrences(h, "console.log")))}),
        audit.several(t(spark, d, "nation"), {10: F.greatest(52 - F.count("*"), F.lit(0)), 11: F.max(F.lit(wrong))}), audit.several(t(spark, d, "orders"), {17: F.abs(F.count("*") - 1000)}),
    )


# samples, orders and audits by content -----------------------------------------------------------------------------------
@query("verify_sample_shortfall", "WITH q(tier, quota) AS (VALUES ('en', 75), ('it', 9), ('zz', 5), ('es', 1000000)), n AS (SELECT lang AS tier, count(*) AS n FROM documents GROUP BY lang) SELECT tier, quota::BIGINT AS quota, least(quota, coalesce(n, 0))::BIGINT AS taken, (quota - least(quota, coalesce(n, 0)))::BIGINT AS missing FROM q LEFT JOIN n USING (tier)")
def verify_sample_shortfall(spark, d):
    """A million of one language are more than there are, and one language there is none of."""
    quotas = {"en": 75, "it": 9, "zz": 5, "es": 1_000_000}
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tier"))
    return facilities.shortfall(facilities.stratified(rows, quotas), quotas)


SORTS = (("rank", None), ("rank", False), ("name", None), ("name", True), ("region", None), ("status", None), ("status", False), *((c, None) for c in packs.CRITERIA))


@query("screener_orders", " UNION ALL ".join(f"SELECT '{key}' AS sort_key, {str(up).lower()} AS up, id, row_number() OVER (ORDER BY {'s' if key == 'rank' else f'lower({key})' if key in ('name', 'region', 'status') else key} {'ASC' if up else 'DESC'}, id)::INT AS rank FROM (SELECT *, {SCORE_SQL} AS s FROM ({CITY_SQL}))" for key, up in ((k, (k in ('name', 'region')) if down is None else not down) for k, down in SORTS)))
def screener_orders(spark, d):
    """The place of each city in every order a table's heads offer."""
    out, cities = None, v_city(spark, d)
    for key, down in SORTS:
        up = key in ("name", "region") if down is None else not down
        own = views.screener(cities, packs.WEIGHTS["collections"], key=key, descending=down).select(F.lit(key).alias("sort_key"), F.lit(up).alias("up"), "id", "rank")
        out = own if out is None else out.unionByName(own)
    return out


@query("order_places", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY lower(o_orderpriority), o_totalprice DESC, o_orderkey) AS place FROM orders")
def order_places(spark, d):
    """A whole order whose first column has five values."""
    return placed(t(spark, d, "orders"), F.lower("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey", name="place").select(F.col("o_orderkey").alias("id"), "place")


def _weights(spark, d):
    parts = t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    whole = parts.groupBy("p_type").agg(F.sum("n").alias("whole"))
    share = F.col("n") / F.col("whole") * F.when(F.col("p_type") == "PROMO", 0.5).otherwise(1.0)
    return parts.join(whole, "p_type").select(F.col("p_type").alias("profile"), F.col("p_brand").alias("criterion"), share.alias("weight"))


WEIGHTS_SQL = "SELECT p_type AS profile, p_brand AS criterion, n / whole * CASE WHEN p_type = 'PROMO' THEN 0.5 ELSE 1 END AS weight FROM (SELECT p_type, p_brand, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY p_type)::DOUBLE AS whole FROM part GROUP BY 1, 2)"


@query("screener_weight_totals", f"SELECT profile, round(sum(weight), 9) AS total, abs(sum(weight) - 1) <= 0.001 AS fine FROM ({WEIGHTS_SQL}) GROUP BY profile")
def screener_weight_totals(spark, d):
    """Weights of a table: the shares of a type's brands, halved for one type."""
    return audit.weights_sum(_weights(spark, d))


@query("audit_counts", "SELECT 7 AS check_id, 'p_type' AS field, coalesce(p_type, '?') AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 7, 'o_orderstatus', coalesce(o_orderstatus, '?'), count(*) FROM orders GROUP BY ALL")
def audit_counts(spark, d):
    return audit.counts_by(7, t(spark, d, "part"), "p_type").unionByName(audit.counts_by(7, t(spark, d, "orders"), "o_orderstatus"))


META_SQL = "SELECT 'newsCount' AS field, count(DISTINCT doc_id) AS value FROM documents UNION ALL SELECT 'compCount', count(*) + 1 FROM orders"


@query("audit_content", f"SELECT 10 AS check_id, n = 0 AS passed, n AS n_bad FROM (SELECT (count(*) FILTER (doc_id IS NULL OR quality IS NULL OR toxic IS NULL) + greatest(52 - count(*), 0))::BIGINT AS n FROM (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))) UNION ALL SELECT 11, n = 0, n FROM (SELECT count(*) FILTER (abs(w - 1) > 0.001) AS n FROM (SELECT sum(weight) AS w FROM ({WEIGHTS_SQL}) GROUP BY profile)) UNION ALL SELECT k, n = 0, n FROM (SELECT 16 AS k, abs((SELECT count(*) FROM documents) - (SELECT max(value) FROM ({META_SQL}) WHERE field = 'newsCount'))::BIGINT AS n UNION ALL SELECT 17, abs((SELECT count(*) FROM orders) - (SELECT max(value) FROM ({META_SQL}) WHERE field = 'compCount'))::BIGINT)")
def audit_content(spark, d):
    """Checks 10, 11, 16 and 17 by what tables say: scores of every row, weights, and counts that metadata holds."""
    docs, orders = t(spark, d, "documents"), t(spark, d, "orders")
    scored = docs.join(t(spark, d, "labels"), "doc_id", "left")
    meta = docs.agg(F.count_distinct("doc_id").alias("value")).withColumn("field", F.lit("newsCount")).unionByName(orders.agg((F.count("*") + 1).alias("value")).withColumn("field", F.lit("compCount")))
    return audit.report(audit.complete(10, scored, ["doc_id", "quality", "toxic"], 52), audit.weights_fine(11, _weights(spark, d)), audit.counted_as(16, docs, meta, "newsCount"), audit.counted_as(17, orders, meta, "compCount"))


EXPORTED_SQL = f"SELECT *, 'Sponsor, ' || deal_type AS sponsor, deal_size > 100000 AS is_target_market, [target, 'by ' || acquirer, 'a ' || chr(34) || 'deal' || chr(34)] AS deal_summary, target || chr(10) || 'line' AS notes FROM ({DEAL_SQL}) WHERE date[1:4] = '1998'"
CELL_SQL = "CASE WHEN regexp_matches({c}, '[\",\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
EXPORT_CELLS = {"date": "date", "target": "target", "acquirer": "acquirer", "sponsor": "sponsor", "deal_type": "deal_type", "is_target_market": "is_target_market::VARCHAR", "deal_summary": "array_to_string(deal_summary, ' | ')", "notes": "notes"}


@query("deal_export_whole", f"SELECT 0 AS place, '{','.join(views.EXPORT)}' AS line UNION ALL SELECT row_number() OVER (ORDER BY date DESC, id), " + " || ',' || ".join(CELL_SQL.format(c=EXPORT_CELLS[c]) if c in EXPORT_CELLS else "''" for c in views.EXPORT) + f" FROM ({EXPORTED_SQL})")
def deal_export_whole(spark, d):
    """All sixteen columns of a filtered view, in its order, arrays and quotes in cells; sinks.replaced_file makes a file of it."""
    deals = v_deal(spark, d).withColumns({"sponsor": F.concat(F.lit("Sponsor, "), "deal_type"), "is_target_market": F.col("deal_size") > 100000, "deal_summary": F.array("target", F.concat(F.lit("by "), "acquirer"), F.lit('a "deal"')), "notes": F.concat("target", F.lit("\nline"))})
    deals = deals.withColumns({c: F.lit("") for c in ("location", "services")}).drop("deal_size")
    return views.export_lines(views.deals_view(deals, year="1998"), F.desc("date"), F.asc("id"))


@query("deal_dates_shown", f"SELECT id, CASE WHEN id % 10 = 0 THEN 'soon' WHEN id % 10 = 1 THEN '' ELSE strftime(date::DATE, '%b %-d, %Y') END AS shown FROM ({DEAL_SQL})")
def deal_dates_shown(spark, d):
    said = F.when(F.col("id") % 10 == 0, "soon").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("date"))
    return v_deal(spark, d).select("id", dates.shown(said).alias("shown"))
