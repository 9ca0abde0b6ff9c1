"""The queries of the analytics operators on the driver tables, each with its DuckDB SQL where there is one.

The tables stand in for the domain's: documents for news, orders for deals, customers and suppliers for facilities and
plants, nations for boxes and cities. Adapters use integer arithmetic, the same in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import dates, geo, text
from tarn.operators import audit, facilities, geocode, ingest, match, nearest, views
from tarn.plans import packs, rules
from tarn.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2025-02-03"
# what the synthetic prose has words for
TEST_PATTERNS = (("M&A", r"\bof\b"), ("Regulatory", r"\bdes?\b"), ("Technology", r"\b(der|die)\b"), ("ESG", r"\bque\b"), ("Restaurant", r"\bwith\b"))
TEST_PACK = packs.FacilityPack(brands=("brand#1",), brand_codes=("ECONOMY",), treatment_works=("part_1 ",), municipal_starts=("part_2",), municipal_parts=("9",), negative=("3", "4"), positive=("5",), rendering="6", meat="7", renderer_brands="8")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def v_news(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("headline"), F.coalesce("text", F.lit("")).alias("summary"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd").alias("date"), "source", "lang")


NEWS_SQL = "SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS headline, coalesce(text, '') AS summary, strftime(DATE '2024-01-01' + (doc_id % 400)::INT, '%Y-%m-%d') AS date, source, lang FROM documents"


def v_deal(spark: SparkSession, d: str) -> DataFrame:
    parts = t(spark, d, "part")
    o = t(spark, d, "orders").crossJoin(F.broadcast(parts.agg(F.count("*").alias("np"))))  # one row
    o = o.withColumn("p_partkey", F.col("o_orderkey") % F.col("np"))
    return o.join(parts, "p_partkey").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("p_name").alias("target"), F.col("c_mktsegment").alias("acquirer"), F.col("o_orderpriority").alias("deal_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("deal_size"))


DEAL_SQL = "SELECT o_orderkey AS id, p_name AS target, c_mktsegment AS acquirer, o_orderpriority AS deal_type, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS deal_size FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) JOIN customer ON o_custkey = c_custkey"


def v_facility(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("s"), F.expr("25 + (c_custkey * 7919 % 24000) / 1000.0D").alias("lat"), F.expr("-124 + (c_custkey * 104729 % 57000) / 1000.0D").alias("lng"))


def v_plant(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("s"), F.expr("25 + (s_suppkey * 15485863 % 24000) / 1000.0D").alias("lat"), F.expr("-124 + (s_suppkey * 32452843 % 57000) / 1000.0D").alias("lng"))


FACILITY_SQL = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS s, 25 + (c_custkey * 7919 % 24000) / 1000.0::DOUBLE AS lat, -124 + (c_custkey * 104729 % 57000) / 1000.0::DOUBLE AS lng FROM customer"
PLANT_SQL = "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS s, 25 + (s_suppkey * 15485863 % 24000) / 1000.0::DOUBLE AS lat, -124 + (s_suppkey * 32452843 % 57000) / 1000.0::DOUBLE AS lng FROM supplier"
MILES_SQL = "2 * 3958.8 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))"
BOX_SQL = "SELECT n_nationkey AS s, 25.0::DOUBLE + n_nationkey % 20 AS south, 29.0::DOUBLE + n_nationkey % 20 AS north, -124.0::DOUBLE + (n_nationkey * 7) % 50 AS west, -117.0::DOUBLE + (n_nationkey * 7) % 50 AS east FROM nation"


def v_box(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return t(spark, d, "nation").select(n.alias("s"), (n % 20 + 25.0).alias("south"), (n % 20 + 29.0).alias("north"), (n * 7 % 50 - 124.0).alias("west"), (n * 7 % 50 - 117.0).alias("east"))


def v_city(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    scores = [(1 + (n * k + 3 * k) % 5).alias(c) for k, c in enumerate(packs.CRITERIA, 1)]
    return t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(n.alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.when(n % 3 == 0, "Clear").when(n % 3 == 1, "Covered").otherwise("Targeted").alias("status"), *scores)


CITY_SQL = "SELECT n_nationkey AS id, n_name AS name, r_name AS region, CASE n_nationkey % 3 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Covered' ELSE 'Targeted' END AS status, " + ", ".join(f"1 + (n_nationkey * {k} + {3 * k}) % 5 AS {c}" for k, c in enumerate(packs.CRITERIA, 1)) + " FROM nation JOIN region ON n_regionkey = r_regionkey"
SCORE_SQL = "0.0::DOUBLE" + "".join(f" + {c} * {w}::DOUBLE" for c, w in zip(packs.CRITERIA, packs.WEIGHTS["collections"], strict=True))


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens_sql(c: str) -> str:
    timeless = rf"regexp_replace(lower(coalesce({c}, '')), '\b(20[0-9]{{2}}|q[1-4]|fy20[0-9]{{2}}|h[12])\b', '', 'g')"
    return f"list_filter(string_split(regexp_replace({timeless}, '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({quoted(text.HEADLINE_STOPWORDS + text.COMPANY_FORMS)}))"


def company_sql(c: str) -> str:
    return f"array_to_string(list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({quoted(text.COMPANY_FORMS + ('the',) + text.INDUSTRY_GENERICS)})), ' ')"


# a boundary of DuckDB's patterns knows ASCII alone, so words are cut by Unicode classes first
NOUNS_SQL = rf"list_filter(list_transform(regexp_extract_all(headline, '[\p{{L}}\p{{N}}_&]+'), lambda w: trim(w, '&')), lambda w: length(w) >= 3 AND regexp_full_match(w, '[A-Z][A-Za-z0-9&]+') AND w NOT IN ({quoted(text.PROPER_NOUN_JUNK)}))"


def bounded_sql(pattern: str) -> str:
    """The pattern with its boundaries spelled out by Unicode classes."""
    edge = r"[^\p{L}\p{N}_]"
    return pattern.replace(r"\b", f"(^|{edge})", 1).replace(r"\b", f"({edge}|$)", 1)


# news ---------------------------------------------------------------------------------------------------------------
@query("news_view", f"SELECT id, headline, date FROM ({NEWS_SQL}) WHERE contains(lower(headline), 'th') OR contains(lower(summary), 'th') ORDER BY date DESC, id LIMIT 100")
def news_view(spark, d):
    news = v_news(spark, d).withColumn("category", F.lit("M&A")).withColumn("categories", F.array(F.lit("M&A")))
    return views.news_view(news, "m & a", "th").select("id", "headline", "date")


@query("news_normalize_headline", f"SELECT id, array_to_string({tokens_sql('headline')}, ' ') AS headline_key FROM ({NEWS_SQL})")
def news_normalize_headline(spark, d):
    return v_news(spark, d).select("id", text.normalized_headline("headline").alias("headline_key"))


@query("news_proper_nouns", f"SELECT id, len(list_distinct({NOUNS_SQL})) AS n, array_to_string(list_sort(list_distinct({NOUNS_SQL})), ' ') AS nouns FROM ({NEWS_SQL})")
def news_proper_nouns(spark, d):
    nouns = text.proper_nouns("headline")
    return v_news(spark, d).select("id", F.size(nouns).cast("long").alias("n"), F.array_join(F.array_sort(nouns), " ").alias("nouns"))


@query("news_clean_text", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '</?[A-Za-z][^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS clean, trim(regexp_replace(regexp_replace(coalesce(html, ''), '</?[A-Za-z][^>]*(>|$)', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS sanitized FROM pages")
def news_clean_text(spark, d):
    return t(spark, d, "pages").select("page_id", text.without_tags("html").alias("clean"), text.sanitized("html").alias("sanitized"))


@query("url_normalize", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '^https?://', ''), '^www\\.', ''), '[#?].*$', ''), '/+$', '') AS url_key FROM pages")
def url_normalize(spark, d):
    return t(spark, d, "pages").select("page_id", text.normalized_url("url").alias("url_key"))


@query("url_homepage", f"SELECT page_id, regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) = '' OR regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') IN ({quoted(text.FRONT_PATHS)}) AS front FROM pages")
def url_homepage(spark, d):
    return t(spark, d, "pages").select("page_id", text.is_front_page("url").alias("front"))


LABELS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(headline, '(?i){bounded_sql(p)}') THEN '{c}' END" for c, p in TEST_PATTERNS) + "], lambda x: x IS NOT NULL)"


@query("news_classify_multi", f"SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE 'Industry Events' END AS categories, greatest(len(l), 1)::BIGINT AS n FROM (SELECT id, {LABELS_SQL} AS l FROM ({NEWS_SQL}))")
def news_classify_multi(spark, d):
    found = rules.labels(F.col("headline"), TEST_PATTERNS)
    return v_news(spark, d).select("id", F.array_join(found, "|").alias("categories"), F.size(found).cast("long").alias("n"))


@query("news_tag_histogram", f"SELECT n, count(*) AS articles FROM (SELECT greatest(len({LABELS_SQL}), 1)::BIGINT AS n FROM ({NEWS_SQL})) GROUP BY n")
def news_tag_histogram(spark, d):
    return v_news(spark, d).groupBy(F.size(rules.labels(F.col("headline"), TEST_PATTERNS)).cast("long").alias("n")).agg(F.count("*").alias("articles"))


@query("news_retag", f"SELECT id, CASE WHEN len(l) > 0 THEN l[1] ELSE 'Industry Events' END AS category, coalesce(l[1], 'Industry Events') <> lang AS changed FROM (SELECT id, lang, {LABELS_SQL} AS l FROM ({NEWS_SQL}))")
def news_retag(spark, d):
    first = rules.labels(F.col("headline"), TEST_PATTERNS, F.col("lang"))[0]
    return v_news(spark, d).select("id", first.alias("category"), (first != F.col("lang")).alias("changed"))


# the whole text of an article; the queries above and deal_has_news and deal_missing_news keep what their SQL says
def whole_text():
    return F.concat_ws(" ", "headline", "summary")


WHOLE_LABELS_SQL = LABELS_SQL.replace("regexp_matches(headline,", "regexp_matches(headline || ' ' || summary,")


@query("news_classify_multi_whole", f"SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE 'Industry Events' END AS categories, greatest(len(l), 1)::BIGINT AS n FROM (SELECT id, {WHOLE_LABELS_SQL} AS l FROM ({NEWS_SQL}))")
def news_classify_multi_whole(spark, d):
    found = rules.labels(whole_text(), TEST_PATTERNS)
    return v_news(spark, d).select("id", F.array_join(found, "|").alias("categories"), F.size(found).cast("long").alias("n"))


@query("news_tag_histogram_whole", f"SELECT n, count(*) AS articles FROM (SELECT greatest(len({WHOLE_LABELS_SQL}), 1)::BIGINT AS n FROM ({NEWS_SQL})) GROUP BY n")
def news_tag_histogram_whole(spark, d):
    return v_news(spark, d).groupBy(F.size(rules.labels(whole_text(), TEST_PATTERNS)).cast("long").alias("n")).agg(F.count("*").alias("articles"))


@query("news_retag_whole", f"SELECT id, CASE WHEN len(l) > 0 THEN l[1] ELSE 'Industry Events' END AS category, coalesce(l[1], 'Industry Events') <> lang AS changed FROM (SELECT id, lang, {WHOLE_LABELS_SQL} AS l FROM ({NEWS_SQL}))")
def news_retag_whole(spark, d):
    first = rules.labels(whole_text(), TEST_PATTERNS, F.col("lang"))[0]
    return v_news(spark, d).select("id", first.alias("category"), (first != F.col("lang")).alias("changed"))


WHOLE_COVER_SQL = f"WITH d AS (SELECT id, date::DATE AS dd, {company_sql('target')} AS t, {company_sql('acquirer')} AS a FROM (SELECT doc_id AS id, date, split_part(headline, ' ', 1) AS target, split_part(headline, ' ', 2) AS acquirer FROM (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS headline, strftime(DATE '2024-01-01' + ((doc_id * 7) % 400)::INT, '%Y-%m-%d') AS date FROM documents))), n AS (SELECT id, date::DATE AS nd, unnest(list_distinct(string_split({company_sql("headline || ' ' || summary")}, ' '))) AS w FROM ({NEWS_SQL})), tw AS (SELECT DISTINCT id, dd, unnest(string_split(t, ' ')) AS w FROM d WHERE t <> '' AND a <> ''), aw AS (SELECT DISTINCT id, dd, unnest(string_split(a, ' ')) AS w FROM d WHERE t <> '' AND a <> ''), c AS (SELECT id FROM d WHERE t = '' OR a = '' UNION SELECT id FROM (SELECT tw.id, n.id AS nid FROM tw JOIN n USING (w) WHERE abs(date_diff('day', dd, nd)) <= 30 INTERSECT SELECT aw.id, n.id AS nid FROM aw JOIN n USING (w) WHERE abs(date_diff('day', dd, nd)) <= 30))"


@query("deal_has_news_whole", WHOLE_COVER_SQL + " SELECT id FROM c")
def deal_has_news_whole(spark, d):
    return ingest.covered_deals(_doc_deals(spark, d), v_news(spark, d).withColumn("date", F.col("date").cast("date")))


@query("deal_missing_news_whole", WHOLE_COVER_SQL + " SELECT id FROM d WHERE id NOT IN (SELECT id FROM c)")
def deal_missing_news_whole(spark, d):
    return _doc_deals(spark, d).select("id").join(deal_has_news_whole(spark, d), "id", "left_anti")


@query("news_category_counts_zero_fill", "SELECT k - 1 AS ord, c AS category, count(doc_id)::BIGINT AS n FROM (SELECT unnest(['M&A', 'Regulatory', 'Renewable Fuels', 'Public Co.', 'Restaurant', 'Technology', 'Labor/Ops', 'Infrastructure', 'Industry Events', 'ESG']) AS c, generate_subscripts(range(10), 1)::INT AS k) LEFT JOIN (SELECT doc_id, CASE lang WHEN 'en' THEN 'M&A' WHEN 'fr' THEN 'Regulatory' WHEN 'de' THEN 'ESG' ELSE 'Industry Events' END AS own FROM documents) ON own = c GROUP BY ALL")
def news_category_counts(spark, d):
    legacy = F.create_map(*[F.lit(x) for x in ("en", "M&A", "fr", "Regulation", "de", "ESG")])
    return ingest.category_counts(v_news(spark, d).select(ingest.normal_category(legacy[F.col("lang")]).alias("category")))


@query("news_freshness_buckets", f"SELECT CASE WHEN date >= '2025-02-02' THEN 'new_today' WHEN date >= '2025-01-27' THEN 'recent' ELSE 'backfill' END AS bucket, count(*) AS n, min(date) AS first_date FROM ({NEWS_SQL}) GROUP BY 1")
def news_freshness(spark, d):
    return v_news(spark, d).groupBy(dates.freshness(F.col("date"), F.lit(AS_OF).cast("date")).alias("bucket")).agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


@query("news_archive_split", f"SELECT id, date::TIMESTAMP >= TIMESTAMP '2025-02-03 12:00:00' - INTERVAL 180 DAY AS kept FROM ({NEWS_SQL})")
def news_archive_split(spark, d):
    return v_news(spark, d).select("id", dates.kept_in_feed("date", F.lit(AS_OF + " 12:00:00").cast("timestamp")).alias("kept"))


@query("news_date_checks", f"SELECT id, date_diff('day', date::DATE, DATE '2025-02-03') > 14 AS too_old, date::DATE > DATE '2025-01-20' AS future, strftime(date::DATE, '%b %d, %Y') AS label FROM ({NEWS_SQL})")
def news_date_checks(spark, d):
    as_of = F.lit(AS_OF).cast("date")
    return v_news(spark, d).select("id", dates.too_old("date", as_of).alias("too_old"), dates.in_future("date", F.lit("2025-01-20").cast("date")).alias("future"), F.date_format(dates.iso_date("date"), "MMM dd, yyyy").alias("label"))


@query("news_exact_dups", f"SELECT id, first_id FROM (SELECT id, min(id) OVER (PARTITION BY lower(trim(headline))) AS first_id FROM ({NEWS_SQL}) WHERE trim(headline) <> '') WHERE id <> first_id")
def news_exact_dups(spark, d):
    news = v_news(spark, d).where("trim(headline) != ''").withColumn("k", F.lower(F.trim("headline")))
    return news.join(news.groupBy("k").agg(F.min("id").alias("first_id")), "k").where("id != first_id").select("id", "first_id")


def _keyed(spark, d):
    return ingest.news_keys(v_news(spark, d).withColumn("url", F.lit("")))


MATCH_SQL = f"WITH k AS (SELECT id, date, array_to_string({tokens_sql('headline')}, ' ') AS h, list_distinct({tokens_sql('headline')}) AS t, list_distinct({NOUNS_SQL}) AS p FROM ({NEWS_SQL})), pairs AS (SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS jaccard FROM k a JOIN k b ON a.id < b.id WHERE a.h <> '' AND b.h <> '' AND (a.h = b.h OR len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE >= 0.75 OR a.date = b.date AND len(list_intersect(a.p, b.p)) >= 4))"


@query("news_fuzzy_pairs", MATCH_SQL + " SELECT a, b, jaccard FROM pairs")
def news_fuzzy_pairs(spark, d):
    return match.news_pairs(_keyed(spark, d))


CLUSTER_SQL = MATCH_SQL.replace("WITH k", "WITH RECURSIVE k") + ", e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT id, id FROM k), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)"


@query("news_clusters", CLUSTER_SQL + " SELECT id, cluster FROM c")
def news_clusters(spark, d):
    return ingest.clustered(v_news(spark, d).select("id"), match.news_links(_keyed(spark, d)))


@query("news_survivors", CLUSTER_SQL + f" SELECT id, cluster, score FROM (SELECT id, cluster, score, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id) AS r FROM c JOIN (SELECT id, least(length(trim(headline)), 400) + least(length(trim(summary)), 400) + 10 + least(length(trim(source)), 400) AS score FROM ({NEWS_SQL})) USING (id)) WHERE r = 1")
def news_survivors(spark, d):
    rows = v_news(spark, d).withColumn("score", match.completeness({"headline": "string", "summary": "string", "date": "string", "source": "string"}).cast("long"))
    out = ingest.clustered(rows.select("id", "score"), match.news_links(_keyed(spark, d)))
    return match.survivors(out, "cluster", F.desc("score"), F.col("id")).select("id", "cluster", "score")


@query("stream_greedy_admission", MATCH_SQL.replace("WITH k", "WITH RECURSIVE k").replace("pairs AS (", "pairs AS MATERIALIZED (") + ", turn AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS n FROM pairs GROUP BY b), step(n, out) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT turn.n, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(out, x))) > 0 THEN list_append(out, turn.b) ELSE out END FROM step JOIN turn ON turn.n = step.n + 1) SELECT id FROM k WHERE id NOT IN (SELECT unnest(out) FROM (SELECT out FROM step ORDER BY n DESC LIMIT 1))")
def greedy_admission(spark, d):
    return match.admitted_news_ids(_keyed(spark, d))


@query("news_coerce", f"SELECT id, CASE WHEN date::DATE <= DATE '2025-01-30' THEN date END AS date, CASE WHEN date::DATE > DATE '2025-01-30' THEN '[Date unverified] ' || headline ELSE headline END AS raw_headline, greatest(1, least(5, CASE WHEN id % 9 = 0 THEN 3 ELSE id % 9 END))::INT AS relevance_score FROM ({NEWS_SQL}) WHERE headline <> '' AND date_diff('day', date::DATE, DATE '2025-01-30') <= 14")
def news_coerce(spark, d):
    raw = v_news(spark, d).withColumns({"source_url": F.lit("https://x.org/a/b"), "category": F.col("lang"), "relevance_score": (F.col("id") % 9).cast("string"), "is_deal": F.lit(None).cast("boolean")})
    return ingest.coerced_news(raw, F.lit("2025-01-30").cast("date"), TEST_PATTERNS).select("id", "date", F.col("headline").alias("raw_headline"), "relevance_score")


@query("news_archive_new", f"WITH k AS (SELECT id, array_to_string({tokens_sql('headline')}, ' ') AS h FROM ({NEWS_SQL})) SELECT id FROM k WHERE h NOT IN (SELECT h FROM k WHERE id % 2 = 0)")
def news_archive_new(spark, d):
    news = v_news(spark, d).select("id", "headline")
    return ingest.new_to(news.where("id % 2 = 0"), news).select("id")


# deals --------------------------------------------------------------------------------------------------------------
@query("deal_view", f"SELECT id, target, acquirer, date FROM ({DEAL_SQL}) WHERE date[1:4] = '1997' AND contains(lower(target || ' ' || acquirer), 'building') ORDER BY date DESC, id")
def deal_view(spark, d):
    deals = v_deal(spark, d).withColumns({c: F.lit("") for c in ("sponsor", "location", "services", "notes")})
    return views.deals_view(deals, year="1997", term="building").select("id", "target", "acquirer", "date")


@query("deal_csv_cells", f"SELECT id, CASE WHEN regexp_matches(c, '[\"\\n,]') THEN '\"' || replace(c, '\"', '\"\"') || '\"' ELSE c END AS cell FROM (SELECT id, target || ', ' || acquirer || ' \"' || deal_type || '\"' AS c FROM ({DEAL_SQL}))")
def deal_csv_cells(spark, d):
    return v_deal(spark, d).select("id", views.csv_cell(F.concat("target", F.lit(", "), "acquirer", F.lit(' "'), "deal_type", F.lit('"'))).alias("cell"))


@query("deal_summary_counts", f"SELECT count(*) AS total, count(*) FILTER (deal_type LIKE '1%') AS platform, count(*) FILTER (deal_type LIKE '2%') AS add_on, count(*) FILTER (deal_type NOT LIKE '1%' AND deal_type NOT LIKE '2%') AS other FROM ({DEAL_SQL})")
def deal_summary_counts(spark, d):
    k = F.col("deal_type")
    return v_deal(spark, d).agg(F.count("*").alias("total"), F.count_if(k.startswith("1")).alias("platform"), F.count_if(k.startswith("2")).alias("add_on"), F.count_if(~k.startswith("1") & ~k.startswith("2")).alias("other"))


@query("deal_year_options", f"SELECT DISTINCT date[1:4]::INT AS year FROM ({DEAL_SQL}) WHERE date[1:4]::INT >= 1997")
def deal_year_options(spark, d):
    return v_deal(spark, d).select(F.substring("date", 1, 4).cast("int").alias("year")).where("year >= 1997").distinct()


@query("deal_platform", f"SELECT id, CASE WHEN acquirer = 'BUILDING' THEN 'Darling' WHEN acquirer = 'MACHINERY' THEN 'LES' ELSE 'Other' END AS platform FROM ({DEAL_SQL})")
def deal_platform(spark, d):
    buyer = F.when(F.col("acquirer") == "BUILDING", "Darling Ingredients").when(F.col("acquirer") == "MACHINERY", "LES Group").otherwise("Lester Pumping")
    return v_deal(spark, d).select("id", views.platform(buyer, F.lit("")).alias("platform"))


@query("deal_exact_dups", f"SELECT target_key, acquirer_key, n FROM (SELECT {company_sql('target')} AS target_key, {company_sql('acquirer')} AS acquirer_key, count(*) AS n FROM ({DEAL_SQL}) GROUP BY 1, 2) WHERE n > 1")
def deal_exact_dups(spark, d):
    return v_deal(spark, d).groupBy(text.normalized_company("target").alias("target_key"), text.normalized_company("acquirer").alias("acquirer_key")).agg(F.count("*").alias("n")).where("n > 1")


@query("deal_name_matches", f"WITH n AS (SELECT DISTINCT {company_sql('p_name')} AS x FROM part) SELECT a.x AS a, b.x AS b FROM n a JOIN n b ON a.x < b.x WHERE a.x <> '' AND (contains(a.x, b.x) OR contains(b.x, a.x) OR len(list_intersect(string_split(a.x, ' '), string_split(b.x, ' '))) / least(len(list_distinct(string_split(a.x, ' '))), len(list_distinct(string_split(b.x, ' '))))::DOUBLE >= 0.5)")
def deal_name_matches(spark, d):
    names = t(spark, d, "part").select(text.normalized_company("p_name").alias("x")).distinct()
    words = names.select("x", F.explode(F.array_distinct(F.concat(F.split("x", " "), F.transform(F.sequence(F.lit(1), F.greatest(F.length("x") - 2, F.lit(1))), lambda k: F.substring(F.col("x"), k, F.lit(3)))))).alias("w"))
    pairs = words.alias("l").join(words.alias("r"), "w").where("l.x < r.x").select(F.col("l.x").alias("a"), F.col("r.x").alias("b")).distinct()
    return pairs.where(match.names_match(F.col("a"), F.col("b"), 0.5))


@query("deal_fuzzy_pairs", f"WITH k AS (SELECT id, date, {company_sql('target')} AS t, {company_sql('acquirer')} AS a FROM (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Target ' || (o_orderkey * 7919 % 9973) AS target, 'Buyer ' || (o_custkey % 997) AS acquirer FROM orders)) SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.a = y.a AND x.id < y.id WHERE x.t = y.t OR contains(x.t, y.t) OR contains(y.t, x.t) OR abs(date_diff('day', x.date::DATE, y.date::DATE)) <= 60")
def deal_fuzzy_pairs(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").cast("date").alias("date"), F.concat(F.lit("Target "), (F.col("o_orderkey") * 7919 % 9973).cast("string")).alias("target"), F.concat(F.lit("Buyer "), (F.col("o_custkey") % 997).cast("string")).alias("acquirer"))
    keyed = o.select("id", "date", text.normalized_company("target").alias("target_key"), text.normalized_company("acquirer").alias("acquirer_key"))
    # the acquirers' names share the word 'buyer', so they match at 0.5 but not at 0.7; the SQL takes equal ones alone
    return match.deal_pairs(keyed, equal_acquirers=True)


def overlap_sql(a: str, b: str, threshold: float) -> str:
    """match.names_match of two normalised names."""
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) >= {threshold}))"


# the whole rule of acquirers and, with places, of targets; deal_fuzzy_pairs keeps what its SQL says: equal acquirers
WHOLE_DEAL_SQL = f"SELECT id, date::DATE AS date, {company_sql('target')} AS t, {company_sql('acquirer')} AS a, lat, lng FROM (SELECT o_orderkey AS id, o_orderdate AS date, '{{name}} ' || (o_orderkey * 7919 % 9973){{more}} AS target, 'Buyer ' || (o_custkey % 997) AS acquirer, 30 + (o_orderkey * 7919 % 2000) / 1000.0::DOUBLE AS lat, -90 + (o_orderkey * 104729 % 2000) / 1000.0::DOUBLE AS lng FROM orders)"
ALIKE_SQL = f"acquirers AS MATERIALIZED (SELECT DISTINCT a FROM k), alike AS MATERIALIZED (SELECT p.a AS p, q.a AS q FROM acquirers p JOIN acquirers q ON {overlap_sql('p.a', 'q.a', 0.7)}), near AS MATERIALIZED (SELECT x.id AS xi, y.id AS yi, x.t AS xt, y.t AS yt, abs(date_diff('day', x.date, y.date)) <= 60 AS close, x.lat AS xlat, x.lng AS xlng, y.lat AS ylat, y.lng AS ylng FROM k x JOIN alike ON p = x.a JOIN k y ON q = y.a AND x.id < y.id)"
DEAL_PAIRS_SQL = f"SELECT xi AS a, yi AS b FROM near WHERE {overlap_sql('xt', 'yt', 0.8)} OR close AND {overlap_sql('xt', 'yt', 0.5)}"


def whole_deals(spark, d, *more):
    target = F.concat_ws(" ", F.lit("Target"), (F.col("o_orderkey") * 7919 % 9973).cast("string"), *more)
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), target.alias("target"), F.concat(F.lit("Buyer "), (F.col("o_custkey") % 997).cast("string")).alias("acquirer"), F.expr("30 + (o_orderkey * 7919 % 2000) / 1000.0D").alias("lat"), F.expr("-90 + (o_orderkey * 104729 % 2000) / 1000.0D").alias("lng"))
    return o.select("id", "date", text.normalized_company("target").alias("target_key"), text.normalized_company("acquirer").alias("acquirer_key"), "lat", "lng")


@query("deal_fuzzy_pairs_whole", f"WITH k AS MATERIALIZED ({WHOLE_DEAL_SQL.format(name='Target', more='')}), {ALIKE_SQL} {DEAL_PAIRS_SQL}")
def deal_fuzzy_pairs_whole(spark, d):
    return match.deal_pairs(whole_deals(spark, d).drop("lat", "lng"))


# targets of three words share one, which only the arm of 50 miles takes
@query("deal_fuzzy_pairs_placed", f"WITH k AS MATERIALIZED ({WHOLE_DEAL_SQL.format(name='Target', more=" || ' ' || (o_orderkey % 89 + 10000)")}), {ALIKE_SQL} {DEAL_PAIRS_SQL} OR close AND {overlap_sql('xt', 'yt', 0.3)} AND {MILES_SQL.format(a='x', b='y').replace('x.', 'x').replace('y.', 'y')} <= 50")
def deal_fuzzy_pairs_placed(spark, d):
    return match.deal_pairs(whole_deals(spark, d, (F.col("o_orderkey") % 89 + 10000).cast("string")))


# who hangs together, through classes of equal names
CLUSTERED_SQL = f"SELECT id, date::DATE AS date, {company_sql('target')} AS t, {company_sql('acquirer')} AS a FROM (SELECT o_orderkey AS id, o_orderdate AS date, 'Plant' || (o_orderkey * 7919 % 9973 // 4) || ' Site' || (o_orderkey % 37) AS target, 'Buyer ' || (o_custkey % 97) AS acquirer FROM orders)"


@query("deal_clusters", f"WITH RECURSIVE k AS MATERIALIZED ({CLUSTERED_SQL}), acquirers AS MATERIALIZED (SELECT DISTINCT a FROM k), alike AS MATERIALIZED (SELECT p.a AS p, q.a AS q FROM acquirers p JOIN acquirers q ON {overlap_sql('p.a', 'q.a', 0.7)}), pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM k x JOIN alike ON p = x.a JOIN k y ON q = y.a AND x.id <> y.id WHERE {overlap_sql('x.t', 'y.t', 0.8)} OR abs(date_diff('day', x.date, y.date)) <= 60 AND {overlap_sql('x.t', 'y.t', 0.5)}), reach(node, least) AS (SELECT id, id FROM k UNION SELECT pairs.b, reach.least FROM reach JOIN pairs ON pairs.a = reach.node WHERE reach.least < pairs.b) SELECT node AS id, min(least) AS cluster FROM reach GROUP BY node")
def deal_clusters(spark, d):
    target = F.concat(F.lit("Plant"), F.floor(F.col("o_orderkey") * 7919 % 9973 / 4).cast("string"), F.lit(" Site"), (F.col("o_orderkey") % 37).cast("string"))
    deals = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), text.normalized_company(target).alias("target_key"), text.normalized_company(F.concat(F.lit("Buyer "), (F.col("o_custkey") % 97).cast("string"))).alias("acquirer_key"))
    return match.deal_clusters(deals)


# a year of deals is at hand, every seventh without a buyer; the later ones come in id order
INGEST_SQL = WHOLE_DEAL_SQL.format(name="Target", more="").replace("'Buyer ' || (o_custkey % 997)", "CASE WHEN o_orderkey % 7 = 0 THEN 'The Group' ELSE 'Buyer ' || (o_custkey % 997) END")


@query("deal_ingest", f"WITH RECURSIVE k AS MATERIALIZED ({INGEST_SQL}), {ALIKE_SQL}, pairs AS MATERIALIZED ({DEAL_PAIRS_SQL}), old AS MATERIALIZED (SELECT id FROM k WHERE date < DATE '1993-01-01'), fresh AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id)::INT AS n FROM k WHERE date >= DATE '1993-01-01' AND a <> '' AND t <> '' AND id NOT IN (SELECT a FROM pairs WHERE b IN (SELECT id FROM old) UNION SELECT b FROM pairs WHERE a IN (SELECT id FROM old))), earlier AS MATERIALIZED (SELECT y.n, list(x.n) AS before FROM pairs JOIN fresh x ON x.id = pairs.a JOIN fresh y ON y.id = pairs.b GROUP BY y.n), turn AS MATERIALIZED (SELECT n, before, row_number() OVER (ORDER BY n)::INT AS k FROM earlier), step(k, out) AS (SELECT 0, []::INT[] UNION ALL SELECT turn.k, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(out, x))) > 0 THEN list_append(out, turn.n) ELSE out END FROM step JOIN turn ON turn.k = step.k + 1) SELECT id FROM fresh WHERE n NOT IN (SELECT unnest(out) FROM (SELECT out FROM step ORDER BY k DESC LIMIT 1))")
def deal_ingest(spark, d):
    acquirer = F.when(F.col("id") % 7 == 0, "").otherwise(F.col("acquirer_key"))
    deals = whole_deals(spark, d).drop("lat", "lng").withColumn("acquirer_key", acquirer)
    old = F.col("date") < F.lit("1993-01-01").cast("date")
    return ingest.merged_deals(deals.where(~old), deals.where(old))


COVER_SQL = f"WITH d AS (SELECT id, date::DATE AS dd, {company_sql('target')} AS t, {company_sql('acquirer')} AS a FROM (SELECT doc_id AS id, date, split_part(headline, ' ', 1) AS target, split_part(headline, ' ', 2) AS acquirer FROM (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS headline, strftime(DATE '2024-01-01' + ((doc_id * 7) % 400)::INT, '%Y-%m-%d') AS date FROM documents))), n AS (SELECT id, date::DATE AS nd, unnest(list_distinct(string_split({company_sql('headline')}, ' '))) AS w FROM ({NEWS_SQL}))"


def _doc_deals(spark, d):
    h = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7 % 400).cast("int")).alias("date"), F.split_part(h, F.lit(" "), F.lit(1)).alias("target"), F.split_part(h, F.lit(" "), F.lit(2)).alias("acquirer"), F.lit("Asset sale").alias("deal_type"), F.lit("").alias("sponsor"), F.lit("").alias("location"), F.lit("N/A").alias("deal_size"), F.lit(None).cast("string").alias("notes"), F.array().cast("array<string>").alias("deal_summary"))


HAS_SQL = COVER_SQL + ", c AS (SELECT d.id FROM d WHERE t = '' OR a = '' UNION SELECT x.id FROM (SELECT d.id, n.id AS nid FROM d JOIN n ON list_contains(string_split(d.t, ' '), n.w) AND abs(date_diff('day', dd, nd)) <= 30 WHERE t <> '' AND a <> '') x JOIN (SELECT d.id, n.id AS nid FROM d JOIN n ON list_contains(string_split(d.a, ' '), n.w) AND abs(date_diff('day', dd, nd)) <= 30 WHERE t <> '' AND a <> '') y ON x.id = y.id AND x.nid = y.nid)"


def _covered(spark, d):
    news = v_news(spark, d).withColumns({"summary": F.lit(""), "date": F.col("date").cast("date")})
    return ingest.covered_deals(_doc_deals(spark, d), news)


@query("deal_has_news", HAS_SQL + " SELECT id FROM c")
def deal_has_news(spark, d):
    return _covered(spark, d)


@query("deal_missing_news", HAS_SQL + " SELECT id FROM d WHERE id NOT IN (SELECT id FROM c)")
def deal_missing_news(spark, d):
    return _doc_deals(spark, d).join(_covered(spark, d), "id", "left_anti").select("id")


@query("synth_news", "SELECT o_orderkey AS id, trim(c_name || ' Acquires Assets Of ' || 'Deal ' || o_orderkey) AS headline, 'Location: ' || c_mktsegment || '. Type: Asset sale. Size: ' || o_orderpriority AS summary FROM orders JOIN customer ON o_custkey = c_custkey")
def synth_news(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    deals = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.concat(F.lit("Deal "), F.col("o_orderkey").cast("string")).alias("target"), F.col("c_name").alias("acquirer"), F.lit("Asset sale").alias("deal_type"), F.lit("").alias("sponsor"), F.col("c_mktsegment").alias("location"), F.col("o_orderpriority").alias("deal_size"), F.lit(None).cast("string").alias("notes"), F.array().cast("array<string>").alias("deal_summary"))
    return ingest.synthesized(deals).select("id", "headline", "summary")


@query("deal_validate", f"SELECT id, CASE WHEN trim(target) = '' THEN 'missing' WHEN regexp_matches(target || acquirer, '</?[a-zA-Z][^>]*>') THEN 'tag' END AS reason FROM ({DEAL_SQL})")
def deal_validate(spark, d):
    return ingest.validated_deals(v_deal(spark, d).withColumn("location", F.lit(""))).select("id", "reason")


# facilities ---------------------------------------------------------------------------------------------------------
@query("facility_coord_plausible", f"SELECT id, lat, lng FROM ({FACILITY_SQL}) WHERE lat > 17 AND lat < 72 AND lng > -180 AND lng < -64 AND id % 7 <> 0")
def facility_coord_plausible(spark, d):
    f = v_facility(spark, d).withColumn("lat", F.when(F.col("id") % 7 == 0, F.lit(0.0)).otherwise(F.col("lat")))
    return f.where(geo.plausible(F.col("lat"), F.col("lng"))).select("id", "lat", "lng")


@query("facility_in_bbox", f"SELECT f.id, coalesce(lat BETWEEN south - 0.5 AND north + 0.5 AND lng BETWEEN west - 0.5 AND east + 0.5, true) AS inside FROM ({FACILITY_SQL}) f LEFT JOIN ({BOX_SQL}) USING (s)")
def facility_in_bbox(spark, d):
    f = v_facility(spark, d).join(F.broadcast(v_box(spark, d)), "s", "left")
    return f.select("id", geo.in_box(F.col("lat"), F.col("lng"), *[F.col(c) for c in ("south", "north", "west", "east")]).alias("inside"))


@query("facility_coord_repair", f"WITH f AS (SELECT *, lpad((id % 100)::VARCHAR, 5, '0') AS zip FROM ({FACILITY_SQL})), z AS (SELECT lpad(id::VARCHAR, 5, '0') AS zip, lat AS z_lat, lng AS z_lng FROM ({PLANT_SQL}) WHERE id < 100), j AS (SELECT * FROM f LEFT JOIN ({BOX_SQL}) USING (s) LEFT JOIN z USING (zip)), k AS (SELECT *, CASE WHEN coalesce(lat BETWEEN south - 0.5 AND north + 0.5 AND lng BETWEEN west - 0.5 AND east + 0.5, true) THEN NULL WHEN z_lat IS NOT NULL AND coalesce(z_lat BETWEEN south - 0.5 AND north + 0.5 AND z_lng BETWEEN west - 0.5 AND east + 0.5, true) THEN 'zip' ELSE 'state_centroid' END AS fix FROM j) SELECT id, fix, CASE WHEN fix IS NULL THEN lat WHEN fix = 'zip' THEN z_lat ELSE (south + north) / 2 END AS lat, CASE WHEN fix IS NULL THEN lng WHEN fix = 'zip' THEN z_lng ELSE (west + east) / 2 END AS lng FROM k")
def facility_coord_repair(spark, d):
    pad = lambda c: F.lpad(c.cast("string"), 5, "0")
    f = v_facility(spark, d).withColumn("z", F.concat(F.lit("ZIP "), pad(F.col("id") % 100), F.lit("-1234")))
    zips = v_plant(spark, d).where("id < 100").select(pad(F.col("id")).alias("zip"), F.col("lat").alias("z_lat"), F.col("lng").alias("z_lng"))
    return facilities.repaired(f, v_box(spark, d), zips).select("id", "fix", "lat", "lng")


CASCADE_SQL = "CASE WHEN p_type = 'ECONOMY' OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') THEN 'kept_consolidator' WHEN contains(lower(p_name), 'part_1 ') THEN 'dropped_treatment_works' WHEN starts_with(lower(p_name), 'part_2') OR contains(lower(p_name), '9') THEN 'dropped_municipal' WHEN regexp_matches(lower(p_name), '3|4') AND NOT contains(lower(p_name), '5') THEN 'dropped_negative' WHEN p_size % 5 = 0 THEN 'kept_562991' WHEN p_size % 5 = 1 AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '8') THEN 'kept_311613_brand' WHEN p_size % 5 = 1 AND contains(lower(p_name), '6') THEN 'kept_311613_term' WHEN p_size % 5 = 1 AND contains(lower(p_name), '7') THEN 'dropped_311613_meat' WHEN p_size % 5 = 1 THEN 'kept_311613' WHEN p_size % 5 = 2 THEN 'kept_562219' WHEN p_size % 5 = 3 AND contains(lower(p_name), '5') THEN 'kept_562111_positive' WHEN p_size % 5 = 3 THEN 'dropped_562111' WHEN contains(lower(p_name), '5') THEN 'kept_positive' ELSE 'dropped_no_signal' END"


def _parts(spark, d):
    codes = F.element_at(F.array(*[F.lit(c) for c in ("562991; 1", "2,311613", "562219", "562111;3", "9")]), F.col("p_size") % 5 + 1)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("n"), F.col("p_brand").alias("op"), F.col("p_type").alias("ot"), F.col("p_type").alias("ct"), codes.alias("na"))


@query("facility_filter_cascade", f"SELECT p_partkey AS id, {CASCADE_SQL} AS rule FROM part")
def facility_filter_cascade(spark, d):
    return _parts(spark, d).select("id", facilities.cascade(TEST_PACK).alias("rule"))


@query("facility_filter_counters", f"SELECT {CASCADE_SQL} AS rule, count(*) AS n, starts_with(rule, 'kept_') AS kept FROM part GROUP BY 1")
def facility_filter_counters(spark, d):
    return _parts(spark, d).groupBy(facilities.cascade(TEST_PACK).alias("rule")).agg(F.count("*").alias("n")).withColumn("kept", F.col("rule").startswith("kept_"))


@query("facility_collection_filter", "SELECT p_partkey AS id, (p_size % 5 = 0 OR contains(lower(p_name), '1') OR contains(lower(p_name), '2') AND contains(lower(p_name), '6')) AND NOT contains(lower(p_name), '9') AND NOT contains(lower(p_name), '7') AND NOT contains(lower(p_name), '8') AS passes FROM part")
def facility_collection_filter(spark, d):
    return _parts(spark, d).select("id", facilities.is_collector(("1", "2"), ("2",), ("6",), "9", ("7",), ("8",)).alias("passes"))


@query("facility_brand", "SELECT p_partkey AS id, CASE WHEN contains(p_name, '1') THEN 'One' WHEN contains(p_name, '2') THEN 'Two' ELSE p_name END AS parent, CASE WHEN contains(p_name, '1') THEN 'LES' WHEN contains(p_name, '2') THEN 'Darling' ELSE 'Independent' END AS type, CASE WHEN contains(p_name, '1') THEN 'LES' WHEN contains(p_name, '2') THEN 'DAR' ELSE 'LOC' END AS bucket FROM part")
def facility_brand(spark, d):
    b = facilities.brand((("1", "One", "LES"), ("2", "Two", "Darling")), F.col("n"))
    return _parts(spark, d).select("id", b["parent"].alias("parent"), b["type"].alias("type"), facilities.bucket(b["type"]).alias("bucket"))


@query("facility_reclassify_chain", "SELECT p_partkey AS id, CASE WHEN contains(lower(p_name || ' ' || p_brand), '33') THEN 'WRM' WHEN contains(p_name || ' ' || p_brand, '2') AND NOT (NOT contains(lower(p_name), '9') AND (p_type = 'PROMO' OR p_type <> 'SMALL' AND contains(p_name || ' ' || p_brand, '44'))) THEN 'REG' WHEN contains(lower(p_name), '9') THEN p_type WHEN p_type = 'PROMO' THEN 'PUB' WHEN p_type = 'SMALL' THEN 'PE' WHEN contains(p_name || ' ' || p_brand, '44') THEN 'PUB' ELSE p_type END AS ct FROM part")
def facility_reclassify_chain(spark, d):
    out = facilities.reclassified(_parts(spark, d), ["9"], {"PROMO": ("PUB", "Public: P"), "SMALL": ("PE", "PE-Backed: S")}, [("zzz", "Public: Z")], ("44", "Public: 44"), [("2", "REG", "Regional: 2", True), ("33", "WRM", "WRM", False)])
    return out.select("id", "ct")


@query("facility_nearest_plant", f"SELECT id, np, nd FROM (SELECT f.id, p.id AS np, round({MILES_SQL.format(a='f', b='p')}, 4) AS nd, row_number() OVER (PARTITION BY f.id ORDER BY {MILES_SQL.format(a='f', b='p')}, p.id) AS r FROM ({FACILITY_SQL}) f, ({PLANT_SQL}) p) WHERE r = 1")
def facility_nearest_plant(spark, d):
    return nearest.with_nearest(v_facility(spark, d), v_plant(spark, d)).select("id", "np", F.round("nd", 4).alias("nd"))


@query("facility_near_stats", f"SELECT s, count(*) AS n, count(*) FILTER (nd > 25) AS far, round(avg(nd), 3) AS mean_nd FROM (SELECT f.id, f.s, round(min({MILES_SQL.format(a='f', b='p')}), 1) AS nd FROM ({FACILITY_SQL}) f, ({PLANT_SQL}) p GROUP BY 1, 2) GROUP BY s")
def facility_near_stats(spark, d):
    near = nearest.with_nearest(v_facility(spark, d), v_plant(spark, d)).withColumn("nd", F.round("nd", 1))
    return near.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("nd") > 25).alias("far"), F.round(F.avg("nd"), 3).alias("mean_nd"))


@query("facility_conditional_renearest", f"SELECT f.id, CASE WHEN m <= 300 AND m < old THEN 'new' ELSE 'old' END AS np, CASE WHEN m <= 300 AND m < old THEN round(m, 1) ELSE old END AS nd FROM (SELECT f.id, {MILES_SQL.format(a='f', b='q')} AS m, (f.id % 500)::DOUBLE AS old FROM ({FACILITY_SQL}) f, (SELECT 39.5 AS lat, -98.35 AS lng) q) f")
def facility_renearest(spark, d):
    f = v_facility(spark, d).withColumns({"np": F.lit("old"), "nd": (F.col("id") % 500).cast("double")})
    return nearest.renearest(f, ("new", 39.5, -98.35), 300).select("id", "np", "nd")


@query("market_nearest_flag", f"WITH m AS (SELECT * FROM (VALUES {', '.join(str(m) for m in packs.TARGET_MARKETS)}) AS m(name, lat, lng)) SELECT id, mi <= 50 AS is_target_market, CASE WHEN mi <= 50 THEN name || ' (' || round(mi)::INT || ' mi)' END AS target_market_name FROM (SELECT f.id, m.name, {MILES_SQL.format(a='f', b='m')} AS mi, row_number() OVER (PARTITION BY f.id ORDER BY {MILES_SQL.format(a='f', b='m')}, m.name) AS r FROM ({FACILITY_SQL}) f, m) WHERE r = 1")
def market_nearest_flag(spark, d):
    markets = spark.createDataFrame(packs.TARGET_MARKETS, "name string, lat double, lng double")
    return nearest.nearest_market(v_facility(spark, d).select("id", "lat", "lng"), markets).select("id", "is_target_market", "target_market_name")


@query("operator_fuzzy_near", f"SELECT a.id AS a, b.id AS b FROM ({FACILITY_SQL}) a JOIN ({FACILITY_SQL}) b ON a.id < b.id WHERE {MILES_SQL.format(a='a', b='b')} <= 15")
def operator_fuzzy_near(spark, d):
    f = v_facility(spark, d).select("id", "lat", "lng")
    return nearest.within_radius(f, f, 15).select("a", "b")


@query("facility_verification_apply", "SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'C' WHEN quality = 0 THEN 'U' END AS vs FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1 AND toxic = 1, false)")
def facility_verification_apply(spark, d):
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "CONFIRMED_FOG").when((F.col("quality") == 1) & (F.col("toxic") == 1), "NOT_FOG").otherwise("UNCLEAR")
    verdicts = t(spark, d, "labels").select(F.col("doc_id").alias("id"), kind.alias("classification"))
    return facilities.verified(t(spark, d, "documents").select(F.col("doc_id").alias("id")), verdicts).select("id", "vs")


@query("verify_crosstab", "SELECT coalesce(source, 'TOTAL') AS tier, count(*) AS checked, count(*) FILTER (quality = 1 AND toxic = 0) AS confirmed_fog, count(*) FILTER (quality = 1 AND toxic = 1) AS not_fog, count(*) FILTER (quality = 0) AS unclear, round(count(*) FILTER (quality = 1 AND toxic = 1) * 100.0::DOUBLE / count(*), 4) AS fp_rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def verify_crosstab(spark, d):
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "CONFIRMED_FOG").when((F.col("quality") == 1) & (F.col("toxic") == 1), "NOT_FOG").otherwise("UNCLEAR")
    return facilities.crosstab(t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.col("source").alias("tier"), kind.alias("classification")))


@query("verify_stratified_sample", "SELECT id, tier FROM (SELECT doc_id AS id, lang AS tier, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS p FROM documents) WHERE p <= CASE tier WHEN 'en' THEN 75 WHEN 'fr' THEN 50 WHEN 'de' THEN 40 WHEN 'es' THEN 20 END")
def verify_stratified_sample(spark, d):
    return facilities.stratified(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tier")), {"en": 75, "fr": 50, "de": 40, "es": 20})


@query("facility_merge_supplements", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 20, s_name FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def facility_merge_supplements(spark, d):
    return match.inserted_if_absent(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name")), "id")


@query("facility_upsert", "SELECT coalesce(s_suppkey * 20, c_custkey) AS id, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS bal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20")
def facility_upsert(spark, d):
    base = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return match.upserted(base, t(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), "id")


@query("facility_universe_priority", "SELECT id, layer, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY layer) AS r FROM (SELECT s_suppkey * 10 AS id, 0 AS layer, s_name AS name FROM supplier UNION ALL SELECT c_custkey, 1, c_name FROM customer)) WHERE r = 1")
def facility_universe_priority(spark, d):
    both = t(spark, d, "supplier").select((F.col("s_suppkey") * 10).alias("id"), F.lit(0).alias("layer"), F.col("s_name").alias("name")).unionByName(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("layer"), F.col("c_name").alias("name")))
    return match.first_of(both, "id", F.col("layer"))


@query("facility_search_first_hit", "SELECT layer, id, name FROM (SELECT 0 AS k, 'plant' AS layer, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1, 'operator', c_custkey, c_name FROM customer) WHERE contains(lower(name), '42') ORDER BY k, id LIMIT 1")
def facility_search_first_hit(spark, d):
    return nearest.first_hit([(v_plant(spark, d), "plant"), (v_facility(spark, d), "operator")], "42")


@query("layer_visible_counts", f"SELECT b AS bucket, count(*) AS n, list_position([{quoted(packs.BUCKETS)}], b)::BIGINT AS ord FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'LES' WHEN 1 THEN 'PUB' WHEN 2 THEN 'LOC' ELSE 'UNK' END AS b, c_custkey % 3 AS v FROM customer WHERE c_nationkey = 3) WHERE b <> 'UNK' AND v <> 1 GROUP BY b")
def layer_visible_counts(spark, d):
    f = v_facility(spark, d).select(F.element_at(F.array(*[F.lit(b) for b in ("LES", "PUB", "LOC", "UNK")]), (F.col("id") % 4 + 1).cast("int")).alias("bucket"), "s", F.when(F.col("id") % 3 == 0, "C").when(F.col("id") % 3 == 1, "U").alias("vs"))
    return views.layer_counts(f, ["LES", "PUB", "LOC"], "3")


@query("density_zip_join", "SELECT zip, lat, n, ln(1.0 + n) AS heat FROM (SELECT lpad(c_nationkey::VARCHAR, 5, '0') AS zip, count(*) AS n FROM customer GROUP BY 1) JOIN (SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS zip, 25.0::DOUBLE + n_nationkey AS lat FROM nation) USING (zip)".replace("ln(1.0 + n) AS heat", "round(ln(1.0 + n), 6) AS heat"))
def density_zip_join(spark, d):
    z = lambda c: text.zero_filled(F.col(c).cast("string"), 5).alias("zip")
    counts = t(spark, d, "customer").groupBy(z("c_nationkey")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(t(spark, d, "nation").select(z("n_nationkey"), (F.col("n_nationkey") + 25.0).alias("lat"))), "zip").select("zip", "lat", "n", F.round(geo.heat(F.col("n")), 6).alias("heat"))


# screener -----------------------------------------------------------------------------------------------------------
@query("screener_scores", f"SELECT id, s AS score, CASE WHEN s >= 3.5 THEN 'A' WHEN s >= 3.0 THEN 'B' ELSE 'C' END AS tier FROM (SELECT id, {SCORE_SQL} AS s FROM ({CITY_SQL}))")
def screener_scores(spark, d):
    return views.scored(v_city(spark, d), packs.WEIGHTS["collections"]).select("id", "score", "tier")


@query("screener_rank", f"SELECT id, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, id)::INT AS rank FROM (SELECT *, {SCORE_SQL} AS s FROM ({CITY_SQL}))) WHERE region = 'ASIA' AND s >= 2.0")
def screener_rank(spark, d):
    return views.screener(v_city(spark, d), packs.WEIGHTS["collections"], region="ASIA", least=2.0).select("id", "rank")


@query("screener_tier2", f"SELECT id, name FROM (SELECT *, {SCORE_SQL} AS s FROM ({CITY_SQL})) WHERE status = 'Clear' AND s >= 3.0")
def screener_tier2(spark, d):
    return views.screener(v_city(spark, d), packs.WEIGHTS["collections"], clear_only=True, least=3.0).select("id", "name")


@query("screener_contrib", "SELECT id, criterion, score, round(contribution, 9) AS contribution, bar FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS criterion, {c} AS score, {c} * {w}::DOUBLE AS contribution, round({c} * {w}::DOUBLE / 1.5 * 100)::INT AS bar FROM ({CITY_SQL})" for c, w in zip(packs.CRITERIA, packs.WEIGHTS["collections"], strict=True)) + ")")
def screener_contrib(spark, d):
    return views.contributions(v_city(spark, d), packs.WEIGHTS["collections"]).withColumn("contribution", F.round("contribution", 9))


# digest, audit, text blocks -----------------------------------------------------------------------------------------
@query("digest_sections", f"SELECT CASE WHEN date = '2025-02-03' THEN 'TODAY' WHEN date = '2025-02-02' THEN 'YESTERDAY' ELSE strftime(date::DATE, '%b %d, %Y') END AS label, count(*) AS n FROM ({NEWS_SQL}) WHERE date >= '2025-01-27' GROUP BY 1")
def digest_sections(spark, d):
    as_of = F.lit(AS_OF).cast("date")
    recent = v_news(spark, d).where(dates.freshness(F.col("date"), as_of) != "backfill")
    return recent.groupBy(dates.relative_label(dates.iso_date("date"), as_of).alias("label")).agg(F.count("*").alias("n"))


@query("audit_report", f"SELECT 1 AS check_id, n = 0 AS passed, n AS n_bad FROM (SELECT count(*) AS n FROM ({NEWS_SQL}) WHERE date > '2025-01-30') UNION ALL SELECT 2, n = 0, n FROM (SELECT count(*) AS n FROM ({NEWS_SQL}) WHERE regexp_matches(headline, '</?[A-Za-z][^>]*>')) UNION ALL SELECT 3, n = 0, n FROM (SELECT (count(*) - count(DISTINCT lower(trim(headline))))::BIGINT AS n FROM ({NEWS_SQL}) WHERE trim(headline) <> '') UNION ALL SELECT 6, n = 0, n FROM (SELECT count(*) AS n FROM ({FACILITY_SQL}) JOIN ({BOX_SQL}) USING (s) WHERE NOT (lat BETWEEN south - 0.5 AND north + 0.5 AND lng BETWEEN west - 0.5 AND east + 0.5)) UNION ALL SELECT 9, n = 0, n FROM (SELECT count(*) AS n FROM pages WHERE url IS NULL OR NOT starts_with(url, 'http')) UNION ALL SELECT 14, n = 300, abs(n - 300) FROM (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING')")
def audit_report(spark, d):
    news, pages = v_news(spark, d), t(spark, d, "pages")
    boxed = v_facility(spark, d).join(F.broadcast(v_box(spark, d)), "s")
    inside = geo.in_box(F.col("lat"), F.col("lng"), *[F.col(c) for c in ("south", "north", "west", "east")])
    return audit.report(
        audit.check(1, news, dates.in_future("date", F.lit("2025-01-30").cast("date"))), audit.check(2, news, text.bad_text_reason("headline") == "tag"), audit.duplicates(3, news, F.lower(F.trim("headline"))),
        audit.check(6, boxed, ~inside), audit.check(9, pages, F.col("url").isNull() | ~F.col("url").startswith("http")), audit.count_is(14, t(spark, d, "customer"), F.col("c_mktsegment") == "BUILDING", 300),
    )


@query("html_extract_literal", "SELECT page_id, list_sum(from_json('[' || page_id || ',' || page_id + 1 || ']', '[\"BIGINT\"]'))::BIGINT AS total FROM pages")
def html_extract_literal(spark, d):
    page = F.concat(F.lit("<script>const DATA = ["), F.col("page_id").cast("string"), F.lit(","), (F.col("page_id") + 1).cast("string"), F.lit("];</script>"), F.coalesce("html", F.lit("")))
    got = F.from_json(readers.embedded_literal(page, "DATA"), "array<bigint>")
    return t(spark, d, "pages").select("page_id", F.aggregate(got, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("html_splice", "SELECT page_id, '<p><!-- FEED_START -->$1 \\n new<!-- FEED_END --></p>' || coalesce(url, '') AS html FROM pages")
def html_splice(spark, d):
    page = F.concat(F.lit("<p><!-- FEED_START -->old\nrows<!-- FEED_END --></p>"), F.coalesce("url", F.lit("")))
    return t(spark, d, "pages").select("page_id", sinks.spliced(page, "FEED", "$1 \\n new").alias("html"))


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages""")
def html_escape(spark, d):
    return t(spark, d, "pages").select("page_id", text.html_escaped("html").alias("escaped"))


@query("json_largest_array", "SELECT event_id, '[' || event_id || ', [1, 2]]' AS found FROM events")
def json_largest_array(spark, d):
    said = F.concat(F.lit("so [x] and ["), F.col("event_id").cast("string"), F.lit(", [1, 2]] then [3] "), F.coalesce("props", F.lit("")))
    return t(spark, d, "events").select("event_id", readers.largest_json_array(said).alias("found"))


@query("geocode_location", "SELECT n_nationkey AS id, 30.0::DOUBLE + n_nationkey AS lat, -90.0::DOUBLE AS lng, CASE WHEN n_nationkey % 2 = 0 THEN 'narrow' ELSE 'wide' END AS zoom FROM nation")
def geocode_location(spark, d):
    n = F.col("n_nationkey")
    city = F.concat(F.lit("Town"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))
    rows = t(spark, d, "nation").select(n.alias("id"), F.when(n % 2 == 0, F.concat(city, F.lit(", Ohio"))).otherwise(F.concat(city, F.lit(", OH / Elsewhere, TX"))).alias("location"))
    places = t(spark, d, "nation").select(F.concat(city, F.lit(", OH")).alias("place"), (n + 30.0).alias("lat"), F.lit(-90.0).alias("lng"))
    parts = F.split("location", " / ")
    rows = rows.withColumn("location", F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(" | "), parts[1])).otherwise(F.col("location")))
    return geocode.geocoded(rows, places, {"ohio": "OH", "texas": "TX"}).select("id", "lat", "lng", "zoom")


@query("stream_late_drop", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1")
def stream_late_drop(spark, d):
    e = t(spark, d, "events")
    last = e.agg(F.max("ts").alias("m"))
    return e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 14 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_admit_dedupe", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_admit_dedupe(spark, d):
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return t(spark, d, "events").withColumn("r", first).where("r = 1").select("event_id", "user_id", "event_type")


# counts, options and batches -----------------------------------------------------------------------------------------
@query("facility_type_pivot", "SELECT p_brand AS ct, count(*) FILTER (p_size % 2 = 0) AS plant, count(*) FILTER (p_size % 2 = 1) AS pumper FROM part GROUP BY 1")
def facility_type_pivot(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, "plant").otherwise("pumper")
    return t(spark, d, "part").select(F.col("p_brand").alias("ct"), kind.alias("e")).groupBy("ct").pivot("e", ["plant", "pumper"]).count().na.fill(0)


@query("facility_top_owners", "SELECT p_brand AS owner, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, owner LIMIT 20")
def facility_top_owners(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("owner")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner").limit(20)


@query("verify_batches", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 15 AS batch FROM (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 300)")
def verify_batches(spark, d):
    """What is still to be asked about, up to a cap, in batches of 15; earlier results are left out."""
    left = t(spark, d, "documents").select(F.col("doc_id").alias("id")).join(t(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    return left.orderBy("id").limit(300).select("id", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / 15).alias("batch"))


@query("news_validate", f"SELECT id FROM ({NEWS_SQL}) WHERE id % 10 <> 3 AND NOT regexp_matches(headline, '</?[a-zA-Z][^>]*>')")
def news_validate(spark, d):
    news = v_news(spark, d).withColumns({"source_url": F.concat(F.lit("https://x.org/"), (F.col("id") % 10).cast("string")), "summary": F.lit("")})
    return ingest.validated_news(news, spark.createDataFrame([("https://x.org/3",)], "source_url string")).select("id")


@query("screener_regions", "SELECT DISTINCT r_name AS region FROM region")
def screener_regions(spark, d):
    return v_city(spark, d).select("region").distinct()


@query("facility_anti_plants", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier)")
def facility_anti_plants(spark, d):
    return v_facility(spark, d).select("id").join(v_plant(spark, d).select((F.col("id") * 3).alias("id")), "id", "left_anti")


@query("verdict_merge", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN 'UNCLEAR' WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'UNCLEAR' WHEN doc_id % 4 = 0 THEN 'CONFIRMED_FOG' WHEN doc_id % 4 = 1 THEN 'NOT_FOG' ELSE 'UNCLEAR' END AS classification, CASE WHEN doc_id % 4 = 3 THEN 'no verdict returned' WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'DEMOTED: said' ELSE 'said' END AS reason FROM documents")
def verdict_merge(spark, d):
    k = F.col("doc_id") % 4
    found = F.when(k == 0, "CONFIRMED_FOG").when(k == 1, "NOT_FOG").when(k == 2, "UNCLEAR")
    merged = facilities.merged_verdict(found, F.lit("said"), F.col("doc_id") % 3 == 0)
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), merged["classification"].alias("classification"), merged["reason"].alias("reason"))


@query("density_matrix", "SELECT n_nationkey AS row, 'zip' AS name, lpad(n_nationkey::VARCHAR, 5, '0') AS value FROM nation UNION ALL SELECT n_nationkey, 'estab', n_regionkey::VARCHAR FROM nation")
def density_matrix(spark, d):
    """A header-and-rows matrix, made of nations and read back as (row, name, value)."""
    rows = t(spark, d, "nation").select(F.struct("n_nationkey", F.array(F.lpad(F.col("n_nationkey").cast("string"), 5, "0"), F.col("n_regionkey").cast("string")).alias("r")).alias("s"))
    sent = rows.agg(F.to_json(F.concat(F.array(F.array(F.lit("zip"), F.lit("estab"))), F.transform(F.array_sort(F.collect_list("s")), lambda s: s["r"]))).alias("value"))  # 25 rows
    return readers.matrix(sent)
