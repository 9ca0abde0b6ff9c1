"""Queries with the whole rule packs, over names made of the tables' keys and the packs' own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import facilities, verification
from tarn.plans import fixed, packs, rules
from tarn.queries import NEWS_SQL, query, t, v_news

PHRASES = (*fixed.CONSOLIDATORS, *fixed.TREATMENT_WORKS, *fixed.NEGATIVE, *fixed.POSITIVE, *fixed.MUNICIPAL_STARTS, *fixed.MUNICIPAL_PARTS, "darling", "baker commodities", "tallow", "by-products", "smith meat co", "butcher", "poultry", "ingredients")
COLLECTOR_PHRASES = tuple(w for _, _, words in fixed.COLLECTOR_OWNERS for w in words) + fixed.COLLECTING + fixed.COLLECTING_WEAK + fixed.NOT_COLLECTING + fixed.NOT_COLLECTING_WORKS + ("city of", "municipal", "plumbing & drain")
NEWS_PHRASES = ("Acme acquires Bravo", "a merger of two", "tuck-in", "Darling Ingredients", "NASDAQ: ABC", "used cooking oil", "RIN prices", "RIN g", "RINs  Grow", "RIN", "FOG ordinance", "U.S. EPA", "consent decree", "smart trap", "route optimisation", "driver's pay", "OSHA", "restaurant chains", "ghost kitchen", "sewer overflow", "WEFTEC", "trade show", "net zero", "Scope 3 emissions", "nothing much")
VERIFIED_PHRASES = ("wastewater treatment", "grease trap", "Septic Tank", "sewer cleaners", "liquid waste haulers", "yellow  grease", "porta-potty", "biosolids", "rendering", "car wash", "Darling", "Dar Pro", "Veolia", "US Ecology", "SouthWaste", "Chucks Septic", "CST", "LES (Goldman Sachs)", "wrm", "Mcdonald Farm")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def phrase(values, key, factor: int):
    """A phrase by a key, the same in both engines (see phrase_sql)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key * factor % len(values) + 1).cast("int"))


def phrase_sql(values, key: str, factor: int) -> str:
    return f"({listed(values)})[{key} * {factor} % {len(values)} + 1]"


def any_part_sql(c: str, parts) -> str:
    return f"len(list_filter({listed(parts)}, lambda w: contains({c}, w))) > 0"


def any_pattern_sql(c: str, patterns) -> str:
    return f"regexp_matches({c}, {quoted('(?i)' + '|'.join(patterns))})"


P = packs.FACILITY
NAMED_SQL = f"SELECT p_partkey AS id, lower({phrase_sql(PHRASES, 'p_partkey', 7919)} || ' ' || p_name || ' ' || {phrase_sql(PHRASES, 'p_partkey', 104729)}) AS n, lower(p_brand || ' ' || p_type) AS own, CASE WHEN p_partkey % 17 = 0 THEN 'PE' ELSE p_type END AS ct, p_size % 5 AS kind FROM part"
FULL_CASCADE_SQL = f"""CASE WHEN ct IN {fixed.BRAND_CODES} OR {any_part_sql("n || ' ' || own", P.brands)} THEN 'kept_consolidator' WHEN {any_part_sql('n', P.treatment_works)} THEN 'dropped_treatment_works' WHEN len(list_filter({listed(P.municipal_starts)}, lambda w: starts_with(trim(n), w))) > 0 OR {any_part_sql('n', P.municipal_parts)} THEN 'dropped_municipal' WHEN {any_part_sql('n', P.negative)} AND NOT {any_part_sql('n', P.positive)} THEN 'dropped_negative' WHEN kind = 0 THEN 'kept_562991' WHEN kind = 1 AND {any_pattern_sql("n || ' ' || own", fixed.RENDERERS)} THEN 'kept_311613_brand' WHEN kind = 1 AND {any_pattern_sql('n', fixed.RENDERING)} THEN 'kept_311613_term' WHEN kind = 1 AND {any_pattern_sql('n', fixed.MEAT)} THEN 'dropped_311613_meat' WHEN kind = 1 THEN 'kept_311613' WHEN kind = 2 THEN 'kept_562219' WHEN kind = 3 AND {any_part_sql('n', P.positive)} THEN 'kept_562111_positive' WHEN kind = 3 THEN 'dropped_562111' WHEN {any_part_sql('n', P.positive)} THEN 'kept_positive' ELSE 'dropped_no_signal' END"""


@query("facility_cascade_full", f"SELECT id, {FULL_CASCADE_SQL} AS rule FROM ({NAMED_SQL})")
def facility_cascade_full(spark, d):
    key = F.col("p_partkey")
    codes = F.element_at(F.array(*[F.lit(c) for c in ("562991; 1", "2,311613", "562219", "562111;3", "9")]), F.col("p_size") % 5 + 1)
    name = F.concat_ws(" ", phrase(PHRASES, key, 7919), "p_name", phrase(PHRASES, key, 104729))
    rows = t(spark, d, "part").select(key.alias("id"), name.alias("n"), F.col("p_brand").alias("op"), F.col("p_type").alias("ot"), F.when(key % 17 == 0, "PE").otherwise(F.col("p_type")).alias("ct"), codes.alias("na"))
    return rows.select("id", facilities.cascade().alias("rule"))


FAMILIES_SQL = "(VALUES " + ", ".join(f"({k}, {quoted(code)}, {quoted(kind)}, {quoted(parent)}, {quoted(chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')})" for k, (code, kind, parent, p) in enumerate((f[0], f[1], f[2], p) for f in fixed.FAMILIES for p in f[3])) + ") f(k, code, kind, parent, pattern)"
REGISTRY_SQL = f"SELECT c_custkey::VARCHAR AS i, {phrase_sql(PHRASES, 'c_custkey', 7919)} || ' of ' || c_name || ' ' || {phrase_sql(PHRASES, 'c_custkey', 104729)} AS n, CASE c_custkey % 4 WHEN 0 THEN '562991' WHEN 1 THEN '9;562219' ELSE '' END AS na, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE (10 + c_custkey % 60)::VARCHAR || '.5' END AS lat, '-' || (60 + c_custkey % 100)::VARCHAR || '.25' AS lng FROM customer"


@query("facility_supplements", f"WITH r AS (SELECT *, lower(n) AS low FROM ({REGISTRY_SQL}) WHERE i::BIGINT % 3 <> 0 AND try_cast(lat AS DOUBLE) > 17 AND try_cast(lat AS DOUBLE) < 72 AND try_cast(lng AS DOUBLE) > -180 AND try_cast(lng AS DOUBLE) < -64) SELECT i, parent AS op, kind AS ot, code AS ct, CASE WHEN contains(na, '562219') OR {any_part_sql('low', fixed.PLANT_WORDS)} THEN 'plant' WHEN na = '562991' OR {any_part_sql('low', fixed.PUMPER_WORDS)} THEN 'pumper' ELSE 'plant' END AS e, lat::DOUBLE AS la FROM r JOIN {FAMILIES_SQL} ON regexp_matches(n, '(?i)' || pattern) QUALIFY row_number() OVER (PARTITION BY i ORDER BY k) = 1")
def facility_supplements(spark, d):
    key = F.col("c_custkey")
    name = F.concat(phrase(PHRASES, key, 7919), F.lit(" of "), "c_name", F.lit(" "), phrase(PHRASES, key, 104729))
    naics = F.when(key % 4 == 0, "562991").when(key % 4 == 1, "9;562219").otherwise("")
    lat = F.when(key % 11 == 0, "x").otherwise(F.concat((key % 60 + 10).cast("string"), F.lit(".5")))
    rows = t(spark, d, "customer").select(key.cast("string").alias("i"), name.alias("n"), naics.alias("na"), lat.alias("lat"), F.concat(F.lit("-"), (key % 100 + 60).cast("string"), F.lit(".25")).alias("lng"))
    return facilities.supplements(rows, rows.where(key % 3 == 0).select("i")).select("i", "op", "ot", "ct", "e", "la")


OWNERS_SQL = "(VALUES " + ", ".join(f"({k}, {quoted(parent)}, {quoted(kind)}, {quoted(w)})" for k, (parent, kind, w) in enumerate((o[0], o[1], w) for o in fixed.COLLECTOR_OWNERS for w in o[2])) + ") f(k, parent, kind, word)"


@query("facility_collectors", f"WITH r AS (SELECT s_suppkey AS id, {phrase_sql(COLLECTOR_PHRASES, 's_suppkey', 7919)} || ' ' || s_name AS n, s_suppkey % 5 = 0 AS coded FROM supplier), k AS (SELECT *, lower(n) AS low FROM r), c AS (SELECT * FROM k WHERE (coded OR {any_part_sql('low', [w for w in fixed.COLLECTING if w not in fixed.COLLECTING_WEAK])} OR {any_part_sql('low', fixed.COLLECTING_WEAK)} AND {any_part_sql('low', fixed.COLLECTING_STRONG)}) AND NOT {any_pattern_sql('n', fixed.NOT_COLLECTING_MUNICIPAL)} AND NOT {any_part_sql('low', fixed.NOT_COLLECTING_WORKS)} AND NOT {any_part_sql('low', fixed.NOT_COLLECTING)}) SELECT id, coalesce(parent, n) AS op, coalesce(kind, 'Independent') AS o FROM c LEFT JOIN {OWNERS_SQL} ON contains(low, word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1")
def facility_collectors(spark, d):
    key = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select(key.alias("id"), F.concat_ws(" ", phrase(COLLECTOR_PHRASES, key, 7919), "s_name").alias("n"), F.when(key % 5 == 0, "1; 562991").otherwise("2").alias("na"))
    owner = facilities.collector_owner(F.col("n"))
    return rows.where(facilities.is_collector()).withColumn("_o", owner).select("id", F.col("_o.parent").alias("op"), F.col("_o.type").alias("o"))


# boundaries are those of ASCII there, so other letters become an x first; the one look ahead is said without looking
AHEAD = (r"\b(?!\s*g)", r"(?:$|[^\w\s]|\s+(?:[^\sgG]|$))")
SQL_NEWS = [(category, [a.replace(*AHEAD) for a in alternatives]) for category, alternatives in fixed.NEWS]
FULL_LABELS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {any_pattern_sql('body', alternatives)} THEN {quoted(category)} END" for category, alternatives in SQL_NEWS) + "], lambda x: x IS NOT NULL)"


@query("news_classify_full", f"SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE 'Industry Events' END AS categories FROM (SELECT id, {FULL_LABELS_SQL} AS l FROM (SELECT id, regexp_replace({phrase_sql(NEWS_PHRASES, 'id', 7919)} || ' ' || headline || ' ' || summary || ' ' || {phrase_sql(NEWS_PHRASES, 'id', 104729)}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{M}}\\p{{C}}]', 'x', 'g') AS body FROM ({NEWS_SQL})))")
def news_classify_full(spark, d):
    body = F.concat_ws(" ", phrase(NEWS_PHRASES, F.col("id"), 7919), "headline", "summary", phrase(NEWS_PHRASES, F.col("id"), 104729))
    return v_news(spark, d).select("id", F.array_join(rules.labels(body, packs.NEWS), "|").alias("categories"))


PRE_FULL_SQL = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'auto: MUN bucket (municipal WWTP)' WHEN {any_pattern_sql('n', fixed.CONFIRMED_NAMES)} THEN 'auto: facility name matches wastewater/septic pattern' WHEN {any_pattern_sql('op', fixed.CONFIRMED_BRANDS)} THEN 'auto: operator matches known FOG brand' END AS reason FROM (SELECT c_custkey, {phrase_sql(VERIFIED_PHRASES, 'c_custkey', 7919)} || ' ' || c_name AS n, c_mktsegment || ' ' || {phrase_sql(VERIFIED_PHRASES, 'c_custkey', 104729)} AS op FROM customer)"


@query("verify_pre_classify_full", f"SELECT id, 'CONFIRMED_FOG' AS classification, reason FROM ({PRE_FULL_SQL}) WHERE reason IS NOT NULL")
def verify_pre_classify_full(spark, d):
    key = F.col("c_custkey")
    rows = t(spark, d, "customer").select(key.alias("id"), F.when(key % 9 == 0, "MUN").otherwise("XX").alias("bucket"), F.concat_ws(" ", phrase(VERIFIED_PHRASES, key, 7919), "c_name").alias("n"), F.col("c_mktsegment").alias("op"), phrase(VERIFIED_PHRASES, key, 104729).alias("ot"))
    return verification.pre_classified(rows)
