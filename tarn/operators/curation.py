"""Curating what is published: files deduplicated together, operators coerced and written short, digests, page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import ingest, match
from tarn.operators.nearest import DEGREE, pairs_within, with_nearest
from tarn.sources.scratch import sent_if_small, written


def deduplicated_files(feed: DataFrame, archive: DataFrame, score: Column) -> DataFrame:
    """Both files' rows (id, headline, url, date, first_seen_date, ..) with `file`, of each cluster the best by score.

    Ties go to the feed, then the smaller id. A missing first_seen_date is the row's date, or 2000-01-01. Ids are a file's
    own: rows of both files may share one.
    """
    both = feed.withColumn("file", F.lit("feed")).unionByName(archive.withColumn("file", F.lit("archive"))).withColumn("_score", score)
    both = both.withColumns({"_id": F.col("id"), "id": F.concat_ws(":", "file", F.col("id").cast("string"))})
    pairs = match.news_links(ingest.news_keys(both))
    best = match.survivors(ingest.clustered(both, pairs), "cluster", F.desc("_score"), F.desc("file"), F.col("_id"))
    best = best.withColumn("id", F.col("_id")).drop("_id")
    seen = F.coalesce(F.nullif(F.col("first_seen_date"), F.lit("")), F.nullif(F.col("date"), F.lit("")), F.lit("2000-01-01"))
    return best.withColumn("first_seen_date", seen).drop("_score", "cluster")


def known_operators(rows: DataFrame, existing: DataFrame, miles: float = 5.0, threshold: float = 0.7) -> DataFrame:
    """(id, known) of rows (id, n, lat, lng): known where coordinates or a name are missing, or where an existing operator
    within the radius shares enough of the words of both names."""
    key = lambda df: df.select("id", "lat", "lng", text.normalized_operator("n").alias("key"))
    own, other = key(rows), key(existing).where("lat is not null and lng is not null and key != ''")
    usable = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0) & (F.col("key") != "")
    words = lambda c: F.array_distinct(F.split(c, " "))
    # names first: an operator is asked only for those whose name is alike, so no rows meet that can't be the same
    names = lambda df: written(df.select("key").distinct().withColumn("words", words("key")), "keys")
    mine, theirs = names(own.where(usable)), names(other)
    tokens = match.prefix_tokens(mine.unionByName(theirs).distinct(), "key", "words", threshold)
    met = mine.select("key").join(tokens, "key").join(theirs.select(F.col("key").alias("k")).join(tokens.withColumnRenamed("key", "k"), "k"), "token").select("key", "k").distinct()
    alike = written(met.where(match.jaccard(words("key"), words("k")) >= threshold), "alike")
    asked = written(own.where(usable).join(sent_if_small(alike), "key").select("id", "lat", "lng", "k"), "asked")
    answers = written(other.withColumnRenamed("key", "k").join(sent_if_small(alike.select("k").distinct()), "k", "left_semi"), "answers")
    # in a cell no wider than the radius from corner to corner everyone is near; who finds nobody there asks about it
    side = miles / DEGREE / 1.5
    cell = [F.floor(F.col(c) / side).alias(f"c{c}") for c in ("lat", "lng")]
    same = written(asked.select("id", "k", *cell).join(answers.select("k", *cell).distinct(), ["k", "clat", "clng"], "left_semi").select("id").distinct(), "same_cell")
    pairs = pairs_within(asked.join(same, "id", "left_anti"), answers, miles, by=("k",))
    hit = same.unionByName(pairs.select(F.col("a").alias("id"))).distinct().withColumn("hit", F.lit(True))
    return own.join(hit, "id", "left").select("id", (~usable | F.coalesce("hit", F.lit(False))).alias("known"))


def coerced_operators(raw: DataFrame, metro: str = "metro") -> DataFrame:
    """Operators of raw (id, name, address, city, state, latitude, longitude, services, size, metro); rows without a name
    or with coordinates that are no numbers go. A missing city or state is that of the "City, ST" searched for."""
    name, lat, lng = F.trim(text.text("name")), F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    given = lambda c, part: F.coalesce(F.nullif(F.col(c), F.lit("")), F.trim(F.element_at(F.split(metro, ","), part))).alias(c[0])
    blank = lambda c: F.nullif(F.trim(text.text(c)), F.lit(""))
    rows = raw.where((name != "") & lat.isNotNull() & lng.isNotNull())
    return rows.select("id", name.alias("n"), blank("address").alias("ad"), given("city", 1), given("state", -1), F.round(lat, 5).alias("la"), F.round(lng, 5).alias("lo"), name.alias("op"), F.lit("Independent").alias("o"), F.lit("web_search").alias("src"), blank("services").alias("_services"), blank("size").alias("_size"))


def short_record(columns: dict[str, Column], optional: tuple[str, ...], numbers: tuple[str, ...] = ("la", "lo", "nd")) -> Column:
    """A record as JSON under short keys: nulls are empty texts, but empty optional ones are left out, and so are
    numbers that there are none of."""
    kept = lambda k, c: F.nullif(c.cast("string"), F.lit("")) if k in optional else c if k in numbers else F.coalesce(c.cast("string"), F.lit(""))
    return F.to_json(F.struct(*[kept(k, c).alias(k) for k, c in columns.items()]), {"ignoreNullFields": "true"})


def dead_urls(rows: DataFrame, status: DataFrame, url: str = "source_url") -> DataFrame:
    """Distinct urls of rows whose check (url, status) failed: 400, 404, 410, or no answer at all; unchecked ones pass."""
    urls = rows.where(text.text(url) != "").select(F.col(url).alias("url")).distinct()
    last = status.groupBy("url").agg(F.max(F.coalesce("status", F.lit(0))).alias("status"))
    return urls.join(last, "url").where(F.col("status").isin(0, 400, 404, 410)).select("url")


def nearest_marker(rows: DataFrame, layers: list[tuple[str, DataFrame]], miles: float = 16093 / 1609.344) -> DataFrame:
    """(id, layer, marker, miles) for rows (id, lat, lng, zoom): the nearest marker of all layers (id, lat, lng) within
    the radius; wide views ask for none. Ties go to the earlier layer, then the smaller id."""
    narrow, out = rows.where(F.coalesce(F.col("zoom") != "wide", F.lit(True))), None
    for rank, (layer, markers) in enumerate(layers):
        own = with_nearest(narrow.select("id", "lat", "lng"), markers).where(F.col("nd") < miles).select("id", F.col("nd").alias("miles"), F.lit(rank).alias("rank"), F.col("np").alias("marker"), F.lit(layer).alias("layer"))
        out = own if out is None else out.unionByName(own)
    best = out.groupBy("id").agg(F.min(F.struct("miles", "rank", "marker", "layer")).alias("m"))
    return best.select("id", "m.layer", "m.marker", "m.miles")


def subject(today: str, deals: Column, new_today: Column, recent: Column) -> Column:
    """The digest's subject line: deals win the suffix, a day without anything is quiet."""
    head = F.lit(f"Industry Briefing — {today}")
    suffix = F.when(deals > 0, F.concat(F.lit(" ("), deals.cast("string"), F.when(deals == 1, " New Deal)").otherwise(" New Deals)"))).when((new_today == 0) & (recent == 0), " (Quiet Day)").when(new_today == 0, " (Recent Updates)").otherwise("")
    return F.concat(head, suffix)


def run_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(added, gone, kept) by id: what a run changed, as one row to keep."""
    both = before.select("id", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("id", F.lit(0).alias("b"), F.lit(1).alias("a"))).groupBy("id").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return both.agg(F.count_if(F.expr("a > b")).alias("added"), F.count_if(F.expr("a < b")).alias("gone"), F.count_if(F.expr("a = b")).alias("kept"))


def prefixed_labels(rows: DataFrame, label: str, prefix: str = "Public:") -> DataFrame:
    """Counts of the labels with the prefix, and their sum under TOTAL."""
    own = rows.where(F.col(label).startswith(prefix))
    return own.rollup(label).agg(F.count("*").alias("n")).select(F.coalesce(label, F.lit("TOTAL")).alias("label"), "n")


def without_console_log(script: Column) -> Column:
    """Lines that are one console.log statement are emptied; warnings and errors stay."""
    return F.regexp_replace(script, r"(?m)^\s*console\.log\([^;]*\);\s*$", "")


def occurrences(c: Column, part: str) -> Column:
    """How often the part comes in the text, without overlap."""
    own = F.coalesce(c, F.lit(""))
    return ((F.length(own) - F.length(F.replace(own, F.lit(part)))) / len(part)).cast("long")


def padded(c: Column, width: int) -> Column:
    """Cut or filled up with blanks to the width."""
    return F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, width), width, " ")


def spliced_block(page: Column, start: str, end: str, inner: Column) -> Column:
    """page with its first block from start to end replaced, literally, the markers kept; an error where there is none."""
    low = F.instr(page, F.lit(start))
    rest = F.substr(page, low + len(start))
    at = F.instr(rest, F.lit(end))
    made = F.concat(F.substr(page, F.lit(1), low + len(start) - 1), F.lit("\n"), inner, F.lit("\n"), F.substr(rest, at))
    return F.when((low > 0) & (at > 0), made).otherwise(F.raise_error(F.lit("the page has no such pair of markers")))
