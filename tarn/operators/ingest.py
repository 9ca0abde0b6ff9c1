"""From raw search results to news and deals: coercion, admission, archive, synthesis, digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import dates, text
from tarn.operators import match
from tarn.plans import packs, rules
from tarn.sources.scratch import sent_if_small, written


def normal_category(c: Column) -> Column:
    old = F.create_map(*[F.lit(x) for kv in packs.LEGACY_CATEGORIES.items() for x in kv])
    return F.when(c.isin(*packs.CATEGORIES), c).otherwise(F.coalesce(old[c], F.lit("Industry Events")))


def relevance(c: Column) -> Column:
    """1 to 5; what is no integer, and 0, is 3."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.nullif(c.try_cast("int"), F.lit(0)), F.lit(3))))


def coerced_news(raw: DataFrame, as_of: Column, patterns=packs.NEWS, max_age_days: int | None = 14) -> DataFrame:
    """Rows of raw (id, date, headline, source, source_url, category, summary, relevance_score, is_deal) that hold.

    Goes: no headline, no strict ISO date, too old, a front page as source. A future date is nulled and marked.
    """
    url = F.trim(text.text("source_url"))
    fine = (text.text("headline") != "") & dates.is_valid("date") & ~((url != "") & text.is_front_page("source_url"))
    if max_age_days is not None:
        fine = fine & ~dates.too_old("date", as_of, max_age_days)
    future = dates.in_future("date", as_of)
    marked = F.when(future & ~F.col("headline").startswith("[Date unverified]"), F.concat(F.lit("[Date unverified] "), "headline")).otherwise(F.col("headline"))
    clean = F.coalesce(F.nullif(text.without_tags(marked), F.lit("")), marked)
    summary = F.coalesce(text.without_tags("summary"), F.lit(""))
    category = normal_category(F.col("category"))
    return raw.where(fine).select(
        "id", F.when(~future, F.col("date")).alias("date"), clean.alias("headline"), text.text("source").alias("source"), url.alias("source_url"), category.alias("category"),
        rules.labels(F.concat_ws(" ", clean, summary), patterns, category).alias("categories"), summary.alias("summary"), relevance(F.col("relevance_score")).alias("relevance_score"), F.coalesce(F.col("is_deal"), F.lit(False)).alias("is_deal"),
    )


def coerced_deals(raw: DataFrame, as_of: Column, max_age_days: int = 14) -> DataFrame:
    """Deals of raw rows; unlike news, future dates stay as they are."""
    url = F.trim(text.text("source_url"))
    fine = F.coalesce("is_deal", F.lit(False)) & (text.text("buyer") != "") & (text.text("target") != "") & dates.is_valid("date") & ~dates.too_old("date", as_of, max_age_days) & ~((url != "") & text.is_front_page("source_url"))
    filled = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)
    absent = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c)
    return raw.where(fine).select(
        "id", "date", "target", F.col("buyer").alias("acquirer"), absent("sponsor", ""), absent("location", ""), absent("deal_type", "Add-On"), absent("deal_size", "Undisclosed"),
        filled("multiple", "N/A"), absent("services", ""), absent("source", ""), url.alias("source_url"), filled("owner_classification", "Unknown"), filled("date_confidence", "verified"),
        F.coalesce(text.without_tags("summary"), F.lit("")).alias("notes"),
    )


def news_keys(news: DataFrame) -> DataFrame:
    """What matching needs of news (id, headline, url, date)."""
    return news.select("id", text.normalized_url("url").alias("url_key"), text.normalized_headline("headline").alias("headline_key"), F.array_distinct(text.headline_tokens("headline")).alias("tokens"), text.proper_nouns("headline").alias("nouns"), "date")


def new_to(archive: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose normalised headline the archive doesn't hold yet; equal new ones all pass."""
    key = text.normalized_headline("headline")
    return rows.withColumn("_key", key).join(archive.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def action_verb(deal_type: Column) -> Column:
    t = F.lower(F.coalesce(deal_type, F.lit("")))
    return F.when(t.contains("merge"), "Merges With").when(t.contains("divest") | t.contains("carve"), "Acquires").when(t.contains("asset"), "Acquires Assets Of").when(t.contains("investment") | t.contains("majority") | t.contains("minority"), "Invests In").otherwise("Acquires")


#: Where the parts of the news end, of 256, that covered_deals() goes through one after another.
PARTS = (1, 4, 16, 64, 256)


def covered_deals(deals: DataFrame, news: DataFrame, days: int = 30, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """(id) of deals that some news covers: dates within days, and words of both target and acquirer in its text.

    Deals without usable names count as covered. A question is a word of each and a date, asked once however many deals
    ask it. The news are gone through in growing parts, all of them in the end, and what a part answers is not asked
    again: words that most news hold are settled by few. In a part the rarer word of the two is looked up, then the other.
    """
    d = deals.select("id", F.split(text.normalized_company("target"), " ").alias("t"), F.split(text.normalized_company("acquirer"), " ").alias("a"), F.col("date").alias("d_date"))
    d = d.withColumns({c: F.filter(c, lambda w: w != "") for c in ("t", "a")})
    usable = (F.size("t") > 0) & (F.size("a") > 0)
    ask = ["d_date", "t", "a"]
    asked = d.where(usable & F.col("d_date").isNotNull()).withColumn("t", F.explode(F.array_distinct("t"))).withColumn("a", F.explode(F.array_distinct("a"))).select("id", *ask)
    open_, place, begin = written(asked.select(*ask).distinct(), "asked"), F.pmod(F.xxhash64("id"), F.lit(parts[-1])), 0
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / max(days, 1))
    for end in parts:
        if open_.isEmpty():
            break
        part = news.where((place >= begin) & (place < end) & F.col("date").isNotNull())
        words = part.select(F.col("id").alias("n_id"), F.col("date").alias("n_date"), F.explode(F.array_distinct(F.split(text.normalized_company(F.concat_ws(" ", text.text("headline"), text.text("summary"))), " "))).alias("w"))
        wanted = open_.select(F.col("t").alias("w")).unionByName(open_.select(F.col("a").alias("w"))).distinct()
        words = written(words.join(sent_if_small(written(wanted, "wanted")), "w", "left_semi"), "words")
        held = written(words.groupBy("w").count(), "held")
        of = lambda c: held.select(F.col("w").alias(c), F.col("count").alias(f"{c}_n"))
        rows = open_.join(of("t"), "t").join(of("a"), "a")
        rows = rows.select(*ask, F.when(F.col("t_n") <= F.col("a_n"), F.col("t")).otherwise(F.col("a")).alias("w"), F.when(F.col("t_n") <= F.col("a_n"), F.col("a")).otherwise(F.col("t")).alias("other"))
        rows = rows.withColumn("k", F.explode(F.array(*[stretch("d_date") + k for k in (-1, 0, 1)])))
        met = rows.join(words.withColumn("k", stretch("n_date")), ["w", "k"]).where(dates.within(F.col("d_date"), F.col("n_date"), days)).select(*ask, "other", "n_id")
        hit = met.join(words.select("n_id", F.col("w").alias("other")), ["n_id", "other"], "left_semi").select(*ask).distinct()
        open_, begin = written(open_.join(hit, ask, "left_anti"), "asked"), end
    return asked.join(open_, ask, "left_anti").select("id").distinct().unionByName(d.where(~usable).select("id"))


def synthesized(deals: DataFrame, patterns=packs.NEWS) -> DataFrame:
    """News rows made of deals; the summary is the first that there is of bullets, notes, structured fields."""
    headline = F.trim(F.concat_ws(" ", F.trim(text.text("acquirer")), action_verb(F.col("deal_type")), F.trim(text.text("target"))))
    said = lambda c, label: F.when(text.text(c) != "", F.concat(F.lit(label), F.col(c)))
    sized = F.when(~F.col("deal_size").isin("Undisclosed", "N/A"), said("deal_size", "Size: "))
    fields = F.nullif(F.concat_ws(". ", said("location", "Location: "), said("deal_type", "Type: "), sized, said("sponsor", "Sponsor: ")), F.lit(""))
    last = F.concat_ws(" ", F.trim(text.text("acquirer")), F.lit("announced acquisition of"), F.concat(F.trim(text.text("target")), F.lit(".")))
    summary = F.coalesce(F.nullif(F.trim(F.array_join("deal_summary", " ")), F.lit("")), F.nullif(F.trim(text.text("notes")), F.lit("")), fields, last)
    return deals.select("id", "date", text.without_tags(headline).alias("headline"), F.lit("M&A").alias("category"), rules.labels(F.concat_ws(" ", headline, summary), patterns, F.lit("M&A")).alias("categories"), text.without_tags(summary).alias("summary"), F.lit(5).alias("relevance_score"), F.lit(True).alias("is_deal"))


def category_counts(news: DataFrame, categories=packs.CATEGORIES) -> DataFrame:
    """Every canonical category with its count, zero included."""
    dim = news.sparkSession.createDataFrame([(k, c) for k, c in enumerate(categories)], "ord int, category string")
    counts = news.groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "category", "left").select("ord", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def digest_mode(total: int, dropped: int, deals: int, deals_dropped: int) -> str:
    """maintenance if too much fell to validation, quiet if nothing is left, else digest."""
    if total and (dropped >= max(2, -(-total // 2)) or deals and deals_dropped == deals):
        return "maintenance"
    return "digest" if total - dropped > 0 else "quiet"


def validated_news(news: DataFrame, dead_urls: DataFrame) -> DataFrame:
    live = news.join(dead_urls.select("source_url").distinct(), "source_url", "left_anti")
    return live.where(text.bad_text_reason("headline", "summary").isNull())


def validated_deals(deals: DataFrame) -> DataFrame:
    """deals with `reason`: null where all is there and clean."""
    blank = (F.trim(text.text("date")) == "") | (F.trim(text.text("target")) == "") | (F.trim(text.text("acquirer")) == "")
    return deals.withColumn("reason", F.when(blank, "missing").otherwise(text.bad_text_reason("target", "acquirer", "location")))


def clustered(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (id, ...) with `cluster`, the smallest id reachable over pairs (a, b); singletons are their own."""
    from tarn.operators.components import components

    found = components(pairs.select("a", "b"))
    return rows.join(found, rows["id"] == found["node"], "left").select(*[rows[c] for c in rows.columns], F.coalesce("component", "id").alias("cluster"))


def admitted_news(batch: DataFrame, known: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Of batch (id, headline, url, date) what no function of `known` says (id of news_keys() rows) to be there already,
    and what matches no admitted earlier row of the batch."""
    keyed = written(news_keys(batch), "keyed")
    fresh = batch.where(text.normalized_headline("headline") != "")
    for matched in known:
        fresh = fresh.join(matched(keyed), "id", "left_anti")
    fresh = written(fresh, "fresh")
    pairs = match.news_pairs(keyed.join(fresh.select("id"), "id", "left_semi"))
    return fresh.join(match.admitted(fresh, pairs), "id", "left_semi")


def merged_batch(batch: DataFrame, feed: DataFrame, archive: DataFrame) -> DataFrame:
    """One incremental step: of batch (id, headline, url, date) what matches neither history nor an admitted earlier row.

    History is matched whole; a feed of many batches keeps it keyed (streaming.history). Ids are unique over all three.
    """
    columns = ("id", "headline", "url", "date")
    old = feed.select(*columns).unionByName(archive.select(*columns))

    def matched(keyed: DataFrame) -> DataFrame:
        pairs = match.news_pairs(keyed.unionByName(news_keys(old)))
        ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
        return ends.join(old.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()

    return admitted_news(batch.select(*columns), [matched])


def merged_deals(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """One step of deals: of batch (id, target_key, acquirer_key, date[, lat, lng]) what is no duplicate, (id).

    A deal whose target or acquirer has no name left is rejected, so that half-formed records stay out; so is one that
    matches a deal of existing, which is as it is, or an earlier admitted one. Ids are unique over both tables.
    """
    empty = (F.coalesce("target_key", F.lit("")) == "") | (F.coalesce("acquirer_key", F.lit("")) == "")
    batch = batch.where(~empty)
    index = match.DealIndex(batch.unionByName(existing))
    of = lambda ids: written(index.rows.join(ids, "id", "left_semi"), "part_deals")
    hit = lambda part, known: index.between(of(known), of(part)).select(F.col("r").alias("id")).distinct()
    return match.admitted_in_parts(batch.select("id"), existing.select("id"), lambda part: index.within(of(part)), hit)
