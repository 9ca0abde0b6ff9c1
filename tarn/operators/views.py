"""The interactive views: news, deals, layers, market screener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators.nearest import ranked
from tarn.operators.order import placed
from tarn.plans import packs


def news_view(news: DataFrame, category: str = "All", term: str = "", n: int = 100) -> DataFrame:
    """Newest first; category is compared by its key to any of `categories`, the term to headline or summary."""
    if category != "All":
        own = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array("category"))
        news = news.where(F.exists(own, lambda c: text.category_key(c) == text.category_key(F.lit(category))))
    if term:
        news = news.where(F.contains(F.lower("headline"), F.lit(term.lower())) | F.contains(F.lower("summary"), F.lit(term.lower())))
    return news.orderBy(F.coalesce("date", F.lit("1900-01-01")).desc(), "id").limit(n)


def platform(acquirer: Column, sponsor: Column) -> Column:
    a = F.lower(F.concat_ws(" ", acquirer, sponsor))
    return F.when(a.contains("wind river"), "Wind River").when(a.contains("liquid environmental") | a.contains("(les)") | a.rlike(r"^les\b"), "LES").when(a.contains("darling"), "Darling").when(a.contains("baker"), "Baker").otherwise("Other")


def deals_view(deals: DataFrame, deal_type: str = "", year: str = "", target_only: bool = False, term: str = "", sort: str = "date", descending: bool = True) -> DataFrame:
    if deal_type:
        deals = deals.where(F.col("deal_type") == deal_type)
    if year:
        own = F.substring("date", 1, 4).try_cast("int")
        deals = deals.where(own < 2020 if year == "Earlier" else own == int(year))
    if target_only:
        deals = deals.where("is_target_market")
    if term:
        hay = F.concat_ws(" ", *[text.text(c) for c in ("target", "acquirer", "sponsor", "location", "services", "notes")])
        deals = deals.where(F.contains(F.lower(hay), F.lit(term.lower())))
    key = text.text(F.col(sort).cast("string"))
    return deals.orderBy(key.desc() if descending else key.asc(), "id")


# The columns of a deal's export, in order.
EXPORT = ("date", "target", "acquirer", "sponsor", "location", "deal_type", "deal_size", "multiple", "services", "owner_classification", "source", "source_url", "is_target_market", "target_market_name", "deal_summary", "notes")


def csv_cell(c: Column, array: bool = False) -> Column:
    """Quoted only where a quote, comma or line end asks for it; an array's entries are joined by " | "."""
    c = F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), " | ") if array else c.cast("string"), F.lit(""))
    return F.when(c.rlike('["\n,]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def export_lines(shown: DataFrame, *order: Column, columns: tuple[str, ...] = EXPORT) -> DataFrame:
    """(place, line) of a filtered view's export: the head, 0, and a line a row in the given order. A column that the
    view lacks is empty."""
    kinds = dict(shown.dtypes)
    cells = [csv_cell(F.col(c), kinds[c].startswith("array")) if c in kinds else F.lit("") for c in columns]
    lines = placed(shown.withColumn("_line", F.concat_ws(",", *cells)), *order, name="place").select("place", F.col("_line").alias("line"))
    head = shown.sparkSession.createDataFrame([(0, ",".join(columns))], "place long, line string")
    return head.unionByName(lines)


def layer_counts(rows: DataFrame, buckets: list[str], state: str = "") -> DataFrame:
    """Visible rows per bucket, in display order, empty ones left out; rows (bucket, s, vs): refuted ones are hidden."""
    seen = rows.where(F.col("bucket").isin(*buckets) & (F.col("vs").isNull() | (F.col("vs") == "C")))
    if state:
        seen = seen.where(F.col("s") == state)
    order = F.array_position(F.array(*[F.lit(b) for b in packs.BUCKETS]), F.col("bucket"))
    return seen.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("ord", order)


def weighted_score(scores: dict[str, Column] | None, weights: tuple[float, ...], criteria: tuple[str, ...] = packs.CRITERIA) -> Column:
    """The sum in the criteria's order, as doubles: a left fold, so that every engine rounds alike."""
    out = F.lit(0.0)
    for c, w in zip(criteria, weights, strict=True):
        v = scores[c] if scores else F.col(c)
        out = out + F.coalesce(v.try_cast("double") * F.lit(w), F.lit(0.0))
    return out


def tier(score: Column) -> Column:
    return F.when(score >= 3.5, "A").when(score >= 3.0, "B").otherwise("C")


def screener_order(cities: DataFrame, key: str = "rank", descending: bool | None = None) -> list[Column]:
    """The order of a column: texts in lower case, "rank" by score; names and regions go up unless said, the rest down.
    Ties stay in the order of ids."""
    own = "score" if key == "rank" else key
    c = F.lower(own) if dict(cities.dtypes)[own] == "string" else F.col(own)
    down = key not in ("name", "region") if descending is None else descending
    return [c.desc() if down else c.asc(), F.col("id").asc()]


def scored(cities: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """cities with score and tier."""
    return cities.withColumn("score", weighted_score(None, weights)).withColumn("tier", tier(F.col("score")))


def screener(cities: DataFrame, weights: tuple[float, ...], region: str = "", status: str = "", least: float = 0.0, clear_only: bool = False, key: str = "rank", descending: bool | None = None) -> DataFrame:
    """cities with score, tier and rank; the rank is the place among all cities, by any column, before any filter."""
    out = scored(cities, weights)
    out = ranked(out, *screener_order(out, key, descending))
    if region:
        out = out.where(F.col("region") == region)
    if status or clear_only:
        out = out.where(F.col("status") == ("Clear" if clear_only else status))
    return out.where(F.col("score") >= least)


def contributions(cities: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """A row per city and criterion: contribution and width of its bar."""
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(c).alias("criterion"), F.col(c).alias("score"), F.lit(w).alias("weight")) for k, (c, w) in enumerate(zip(packs.CRITERIA, weights, strict=True))])
    out = cities.select("id", F.explode(each).alias("e")).select("id", "e.*")
    return out.select("id", "criterion", "score", (F.col("score") * F.col("weight")).alias("contribution"), F.round(F.col("score") * F.col("weight") / 1.5 * 100).cast("int").alias("bar"))
