"""Places from text: ordered fall-backs over a dimension of places, as one plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.sources.scratch import sent_if_small

# What makes a location vague.
VAGUE = ("/", "|", "multi-state", "multi state", "national", "nationwide", "northeast", "southeast", "midwest", "southwest", "northwest", "west coast", "east coast", "tri-state", "mid-atlantic", "new england", "upper midwest", "coastal", "southwestern")


# How a city and its state are written, and what stands between places.
CITY_STATE = r"([A-Za-z .'\-]+),\s*([A-Z]{2})\b"
SEPARATORS = ("/", "|", " and ", " & ")


def normal_state(location: Column, states: dict[str, str]) -> Column:
    """'City, Florida' as 'City, FL'."""
    tail = F.lower(F.trim(F.element_at(F.split(location, ","), -1)))
    code = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[tail]
    return F.when(location.contains(",") & code.isNotNull(), F.trim(F.concat(F.regexp_replace(location, ",[^,]*$", ", "), code))).otherwise(location)


def is_vague(location: Column) -> Column:
    low = F.lower(location)
    out = F.lit(False)
    for v in VAGUE:
        out = out | low.contains(v)
    return out | ~location.contains(",")


def named_state(location: Column, states: dict[str, str]) -> Column:
    """The code of the longest state's name (lower case in states) that the text holds as words, ties to the first by
    name; null without one. All names are looked for in one pass."""
    if not states:
        return F.lit(None).cast("string")
    names = sorted(states, key=lambda s: (-len(s), s))
    # at each place the longest name that begins there; names may overlap, so nothing is consumed
    there = F.regexp_extract_all(F.lower(location), F.lit(rf"\b(?=({'|'.join(re.escape(n) for n in names)})\b)"), F.lit(1))
    best = F.array_min(F.transform(there, lambda n: F.struct((-F.char_length(n)).alias("k"), n.alias("name"))))
    return F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[best["name"]]


def candidates(location: Column, states: dict[str, str]) -> Column:
    """Places that a text may mean, as an array of structs (place, zoom) in the order in which they count: the text with
    its state's code, the raw text, what closing brackets hold, what is before them, the parts at each of SEPARATORS,
    'City, ST' in either text, the last word of that city with the state, the state, the longest state's name, and
    each word that may be a state's code."""
    loc = F.trim(location)
    fixed = normal_state(loc, states)
    one = lambda c, zoom: F.struct(F.coalesce(F.trim(c), F.lit("")).alias("place"), (F.lit(zoom) if isinstance(zoom, str) else zoom).alias("zoom"))
    hint = F.when(is_vague(loc), "wide").otherwise("narrow")
    first = [one(fixed, hint), one(loc, hint)]
    for group in (2, 1):
        said = F.trim(F.regexp_extract(loc, r"^(.*?)\s*\((.+?)\)\s*$", group))
        # a state's code alone is no city
        first += [one(F.when(~said.rlike("^[A-Z]{2}$"), c), "narrow") for c in (normal_state(said, states), said)]
    none = F.array().cast("array<struct<place:string,zoom:string>>")
    parts = [F.when(F.contains(loc, F.lit(s)), F.transform(F.split(loc, re.escape(s)), lambda p: one(normal_state(F.trim(p), states), "wide"))).otherwise(none) for s in SEPARATORS]
    cities = []
    for said in (fixed, loc):
        city, state = F.trim(F.regexp_extract(said, CITY_STATE, 1)), F.regexp_extract(said, CITY_STATE, 2)
        for name in (city, F.element_at(F.split(city, r"\s+"), -1)):
            cities.append(one(F.when((name != "") & (state != ""), F.concat(name, F.lit(", "), state)), "narrow"))
        cities.append(one(state, "wide"))
    codes = F.transform(F.regexp_extract_all(loc, F.lit(r"\b([A-Z]{2})\b"), F.lit(1)), lambda c: one(c, "wide"))
    return F.concat(F.array(*first), *parts, F.array(*cities, one(named_state(loc, states), "wide")), codes)


def geocoded(rows: DataFrame, places: DataFrame, states: dict[str, str], key: str = "id") -> DataFrame:
    """rows (key, location) with lat, lng, zoom from the first of candidates() that `places` (place, lat, lng) knows;
    null without one. Places, unique by name, go to every task if they are few by count, else are joined by shuffle."""
    asked = rows.where("location is not null").select(key, F.posexplode(candidates(F.col("location"), states)).alias("ord", "c")).select(key, "ord", "c.place", "c.zoom").where("place != ''")
    hit = asked.join(sent_if_small(places), "place").groupBy(key).agg(F.min(F.struct("ord", "lat", "lng", "zoom")).alias("h"))
    return rows.join(hit.select(key, "h.lat", "h.lng", "h.zoom"), key, "left")


def by_city(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (id, location) with lat, lng of places (place, in lower case): the whole text, else the last word of its city
    with the state."""
    city, state = F.regexp_extract("location", CITY_STATE, 1), F.regexp_extract("location", CITY_STATE, 2)
    short = F.lower(F.concat(F.element_at(F.split(F.trim(city), r"\s+"), -1), F.lit(", "), state))
    asked = rows.withColumns({"_whole": F.lower(F.trim("location")), "_short": F.when(F.trim(city) != "", short)})
    of = lambda c: places.select(F.col("place").alias(c), F.struct("lat", "lng").alias(f"{c}_at"))
    out = asked.join(of("_whole"), "_whole", "left").join(of("_short"), "_short", "left").withColumn("_at", F.coalesce("_whole_at", "_short_at"))
    return out.select(*rows.columns, F.col("_at.lat").alias("lat"), F.col("_at.lng").alias("lng"))
