"""Nearest neighbours and radius joins on coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.geo import haversine_miles
from tarn.operators.order import placed
from tarn.sources.scratch import sent_if_small, written

#: Cells of the tree go to every task while plants are at most so many; beyond that both sides are shuffled by cell.
BROADCAST_ROWS = 20_000
#: Rows of one key, beyond which a join by key deals them to several tasks; there are at most rows / HOT_ROWS such keys.
HOT_ROWS = 100_000
#: Pairs of rows that a task of a radius join compares, about, and how many tasks there are at most.
TASK_PAIRS, MOST_TASKS = 20_000_000, 20_000
#: Miles a degree of a great circle, rounded up.
DEGREE = 69.2
#: Degrees that a cell of the tree's top is high, how many cells of the next level lie along its side, levels, and how
#: many plants a cell holds before it is split.
TOP, SPLIT, LEVELS, LEAF = 16.0, 4, 10, 64
#: Levels whose cells places are taken together by, as long as at most LEAF plants can be nearest in such a cell.
CELLS = (3, 5)


def spread(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by keys with a column _part to join by as well: a key with more than HOT_ROWS rows on the
    left has these dealt, by the hash of column `by`, to as many parts as it takes, each with all of the key's right rows."""
    hot = written(left.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).withColumn("_parts", F.ceil(F.col("count") / HOT_ROWS).cast("int")).drop("count"), "hot_keys")
    if hot.isEmpty():
        return left.withColumn("_part", F.lit(0)), right.withColumn("_part", F.lit(0))
    hot = F.broadcast(hot)
    left = left.join(hot, keys, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")))
    right = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_parts"), right.drop("_parts")


def _cells(lat: Column, lng: Column, level: int) -> dict[str, Column]:
    height = TOP / SPLIT**level  # a power of two, so that a cell lies in one of the level above
    return {"cy": F.floor(lat / height), "cx": F.floor((lng + 180.0) / height)}


def cell_tree(plants: DataFrame) -> list[DataFrame]:
    """The levels of a tree of cells over plants (np, p_lat, p_lng): (cy, cx, holds) with an array of structs (np, p_lat,
    p_lng, cy, cx), which are a leaf's plants or an inner cell's occupied parts.

    A cell with more than LEAF plants is split into SPLIT x SPLIT, so where plants are dense cells are small; no array
    follows the number of plants. Cells of the last level are cut into several rows instead.
    """
    todo, levels = plants, []
    for level in range(LEVELS):
        todo = todo.withColumns(_cells(F.col("p_lat"), F.col("p_lng"), level))
        counts = written(todo.groupBy("cy", "cx").count(), "cells")
        full = F.col("count") > (LEAF if level < LEVELS - 1 else 1 << 62)
        chunk = F.pmod(F.xxhash64("np", "p_lat", "p_lng"), F.ceil(F.col("count") / LEAF))
        held = F.struct("np", "p_lat", "p_lng", F.lit(None).cast("long").alias("cy"), F.lit(None).cast("long").alias("cx"))
        nodes = todo.join(counts.where(~full), ["cy", "cx"]).groupBy("cy", "cx", chunk).agg(F.collect_list(held).alias("holds")).select("cy", "cx", "holds")
        inner = counts.where(full).select("cy", "cx")
        if inner.isEmpty():
            levels.append(written(nodes, "tree"))
            break
        todo = written(todo.join(inner, ["cy", "cx"], "left_semi"), "dense_plants")
        lower = _cells(F.col("p_lat"), F.col("p_lng"), level + 1)
        parts = todo.select("cy", "cx", F.struct(*[F.lit(None).cast(plants.schema[c].dataType).alias(c) for c in ("np", "p_lat", "p_lng")], lower["cy"].alias("cy"), lower["cx"].alias("cx")).alias("part"))
        nodes = nodes.unionByName(parts.distinct().groupBy("cy", "cx").agg(F.collect_list("part").alias("holds")))
        levels.append(written(nodes, "tree"))
    return levels


def _bounds(level: int, around: float) -> Callable[[Column], Column]:
    """Of what a cell holds, plants or cells of the level, the least and most miles to a plant from where one may be that
    is at most `around` miles from (lat, lng)."""
    height = TOP / SPLIT**level
    radius = height * 0.5 * math.sqrt(2) * DEGREE  # no point of a cell is farther from its middle

    def of(c: Column) -> Column:
        plant = haversine_miles(F.col("lat"), F.col("lng"), c["p_lat"], c["p_lng"])
        middle = haversine_miles(F.col("lat"), F.col("lng"), (c["cy"] + 0.5) * height, (c["cx"] + 0.5) * height - 180.0)
        low, high = (F.when(c["cy"].isNull(), plant + s * around).otherwise(middle + s * (radius + around)) for s in (-1, 1))
        return F.struct(low.alias("low"), high.alias("high"), F.struct(c["np"].alias("np"), c["p_lat"].alias("p_lat"), c["p_lng"].alias("p_lng")).alias("plant"), c["cy"].alias("cy"), c["cx"].alias("cx"))

    return of


def with_nearest(rows: DataFrame, plants: DataFrame, key: str = "id") -> DataFrame:
    """rows (key, lat, lng, ...) with np, nd: id and miles of the nearest of plants (id, lat, lng), ties to the smallest id.

    Places go down a tree of cells (cell_tree): at each level one keeps those cells and plants that can be nearer than
    the farthest point of its nearest occupied cell, so it meets few plants wherever it is and however dense they are.
    Places go together by cells of CELLS, and by themselves only where plants are dense; so the descent's work is that
    of the cells. Of the top level there are at most 12 x 23 cells, in one broadcast row. Below it cells are joined by
    key, where a cell that many ask for is dealt to several tasks (spread). Rows that repeat are looked up once.

    Plants without coordinates or off the globe take no part, of plants at one place the smallest id counts. Rows
    without coordinates, and all rows where there are no plants, have null.
    """
    # plants without an id are nobody's nearest only where others are as near, as a null sorts first
    filed = plants.select(F.col("id").alias("np"), F.col("lat").cast("double").alias("p_lat"), F.col("lng").cast("double").alias("p_lng"))
    filed = written(filed.where("p_lat between -90 and 90 and p_lng between -180 and 180").groupBy("p_lat", "p_lng").agg(F.min("np").alias("np")), "plants")
    few = filed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    tree = cell_tree(filed)

    # rows of one place are looked up once, by cells of places first: what can be nearest to some place of a cell
    place = F.struct(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    places = written(rows.where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").select(place.alias("_at"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).distinct(), "places")
    left, found = places, []
    for level in CELLS:
        height = TOP / SPLIT**level
        cells = left.select("_at", F.struct(*[c.alias(n) for n, c in _cells(F.col("lat"), F.col("lng"), level).items()]).alias("cell"))
        middles = cells.select("cell").distinct().select(F.col("cell").alias("_at"), ((F.col("cell.cy") + 0.5) * height).alias("lat"), ((F.col("cell.cx") + 0.5) * height - 180.0).alias("lng"))
        can = written(_descended(middles, tree, few, height * 0.5 * math.sqrt(2) * DEGREE).select(F.col("_at").alias("cell"), F.col("plant.np").alias("np"), F.col("plant.p_lat").alias("p_lat"), F.col("plant.p_lng").alias("p_lng")), "can_be_nearest")
        easy = written(can.groupBy("cell").count().where(F.col("count") <= LEAF), "easy_cells").select("cell")
        met, own = spread(cells, can.join(easy, "cell", "left_semi"), ["cell"], "_at")
        d = haversine_miles(F.col("_at.lat"), F.col("_at.lng"), F.col("p_lat"), F.col("p_lng"))
        best = met.join(own, ["cell", "_part"]).groupBy("_at").agg(F.min(F.struct(d.alias("nd"), F.col("np"))).alias("best"))
        found.append(written(best, "found"))
        left = written(left.join(cells.join(easy, "cell", "left_anti").select("_at"), "_at", "left_semi"), "left")
    # what has many plants about it in the smallest cells goes down by itself
    one = _descended(left, tree, few, 0.0).groupBy("_at").agg(F.min(F.struct(F.col("low").alias("nd"), F.col("plant.np").alias("np"))).alias("best"))
    nearest = reduce(DataFrame.unionByName, [*found, one]).select("_at", F.col("best.np").alias("np"), F.col("best.nd").alias("nd"))
    return rows.withColumn("_at", place).join(nearest, "_at", "left").select(*rows.columns, "np", "nd")


def _descended(places: DataFrame, tree: list[DataFrame], few: bool, around: float) -> DataFrame:
    """(_at, low, plant) of places (_at, lat, lng) and those plants of the tree that can be the nearest to a point of at
    most `around` miles about the place; low: the least miles from there."""
    null = lambda c: F.lit(None).cast(tree[0].schema["holds"].dataType.elementType[c].dataType).alias(c)
    top = tree[0].select(F.struct(null("np"), null("p_lat"), null("p_lng"), "cy", "cx").alias("c")).distinct().agg(F.collect_list("c").alias("holds"))
    open_, found = places.select("_at", "lat", "lng").join(F.broadcast(top)).withColumn("_within", F.lit(float("inf"))), []
    for level in range(len(tree) + 1):
        # within one cell first, then over all of a row's cells; a thousandth of a mile covers rounding
        seen = open_.withColumn("_c", F.transform("holds", _bounds(level, around))).withColumn("_within", F.least("_within", F.array_min(F.transform("_c", lambda c: c["high"]))))
        seen = seen.withColumn("_c", F.explode(F.filter("_c", lambda c: c["low"] <= F.col("_within") + 0.001)))
        if level:  # at the top a row has one array
            seen = seen.withColumn("_within", F.min("_within").over(Window.partitionBy("_at"))).where(F.col("_c.low") <= F.col("_within") + 0.001)
        seen = written(seen.select("_at", "lat", "lng", "_within", "_c.low", "_c.plant", "_c.cy", "_c.cx"), "open_places")
        found.append(seen.where("cy is null").select("_at", "low", "plant"))
        if level == len(tree):
            break
        asked, nodes = seen.where("cy is not null").select("_at", "lat", "lng", "_within", "cy", "cx"), tree[level]
        if few:
            open_ = asked.join(F.broadcast(nodes), ["cy", "cx"])
        else:
            asked, nodes = spread(asked, nodes, ["cy", "cx"], "_at")
            open_ = asked.join(nodes, ["cy", "cx", "_part"]).drop("_part")
        open_ = open_.drop("cy", "cx")
    return reduce(DataFrame.unionByName, found)


def nearest_market(rows: DataFrame, markets: DataFrame, miles: float = 50, most: int = 10_000) -> DataFrame:
    """Adds is_target_market and target_market_name ("Market (12 mi)"); markets (name, lat, lng) is a dimension of at most
    `most` rows, sent along as one array, so rows are neither shuffled nor merged where they repeat."""
    if markets.limit(most + 1).count() > most:
        raise ValueError("markets are a small dimension")
    one = markets.agg(F.collect_list(F.struct(F.col("name").alias("np"), F.col("lat").alias("m_lat"), F.col("lng").alias("m_lng"))).alias("_markets"))
    out = rows.join(F.broadcast(one))
    near = F.array_min(F.transform("_markets", lambda m: F.struct(haversine_miles(F.col("lat"), F.col("lng"), m["m_lat"], m["m_lng"]).alias("d"), m["np"].alias("np"))))
    best = out.withColumn("_best", near)
    hit = F.coalesce(F.col("_best.d") <= miles, F.lit(False))
    return best.select(*rows.columns, hit.alias("is_target_market"), F.when(hit, F.concat("_best.np", F.lit(" ("), F.round("_best.d").cast("int").cast("string"), F.lit(" mi)"))).alias("target_market_name"))


def pairs_within(rows: DataFrame, others: DataFrame, miles: float, cell_miles: float | None = None, ordered: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, miles) of rows (id, lat, lng, *by) and others within the radius that have equal columns `by`, blocked by
    cells of that height; ordered: only a < b.

    Cells go round the globe and are as wide as the radius at 80 degrees of latitude; rows nearer to a pole are not for it.
    Pairs of a cell are counted first: there are as many tasks as they take by TASK_PAIRS, and a cell with more is dealt
    to several, so no task's time follows the tables.
    """
    step = (cell_miles or miles) / 69.0
    around = max(3, int(360 * 0.1736 / step))  # cells of at least that width
    column = lambda lng: F.floor((lng + 180.0) * (around / 360.0))
    keys = ["cy", "cx", *by]
    left = rows.select(F.col("id").alias("a"), "lat", "lng", *by, F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy")).withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    left = left.withColumns({"cy": F.floor(F.col("lat") / step) + F.col("dy"), "cx": F.pmod(column(F.col("lng")) + F.col("dx"), F.lit(around))}).drop("dy", "dx")
    right = others.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), *by).withColumns({"cy": F.floor(F.col("lat2") / step), "cx": F.pmod(column(F.col("lng2")), F.lit(around))})
    cells = left.groupBy(*keys).agg(F.count("*").alias("l")).join(right.groupBy(*keys).agg(F.count("*").alias("r")), keys).withColumn("pairs", F.col("l").cast("double") * F.col("r"))
    cells = written(cells, "cell_pairs")
    tasks = min(MOST_TASKS, 1 + int((cells.agg(F.sum("pairs")).first()[0] or 0) / TASK_PAIRS))
    hot = written(cells.where(F.col("pairs") > TASK_PAIRS).select(*keys, F.least(F.ceil(F.col("pairs") / TASK_PAIRS), F.col("l")).cast("int").alias("_parts")), "hot_cells")
    left, right = left.withColumn("_part", F.lit(0)), right.withColumn("_part", F.lit(0))
    if not hot.isEmpty():  # a table of at most the pairs / TASK_PAIRS cells
        left = left.join(sent_if_small(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64("a"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        right = right.join(sent_if_small(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    d = haversine_miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    fine = F.abs(F.col("lat") - F.col("lat2")) <= miles / 69.0  # a degree of latitude has more than 69 miles
    fine = (F.col("a") < F.col("b")) & fine if ordered else fine
    dealt = lambda df: df.repartition(tasks, *keys, "_part")
    return dealt(left).join(dealt(right), [*keys, "_part"]).where(fine & (d <= miles)).select("a", "b", d.alias("miles"))


def within_radius(rows: DataFrame, others: DataFrame, miles: float, cell_miles: float | None = None) -> DataFrame:
    """pairs_within() with a < b."""
    return pairs_within(rows, others, miles, cell_miles, ordered=True)


def renearest(rows: DataFrame, plant: tuple[str, float, float], miles: float = 30) -> DataFrame:
    """A new plant takes over where it is within the radius and nearer than the stored, rounded distance."""
    name, lat, lng = plant
    d = haversine_miles(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))
    take = (d <= miles) & (F.col("nd").isNull() | (d < F.col("nd")))
    return rows.withColumns({"np": F.when(take, F.lit(name)).otherwise(F.col("np")), "nd": F.when(take, F.round(d, 1)).otherwise(F.col("nd"))})


def first_hit(layers: list[tuple[DataFrame, str]], term: str) -> DataFrame:
    """Ordered fall-through search: the first row, by layer, then position, whose name holds the term in any case."""
    found = None
    for rank, (rows, layer) in enumerate(layers):
        own = rows.where(F.contains(F.lower("name"), F.lit(term.lower()))).select(F.lit(rank).alias("layer_rank"), F.lit(layer).alias("layer"), "id", "name")
        found = own if found is None else found.unionByName(own)
    return found.orderBy("layer_rank", "id").limit(1).select("layer", "id", "name")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """1-based position in the given order, kept through later filters."""
    return placed(rows, *order).withColumn("rank", F.col("rank").cast("int"))
