"""Search for a part of a name, layer by layer, through an index of the names' grams."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.plans import packs
from tarn.sources.scratch import sent_if_small, shared_dir, written

#: Characters of a posted gram, folders of postings, and how many terms one search may have, as they are sent to every task.
GRAM, PARTS, TERMS = 3, 32, 10_000


@dataclass
class NameIndex:
    """directory (gram, n, hit): for grams of 1 to GRAM characters the names that hold it and the first of them;
    postings (part, gram, hit): the names that hold a gram of GRAM characters, a folder a part."""

    directory: DataFrame
    postings: DataFrame


def _grams(low: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.char_length(low) - (n - 1))
    return F.when(F.char_length(low) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _part(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _hits(layers: list[tuple[DataFrame, str]], buckets: tuple[str, ...]) -> DataFrame:
    """(hit) of rows that have a name, to be ordered by layer, bucket and id."""
    names = None
    for rank, (rows, layer) in enumerate(layers):
        place = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket")) if "bucket" in rows.columns else F.lit(0)
        order = F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(len(buckets) + 1).cast("int")
        hit = F.struct(F.lit(rank).alias("layer_rank"), order.alias("bucket_rank"), F.col("id").cast("long").alias("id"), F.lit(layer).alias("layer"), F.col("name").alias("name"))
        own = rows.where("name != ''").select(hit.alias("hit"))
        names = own if names is None else names.unionByName(own)
    return names


def name_index(layers: list[tuple[DataFrame, str]], buckets: tuple[str, ...] = packs.BUCKETS) -> NameIndex:
    """Of rows (id, name, and bucket where the layer has them) by layer, first hits going by layer, bucket as listed, id.

    Rows without a name are not found; a bucket that isn't listed, or none, comes last. The directory is pre-aggregated,
    so a gram that most names hold is no task's burden; postings are written in folders that are split where they grow.
    """
    names = _hits(layers, buckets)
    low = F.lower("hit.name")
    every = F.concat(*[_grams(low, n) for n in range(1, GRAM + 1)])
    directory = written(names.select(F.explode(every).alias("gram"), "hit").groupBy("gram").agg(F.count("*").alias("n"), F.min("hit").alias("hit")), "directory")
    postings = names.select(F.explode(_grams(low, GRAM)).alias("gram"), "hit").withColumn("part", _part("gram"))
    path = f"{shared_dir(names.sparkSession)}/tarn/postings-{uuid.uuid4().hex}"
    postings.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(path)
    return NameIndex(directory, names.sparkSession.read.schema("gram string, hit " + names.schema["hit"].dataType.simpleString() + ", part int").parquet(path))


def first_hits(index: NameIndex, terms: DataFrame) -> DataFrame:
    """(term, layer, id, name): for each of terms (term), trimmed and in lower case, the first name that holds it.

    Terms of up to GRAM characters are answered by the directory. Of a longer one the rarest gram is looked up, and the
    names posted there are checked, so only the folders of such grams are read. Terms that are null, blank or found
    nowhere have no row; repeated terms have one. More than TERMS terms are an error.
    """
    asked = written(terms.select(F.lower(F.trim("term")).alias("term")).where("term != ''").distinct(), "terms")
    if asked.limit(TERMS + 1).count() > TERMS:
        raise ValueError(f"more than {TERMS} terms are to be searched in several runs")
    short = asked.where(F.char_length("term") <= GRAM).join(index.directory, F.col("term") == F.col("gram")).select("term", "hit")
    grams = asked.where(F.char_length("term") > GRAM).select("term", F.explode(_grams(F.col("term"), GRAM)).alias("gram"))
    rarest = index.directory.select("gram", "n").join(F.broadcast(grams), "gram", "right").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("least"))
    # a gram that no name holds rules its terms out
    rarest = written(rarest.where("least.n > 0").select("term", F.col("least.gram").alias("gram")).withColumn("part", _part("gram")), "rarest")
    parts = [r["part"] for r in rarest.select("part").distinct().collect()]  # at most PARTS
    met = index.postings.where(F.col("part").isin(parts)).join(F.broadcast(rarest), ["part", "gram"]).where(F.contains(F.lower("hit.name"), F.col("term")))
    long = met.groupBy("term").agg(F.min("hit").alias("hit"))
    return short.unionByName(long).select("term", "hit.layer", "hit.id", "hit.name")


def first_hits_of_all(layers: list[tuple[DataFrame, str]], terms: DataFrame, buckets: tuple[str, ...] = packs.BUCKETS) -> DataFrame:
    """first_hits() of a name_index() for any number of terms, as one pass through the names.

    The parts of all names that are as long as some term are joined by equality with the terms, so a term meets no name
    that doesn't hold it, and of these the first is kept before anything is shuffled.
    """
    asked = written(terms.select(F.lower(F.trim("term")).alias("term")).where("term != ''").distinct(), "terms")
    lengths = sorted(r["n"] for r in asked.select(F.char_length("term").alias("n")).distinct().collect())  # as many as a name has letters
    names = _hits(layers, buckets)
    longest = names.agg(F.max(F.char_length("hit.name"))).first()[0] or 0
    # rows of one name are one, the first of them; a letter may be longer in lower case
    names = written(names.groupBy(F.lower("hit.name").alias("low")).agg(F.min("hit").alias("hit")), "names")
    parts = F.flatten(F.array(F.array().cast("array<string>"), *[_grams(F.col("low"), n) for n in lengths if n <= 3 * longest]))
    met = names.select(F.explode(parts).alias("term"), "hit").join(sent_if_small(asked), "term", "left_semi")
    return met.groupBy("term").agg(F.min("hit").alias("hit")).select("term", "hit.layer", "hit.id", "hit.name")
