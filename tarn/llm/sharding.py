"""Sharding by fixed virtual slots, in DataFrame functions only.

Records hash into SLOTS slots for good. A slot map says which shard holds each slot; it is a small table with a
version, and rebalancing or growing writes a new version that moves as few slots as it can. Version 1 deals the slots
out in turn. An edit keeps, in each shard, slots from the largest on while they fit the shard's fair share of the
bytes; what does not fit is released and goes, largest first, to whichever shard is the lightest then.

The map has exactly SLOTS rows whatever the input, so it may be broadcast and its edit may be one task's work.
Nulls: a null doc_id or text hashes as its own value and counts no bytes of text; empty tables give an empty result
(and a version 1 map). Rows that are equal in doc_id and text share a slot and are told apart by their position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import shared_dir, written

SLOTS = 8192


def slot_of(*key: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1, for the row itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_bytes(spark: SparkSession, sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes) for every slot, empty ones included; sized has (slot, size). Sums are made before the shuffle."""
    sums = sized.groupBy("slot").agg(F.sum("size").alias("bytes"))
    return spark.range(slots).select(F.col("id").cast("int").alias("slot")).join(sums, "slot", "left").na.fill(0, ["bytes"])


def first_map(bytes_of: DataFrame, shards: int) -> DataFrame:
    return bytes_of.select("slot", "bytes", F.pmod("slot", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("version"))


def _edited(current: DataFrame, shards: int, growing: bool) -> DataFrame:
    """The next version: released slots go to the lightest shard, or, when growing, all to the new one."""
    total = Window.partitionBy()
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    kept = current.withColumns({"_share": F.sum("bytes").over(total) / F.lit(shards), "_held": F.sum("bytes").over(largest_first)})
    kept = kept.withColumn("_released", (F.col("bytes") > 0) & (F.col("_held") > F.col("_share")))
    if growing:
        return kept.select("slot", "bytes", F.when(F.col("_released"), F.lit(shards - 1)).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))
    loads = kept.agg(
        F.array_sort(F.collect_list(F.when(F.col("_released"), F.struct((-F.col("bytes")).alias("minus"), F.col("slot").alias("slot"))))).alias("free"),
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.lit(0).cast("long")).alias("zero"),
        *[F.coalesce(F.sum(F.when(~F.col("_released") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("long").alias(f"load{k}") for k in range(shards)],
    )

    def lightest(held: Column) -> Column:
        return F.array_position(held, F.array_min(held)).cast("int") - 1

    def place(state: Column, free: Column) -> Column:
        to = lightest(state["held"])
        held = F.transform(state["held"], lambda load, k: F.when(k == to, load - free["minus"]).otherwise(load))
        return F.struct(held.alias("held"), F.concat(state["moves"], F.array(F.struct(free["slot"].alias("slot"), to.alias("to")))).alias("moves"))

    start = F.struct(F.array(*[F.col(f"load{k}") for k in range(shards)]).alias("held"), F.array().cast("array<struct<slot:int,to:int>>").alias("moves"))
    moves = loads.select(F.inline(F.aggregate("free", start, place, lambda state: state["moves"])))
    return current.join(F.broadcast(moves), "slot", "left").select("slot", "bytes", F.coalesce("to", "shard").cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def rebalanced(current: DataFrame, shards: int) -> DataFrame:
    """A new version of the map with near equal bytes; only slots above a shard's fair share move."""
    return _edited(current, shards, growing=False)


def grown(current: DataFrame, shards: int) -> DataFrame:
    """A new version for shards + 1 shards: the new one takes slots from all others, and no slot moves elsewhere."""
    return _edited(current, shards + 1, growing=True)


class SlotMap:
    """The stored versions of a slot map, one Parquet folder each; a version is never changed once written."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/tarn/slot_map-{uuid.uuid4().hex}"

    def store(self, version: int, rows: DataFrame) -> DataFrame:
        rows.coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, bytes long, shard int").parquet(f"{self.path}/version={version}").withColumn("version", F.lit(version))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and position (from 0, without gaps, in each shard).

    The position is the number of rows in the shard's earlier slots plus the place within the slot, so no task ever
    sorts more than a slot.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select("doc_id", text_bytes().alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), slot_of("doc_id", "text", slots=slots).alias("slot")),
        "sized",
    )
    store = SlotMap(spark, path)
    sizes = rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    one = store.store(1, first_map(slot_bytes(spark, rows, slots), shards))
    two = store.store(2, rebalanced(one, shards))
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = two.join(sizes.select("slot", "n"), "slot", "left").select("slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("_place", within - 1)
    return numbered.join(F.broadcast(placed), "slot").select(
        "doc_id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard", (F.col("first") + F.col("_place")).cast("long").alias("position")
    )
