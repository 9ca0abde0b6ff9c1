"""The incremental path as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.ingest import admitted_news
from tarn.sources.readers import exists
from tarn.sources.scratch import written
from tarn.streaming.history import History


def late_dropped(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay)


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str = "14 days") -> DataFrame:
    """Exact duplicates within the watermark go; state is dropped with it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, window: str, delay: str | None, *keys: str) -> DataFrame:
    """Rows of each window and keys. delay None: events have a watermark already, and a stream has one."""
    events = events if delay is None else events.withWatermark(time, delay)
    return events.groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def run_feed(landing: DataFrame, feed_path: str, archive: DataFrame, checkpoint: str, keep_days: int | None = None) -> StreamingQuery:
    """Micro-batches of (id, headline, url, date): of each, what matches neither the archive, nor what earlier batches
    admitted, nor an earlier admitted row of its own goes to feed_path, in a folder of its own.

    What was admitted is kept by history.History under feed_path/_history, which a batch looks up by its own keys. Its
    first entry is the archive, listed once. Everything is named by the batch's number and overwritten when it is run
    again, so a restart repeats nothing. keep_days: matches so much older than a batch's newest row count no more.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        history = History(spark, f"{feed_path}/_history", keep_days)
        known = History(spark, f"{feed_path}/_archive", keep_days)
        if not exists(spark, f"{feed_path}/_archive/rows/batch=0/_SUCCESS"):
            known.append(archive.select("id", "headline", "url", "date"), 0)
        batch = written(batch.select("id", "headline", "url", "date"), "batch")
        new = admitted_news(batch, [lambda keyed: known.matched(keyed, 1), lambda keyed: history.matched(keyed, number)])
        new.write.mode("overwrite").parquet(f"{feed_path}/batch={number}")
        history.append(spark.read.schema(new.schema).parquet(f"{feed_path}/batch={number}"), number)

    return landing.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
