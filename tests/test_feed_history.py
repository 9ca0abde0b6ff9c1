"""The feed with keyed history on real streams, against the batch operator gone through step by step."""

import random

from pyspark.sql import functions as F

from tarn.operators import ingest
from tarn.sources.scratch import written
from tarn.streaming import feed, history

NEWS = "id long, headline string, url string, date string"


def some_news(rng, n, first=0):
    words = "Acme Bravo City Delta Energy Florida Grease Harbor Iowa Joins Kansas Launches Merger Northern Ordinance Plant".split()
    return [(first + k, " ".join(rng.sample(words, rng.randint(3, 6))) if rng.random() > 0.05 else "", rng.choice(["", f"http://x.org/{rng.randrange(15)}"]), f"2026-01-{rng.randint(1, 28):02d}") for k in range(n)]


def landed(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, NEWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(NEWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def stepwise(spark, batches, archive):
    out = spark.createDataFrame([], NEWS)
    for rows in batches:
        out = written(out.unionByName(ingest.merged_batch(spark.createDataFrame(rows, NEWS), out, archive)), "stepwise")
    return sorted(r["id"] for r in out.collect())


def test_feed_equals_the_batch_operator_and_replays_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "COMPACT", 2)
    rng = random.Random(3)
    batches = [some_news(rng, 14, 100 * k) for k in range(5)]
    batches[3].append((399, *batches[0][1][1:]))  # a late row that repeats one of the first batch
    archive = spark.createDataFrame(some_news(rng, 6, 1000), NEWS)
    path, check = f"{tmp_path}/feed", f"file://{tmp_path}/check"
    run = lambda: feed.run_feed(landed(spark, tmp_path, []), path, archive, check).awaitTermination(300)
    landed(spark, tmp_path, batches[:3])
    run()
    landed_more = [(k, rows) for k, rows in enumerate(batches) if k >= 3]
    for k, rows in landed_more:
        spark.createDataFrame(rows, NEWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    run()
    got = sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert got == stepwise(spark, batches, archive) and 399 not in got
    run()
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == got
    assert history.exists(spark, f"{path}/_history/postings/upto=4/_SUCCESS")


def test_a_batch_that_runs_again_sees_what_it_saw(spark, tmp_path):
    kept = history.History(spark, f"file://{tmp_path}/h")
    first = spark.createDataFrame([(1, "Acme buys Bravo Rendering", "", "2026-01-01")], NEWS)
    kept.append(first, 0)
    again = ingest.news_keys(spark.createDataFrame([(7, "Acme buys Bravo Rendering", "", "2026-02-01"), (8, "Another thing", "", None)], NEWS))
    assert [r["id"] for r in kept.matched(again, 1).collect()] == [7]
    kept.append(spark.createDataFrame([(7, "Something else entirely now", "", "2026-02-01")], NEWS), 1)
    assert [r["id"] for r in kept.matched(again, 1).collect()] == [7] and kept.matched(again, 0).count() == 0


def test_old_rows_are_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "COMPACT", 2)
    kept = history.History(spark, f"file://{tmp_path}/h", keep_days=30)
    kept.append(spark.createDataFrame([(1, "Acme buys Bravo Rendering", "", "2026-01-01"), (2, "Dateless thing happens here", "", None)], NEWS), 0)
    kept.append(spark.createDataFrame([(3, "City adopts new ordinance", "", "2026-03-01")], NEWS), 1)
    assert sorted(r["id"] for r in kept.rows(2).collect()) == [2, 3] and kept.postings(2).where("id = 1").count() == 0
    soon = lambda day: ingest.news_keys(spark.createDataFrame([(9, "Acme buys Bravo Rendering", "", day)], NEWS))
    assert kept.matched(soon("2026-01-20"), 1).count() == 1 and kept.matched(soon("2026-03-20"), 1).count() == 0


def test_a_lookup_reads_the_buckets_of_its_blocks(spark, tmp_path):
    kept = history.History(spark, f"file://{tmp_path}/h")
    kept.append(spark.createDataFrame(some_news(random.Random(4), 200), NEWS), 0)
    keys = spark.createDataFrame([("t:acme",)], "block string").withColumn("bucket", history._bucket(F.col("block")))
    found = kept.looked_up("postings", 1, keys, "bucket")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and {r["block"] for r in found.collect()} == {"t:acme"}


def test_windows_take_the_callers_watermark(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-05 00:00:00", "b")], "id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp")).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp, kind string").json(f"{tmp_path}/in")
    counts = feed.windowed_counts(feed.deduplicated(stream, ["id"], "ts", "1 day"), "ts", "1 hour", None, "kind")
    counts.writeStream.format("memory").queryName("windowed").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r[1], r[2]) for r in spark.table("windowed").collect()] == [("a", 1)]
