"""What a feed has admitted so far, keyed so that a batch reads what it can match and no more.

Three tables grow by a folder a batch. `postings` (bucket, block, id) names the rows under every token of a headline, its
url, and the nouns of its day; `rows` (part, id, ...) has what matching compares. Both are partitioned by a hash, and
postings are sorted by block, so a lookup opens the buckets of its blocks and of these the row groups that hold them. A
batch looks up few blocks of a row: of the tokens of a headline the rarest in the history so far, as many as a match must
share one of, of its day's nouns all but three, and its url; whatever is admitted is listed under all of its own, so any
choice finds the same matches.

Folders are named by the batch's number and overwritten when it is run again; a reader takes those of smaller numbers
only, so a replay sees what the first run saw. Every COMPACT batches the earlier folders are written as one, without the
rows that eviction has dropped; a compacted folder counts once it is whole (its success mark is there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import dates
from tarn.operators import match
from tarn.operators.ingest import news_keys
from tarn.sources.readers import exists
from tarn.sources.scratch import written

BUCKETS, COMPACT, TOKENS, URLS, DAYS = 64, 16, "t:", "u:", "d:"
#: Keys of a batch that are sent to all tasks of a lookup, after a count; more are joined by shuffle.
SENT = 200_000
POSTINGS = "block string, id long, bucket int"
ROWS = "id long, url_key string, headline_key string, tokens array<string>, nouns array<string>, date string, part int"


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def blocks_of(keyed: DataFrame) -> DataFrame:
    """(id, block) of all that rows of news_keys() are listed under."""
    named = lambda prefix, c: F.transform(F.array_distinct(c), lambda x: F.concat(F.lit(prefix), x))
    day = F.transform(F.array_distinct("nouns"), lambda x: F.concat(F.lit(DAYS), "date", F.lit(":"), x))
    url = F.when(F.col("url_key") != "", F.array(F.concat(F.lit(URLS), "url_key")))
    none = F.array().cast("array<string>")
    every = F.concat(named(TOKENS, F.col("tokens")), F.coalesce(url, none), F.coalesce(F.when(F.col("date").isNotNull(), day), none))
    return keyed.where("headline_key != ''").select("id", F.explode(every).alias("block"))


class History:
    """The admitted rows under a path; keep_days: what is so much older than the newest date of a batch is forgotten
    (None: nothing is). Rows without a strict date stay."""

    def __init__(self, spark: SparkSession, path: str, keep_days: int | None = None):
        self.spark, self.path, self.keep_days = spark, path.rstrip("/"), keep_days

    def _folders(self, table: str, before: int) -> list[str]:
        """The newest whole compacted folder before this batch, and the batches after it."""
        done = [n for n in range(COMPACT, before + 1, COMPACT) if exists(self.spark, f"{self.path}/{table}/upto={n}/_SUCCESS")]
        first = max(done, default=0)
        single = [f"{self.path}/{table}/batch={n}" for n in range(first, before)]
        return [f"{self.path}/{table}/upto={first}"] * bool(first) + [f for f in single if exists(self.spark, f"{f}/_SUCCESS")]

    def _read(self, table: str, before: int) -> DataFrame:
        schema, out = POSTINGS if table == "postings" else ROWS, None
        for folder in self._folders(table, before):
            own = self.spark.read.schema(schema).parquet(folder)
            out = own if out is None else out.unionByName(own)
        return self.spark.createDataFrame([], schema) if out is None else out

    def postings(self, before: int) -> DataFrame:
        return self._read("postings", before)

    def looked_up(self, table: str, before: int, keys: DataFrame, by: str) -> DataFrame:
        """Rows of a table in the partitions of keys (by, ..), joined with them on all their columns but b."""
        parts = [r[0] for r in keys.select(by).distinct().collect()]  # BUCKETS at most
        return self._read(table, before).where(F.col(by).isin(parts)).join(_few(keys), [c for c in keys.columns if c != "b"])

    def rows(self, before: int) -> DataFrame:
        return self._read("rows", before)

    def matched(self, keyed: DataFrame, before: int) -> DataFrame:
        """(id) of keyed rows that match a row of earlier batches."""
        keyed = keyed.where("headline_key != ''")
        every = written(blocks_of(keyed).withColumn("bucket", _bucket(F.col("block"))), "blocks")
        listed = self.looked_up("postings", before, every.select("bucket", "block").distinct(), "bucket")
        counted = every.join(written(listed.groupBy("block").agg(F.count("*").alias("df")), "df"), "block", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        # the rarest first; what nothing is listed under needs no lookup but counts as looked up
        kind = F.substring("block", 1, 2)
        own = counted.groupBy("id", kind.alias("kind")).agg(F.array_sort(F.collect_list(F.struct("df", "block", "bucket"))).alias("b"))
        keep = F.when(F.col("kind") == TOKENS, F.size("b") - F.ceil(F.size("b") * F.lit(0.75) - 1e-9).cast("int") + 1).when(F.col("kind") == DAYS, F.size("b") - 3).otherwise(F.size("b"))
        looked = own.select("id", F.explode(F.slice("b", F.lit(1), F.greatest(keep, F.lit(0)))).alias("b")).where("b.df > 0")
        looked = written(looked.select(F.col("id").alias("b"), "b.bucket", "b.block"), "looked_up")
        pairs = self.looked_up("postings", before, looked, "bucket").select(F.col("id").alias("a"), "b").distinct()
        pairs = written(pairs.withColumn("part", _bucket(F.col("a"))), "old_pairs")
        known = self.looked_up("rows", before, pairs.select("part", F.col("a").alias("id")).distinct(), "part").drop("part")
        if self.keep_days is not None:
            known = known.where(self._kept(self._newest(keyed)))
        side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "url_key", "headline_key", "tokens", "nouns", "date")])
        both = pairs.join(side(known, "l"), F.col("a") == F.col("l_id")).join(side(keyed, "r"), F.col("b") == F.col("r_id"))
        two = lambda c: (F.col(f"l_{c}"), F.col(f"r_{c}"))
        return both.where(match.same_news(two("url_key"), two("headline_key"), two("tokens"), two("nouns"), two("date"))).select(F.col("b").alias("id")).distinct()

    def _newest(self, keyed: DataFrame) -> Column:
        return F.lit(keyed.agg(F.max(dates.iso_date("date"))).first()[0]).cast("date")

    def _kept(self, newest: Column) -> Column:
        return F.coalesce(dates.iso_date("date") >= F.date_sub(newest, self.keep_days), F.lit(True))

    def append(self, news: DataFrame, number: int) -> None:
        """Lists admitted news (id, headline, url, date) under its batch's number, and compacts when it is time."""
        keyed = written(news_keys(news).where("headline_key != ''"), "admitted")
        save = lambda df, table, by, order, name: df.repartition(by).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).parquet(f"{self.path}/{table}/{name}")
        save(blocks_of(keyed).withColumn("bucket", _bucket(F.col("block"))), "postings", "bucket", "block", f"batch={number}")
        save(keyed.withColumn("part", _bucket(F.col("id"))), "rows", "part", "id", f"batch={number}")
        if (number + 1) % COMPACT == 0:
            rows = self.rows(number + 1)
            if self.keep_days is not None:
                newest = rows.agg(F.max(dates.iso_date("date"))).first()[0]
                rows = rows.where(self._kept(F.lit(newest).cast("date")))
            postings = self.postings(number + 1)
            if self.keep_days is not None:
                postings = postings.join(rows.select("id"), "id", "left_semi")
            save(rows, "rows", "part", "id", f"upto={number + 1}")
            save(postings, "postings", "bucket", "block", f"upto={number + 1}")
