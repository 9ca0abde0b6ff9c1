"""Raw items as they land: lines of JSON whose fields vary in type and number, and what is to be looked at by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.functions import text

# The fields of a raw item.
FIELDS = ("date", "headline", "source", "source_url", "category", "summary", "relevance_score", "is_deal", "buyer", "target", "sponsor", "location", "deal_size", "multiple", "deal_summary", "owner_classification", "date_confidence", "deal_type", "services")
_TYPED = ("relevance_score", "is_deal", "deal_summary")


def _text(item: Column, field: str) -> Column:
    return F.try_variant_get(item, f"$.{field}", "string")


def landed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines (value, ...) without value, but with `problem`, FIELDS and `extra`.

    A line is read as a variant, so a field may come as any type: deal_summary, a text or a list, becomes the list of its
    bullets, null without any; a score or flag that is none becomes null; other fields are texts. What the item holds
    beyond FIELDS goes to the map `extra`. `problem` is null, or tells why a line is no item: 'not JSON' (null and blank
    lines too) or 'no object'; all its fields are null then.
    """
    parsed = lines.withColumn("_item", F.try_parse_json(value))
    shape = F.schema_of_variant("_item")
    problem = F.when(F.col("_item").isNull(), "not JSON").when(~F.startswith(shape, F.lit("OBJECT")), "no object")
    item = F.when(problem.isNull(), F.col("_item"))
    listed = F.try_variant_get(item, "$.deal_summary", "array<string>")
    bullets = text.bullets(F.when(listed.isNull(), _text(item, "deal_summary")), listed)
    flag = F.lower(_text(item, "is_deal"))
    typed = {
        "relevance_score": F.trim(_text(item, "relevance_score")).try_cast("int"),
        "is_deal": F.when(flag.isin("true", "1", "yes"), True).when(flag.isin("false", "0", "no"), False),
        "deal_summary": F.when(F.size(bullets) > 0, bullets),
    }
    extra = F.map_filter(F.from_json(F.when(problem.isNull(), F.col(value)), "map<string,string>"), lambda k, _: ~k.isin(*FIELDS))
    kept = [c for c in lines.columns if c != value]
    return parsed.select(*kept, problem.alias("problem"), *[(typed[f] if f in _TYPED else _text(item, f)).alias(f) for f in FIELDS], F.when(F.size(extra) > 0, extra).alias("extra"))


def landing(spark: SparkSession, source: str, items: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Reads the files that are new in the folder `source`, once, into a folder a batch: items, and lines with their
    problem in the quarantine. A batch that is run again replaces its folders."""

    def store(batch: DataFrame, number: int) -> None:
        seen = landed(batch.withColumn("line", F.col("value")))
        seen.where("problem is null").drop("problem", "line").write.mode("overwrite").parquet(f"{items}/batch={number}")
        seen.where("problem is not null").select("line", "problem").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return spark.readStream.text(source).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
