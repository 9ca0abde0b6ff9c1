"""Verification of facilities around the verdicts: what is settled before asking, after it, and how it is listed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators.facilities import merged_verdict
from tarn.plans import fixed
from tarn.plans.rules import matches

VALID = ("CONFIRMED_FOG", "NOT_FOG", "UNCLEAR")
# How buckets are called where a record has no tier of its own.
TIERS = {"LOC": "Local / Family", "REG": "Regional Operator", "PE": "PE-Backed (Other)", "PUB": "Public Company"}


def any_of(c: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, p: a | matches(c, p), patterns, F.lit(False))


def tier_label(bucket: Column, own: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    label = F.coalesce(known[bucket], F.lit("Other"))
    return label if own is None else F.coalesce(F.nullif(own, F.lit("")), label)


def pre_classified(rows: DataFrame, names: Sequence[str] = fixed.CONFIRMED_NAMES, brands: Sequence[str] = fixed.CONFIRMED_BRANDS) -> DataFrame:
    """(id, classification, reason) of rows (id, bucket, n, op, ot) that need no verdict; the first reason counts."""
    by = F.concat_ws(" ", text.text("op"), text.text("ot"))
    reason = F.when(F.col("bucket") == "MUN", "auto: MUN bucket (municipal WWTP)").when(any_of(text.text("n"), names), "auto: facility name matches wastewater/septic pattern").when(any_of(by, brands), "auto: operator matches known FOG brand")
    out = rows.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "").select("id", F.lit("CONFIRMED_FOG").alias("classification"), reason.alias("reason"))
    return out.where("reason is not null")


def with_verdicts(rows: DataFrame, verdicts: DataFrame, branded: Column) -> DataFrame:
    """rows (id, ..) with classification and reason from verdicts (id, classification, reason, at).

    Ids are compared as texts; of several verdicts the last by `at` counts, summed up before the shuffle.
    """
    last = verdicts.groupBy(F.col("id").cast("string").alias("_id")).agg(F.max_by(F.struct("classification", F.coalesce("reason", F.lit("")).alias("reason")), "at").alias("v"))
    merged = merged_verdict(F.col("v.classification"), F.col("v.reason"), branded)
    out = rows.withColumn("_id", F.col("id").cast("string")).join(last, "_id", "left").withColumn("_m", merged)
    return out.select(*rows.columns, F.col("_m.classification").alias("classification"), F.col("_m.reason").alias("reason"))


def promoted(results: DataFrame, names: Sequence[str] = fixed.CONFIRMED_NAMES, brands: Sequence[str] = fixed.CONFIRMED_BRANDS) -> DataFrame:
    """results (.., name, operator, classification, reason) with what the whitelist knows confirmed after the fact."""
    open_ = F.coalesce(F.col("classification") != "CONFIRMED_FOG", F.lit(True))
    by_name, by_brand = open_ & any_of(text.text("name"), names), open_ & any_of(text.text("operator"), brands)
    reason = F.when(by_name, "auto: facility name matches FOG pattern (postprocess override)").when(by_brand, "auto: operator matches known FOG brand (postprocess override)").otherwise(F.col("reason"))
    return results.withColumns({"classification": F.when(by_name | by_brand, "CONFIRMED_FOG").otherwise(F.col("classification")), "reason": reason})


def to_rerun(results: DataFrame) -> DataFrame:
    return results.where(F.col("reason") == "no verdict returned")


def rerun(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """results with the second round's verdicts (id, classification, reason, at) for those without one; of several the
    last by `at` counts, if it is valid."""
    v = verdicts.groupBy(F.col("id").cast("string").alias("_id")).agg(F.max_by(F.struct("classification", "reason"), "at").alias("v")).where(F.col("v.classification").isin(*VALID))
    out = results.withColumn("_id", F.col("id").cast("string")).join(v, "_id", "left")
    again = (F.col("reason") == "no verdict returned") & F.col("v").isNotNull()
    said = F.concat(F.substring(text.text("v.reason"), 1, 200), F.lit(" (re-run)"))
    return out.withColumns({"classification": F.when(again, F.col("v.classification")).otherwise(F.col("classification")), "reason": F.when(again, said).otherwise(F.col("reason"))}).select(*results.columns)


def class_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(classification, before, after, delta) over the union of classes."""
    both = before.select("classification", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("classification", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupBy("classification").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.sum(F.col("a") - F.col("b")).alias("delta"))


def refuted(results: DataFrame, n: int = 20) -> DataFrame:
    """The report's list of refuted records: by tier, state, name, id."""
    return results.where("classification = 'NOT_FOG'").orderBy("tier", "state", "name", "id").limit(n)


def asked_line(name: Column, city: Column, state: Column, operator: Column) -> Column:
    """A record's line in a question: its operator only where that is another name."""
    other = F.upper(text.text(operator)) != F.upper(text.text(name))
    return F.concat(text.text(name), F.when(other & (text.text(operator) != ""), F.concat(F.lit(" (operator: "), operator, F.lit(")"))).otherwise(""), F.lit(" - "), text.text(city), F.lit(", "), text.text(state))
