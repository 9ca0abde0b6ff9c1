"""Data-quality checks as one table: check_id, passed, n_bad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(check_id: int, rows: DataFrame, bad: Column, most: int = 0) -> DataFrame:
    """Rows for which bad holds, at most `most` of them."""
    n = F.count_if(F.coalesce(bad, F.lit(False)))
    return rows.agg(n.alias("n_bad")).select(F.lit(check_id).alias("check_id"), (F.col("n_bad") <= most).alias("passed"), F.col("n_bad").cast("long").alias("n_bad"))


def duplicates(check_id: int, rows: DataFrame, *key: Column) -> DataFrame:
    """Second and later rows of a key; blank keys don't count. Sums before the shuffle, no row is gathered."""
    blank = F.coalesce(F.concat_ws("", *key) == "", F.lit(True))
    counts = rows.where(~blank).groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad")).select(F.lit(check_id).alias("check_id"), (F.col("n_bad") == 0).alias("passed"), F.col("n_bad").cast("long").alias("n_bad"))


def count_is(check_id: int, rows: DataFrame, condition: Column, expected: int) -> DataFrame:
    return rows.agg(F.count_if(condition).alias("n")).select(F.lit(check_id).alias("check_id"), (F.col("n") == expected).alias("passed"), F.abs(F.col("n") - expected).cast("long").alias("n_bad"))


def report(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def several(rows: DataFrame, bad: dict[int, Column], never: tuple[int, ...] = ()) -> DataFrame:
    """Checks of one table in one pass: aggregates that count what is bad; those of `never` only inform."""
    one = rows.agg(*[c.cast("long").alias(str(k)) for k, c in bad.items()])
    each = F.array(*[F.struct(F.lit(k).alias("check_id"), (F.lit(True) if k in never else F.col(str(k)) == 0).alias("passed"), F.col(str(k)).alias("n_bad")) for k in bad])
    return one.select(F.explode(each).alias("c")).select("c.*")


def counts_by(check_id: int, rows: DataFrame, column: str) -> DataFrame:
    """(check_id, field, value, n): how many rows each value of a column has; "?" where there is none."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("?")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(check_id).alias("check_id"), F.lit(column).alias("field"), "value", "n")


def complete(check_id: int, rows: DataFrame, criteria: list[str], least: int) -> DataFrame:
    """At least so many rows, and every criterion of every one; n_bad: rows that lack one, and rows there are too few."""
    lacks = F.exists(F.array(*[F.col(c).isNull() for c in criteria]), lambda x: x)
    one = rows.agg((F.count_if(lacks) + F.greatest(least - F.count("*"), F.lit(0))).cast("long").alias("n_bad"))
    return one.select(F.lit(check_id).alias("check_id"), (F.col("n_bad") == 0).alias("passed"), "n_bad")


def weights_sum(weights: DataFrame, within: float = 0.001) -> DataFrame:
    """(profile, total, fine) of weights (profile, criterion, weight): whether a profile's weights sum to one."""
    out = weights.groupBy("profile").agg(F.round(F.sum("weight"), 9).alias("total"))
    return out.withColumn("fine", F.abs(F.col("total") - 1) <= within)


def weights_fine(check_id: int, weights: DataFrame, within: float = 0.001) -> DataFrame:
    return check(check_id, weights_sum(weights, within), ~F.col("fine"))


def counted_as(check_id: int, rows: DataFrame, metadata: DataFrame, field: str) -> DataFrame:
    """Whether a field of metadata (field, value) says how many rows there are; an absent field is wrong."""
    said = metadata.where(F.col("field") == field).agg(F.max("value").alias("said"))
    one = rows.agg(F.count("*").alias("n")).join(F.broadcast(said))  # a row each
    wrong = F.coalesce(F.abs(F.col("n") - F.col("said")), F.greatest("n", F.lit(1))).cast("long")
    return one.select(F.lit(check_id).alias("check_id"), (wrong == 0).alias("passed"), wrong.alias("n_bad"))
