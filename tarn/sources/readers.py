"""Readers: JSON arrays, optional files, CSV, header-and-rows matrices, literals inside HTML."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def optional_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An absent file is an empty table."""
    return json_array(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def wide_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All text, Latin-1, malformed lines left out, only the columns asked for."""
    return spark.read.csv(path, header=True, encoding="ISO-8859-1", mode="DROPMALFORMED").select(*columns)


def typed_csv(spark: SparkSession, path: str, casts: dict[str, str]) -> DataFrame:
    """Rows in which every cast succeeds."""
    rows = spark.read.csv(path, header=True).select(*[F.trim(c).try_cast(t).alias(c) for c, t in casts.items()])
    return rows.dropna(how="any")


def matrix(texts: DataFrame, column: str = "value") -> DataFrame:
    """(row, name, value) of a JSON array whose first row is the header."""
    parsed = texts.select(F.from_json(column, "array<array<string>>").alias("m"))
    header = parsed.select(F.col("m")[0].alias("h"), F.posexplode(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))).alias("row", "r"))
    return header.select("row", F.explode(F.arrays_zip(F.col("h").alias("name"), F.col("r").alias("value"))).alias("c")).select("row", "c.name", "c.value")


def embedded_literal(html: Column, name: str) -> Column:
    """The first `const NAME = [...];` of a page, as text; null without one."""
    return F.nullif(F.regexp_extract(html, rf"(?s)const {name} = (\[.*?\]);", 1), F.lit(""))


def page_parts(html: Column) -> Column:
    """struct(style, body, scripts) of a page; body is null where there is none."""
    body = F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit(""))
    return F.struct(F.regexp_extract(html, r"(?is)<style[^>]*>(.*?)</style>", 1).alias("style"), body.alias("body"), F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n").alias("scripts"))


def _largest(text: str | None) -> str | None:
    stack, spans = [], []
    for k, c in enumerate(text or ""):
        if c == "[":
            stack.append(k)
        elif c == "]" and stack:
            spans.append((stack.pop(), k + 1))
    for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        try:
            if isinstance(json.loads(text[a:b]), list):
                return text[a:b]
        except ValueError:
            continue
    return None


def _all_largest(texts: pd.Series) -> pd.Series:
    return texts.map(_largest)


def largest_json_array(texts: Column) -> Column:
    """The longest balanced [...] that parses to a list; brackets inside strings count like others."""
    return F.pandas_udf(_all_largest, StringType())(texts)
