"""Writers: JSON and CSV files, and text spliced into pages between markers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def csv_export(df: DataFrame, path: str) -> None:
    """Arrays joined by ' | ', quotes doubled."""
    flat = df.select(*[F.concat_ws(" | ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


#: Lines that one file may have, as one task writes it.
FILE_LINES = 5_000_000


def replaced_file(lines: DataFrame, path: str, most: int = FILE_LINES) -> None:
    """One text file of lines (place, line), in the order of place, put where an older one may be.

    It is written beside it and then renamed over it, in one step of the file system, so whoever reads sees the old file
    or the new one, and a run that dies leaves the old one. More than `most` lines are an error; they belong in a folder.
    """
    if lines.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} lines are not for one file")
    spark = lines.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    beside = hadoop.Path(f"{path}.writing-{uuid.uuid4().hex}")
    files = beside.getFileSystem(conf)
    try:
        lines.repartition(1).sortWithinPartitions("place").select("line").write.text(beside.toString())
        part = next(s.getPath() for s in files.listStatus(beside) if s.getPath().getName().startswith("part-"))
        overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        hadoop.FileContext.getFileContext(beside.toUri(), conf).rename(part, hadoop.Path(path), overwrite)
    finally:
        files.delete(beside, True)


def once(spark: SparkSession, manifest: str, name: str, do: Callable[[], None]) -> bool:
    """do(), unless a manifest folder says that it was done to the end before; says whether it ran."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    mark = hadoop.Path(f"{manifest.rstrip('/')}/{name}")
    files = mark.getFileSystem(conf)
    if files.exists(mark):
        return False
    do()
    files.create(mark, True).close()
    return True


def spliced(html: Column, marker: str, inner: Column | str) -> Column:
    """html with what is between <!-- MARKER_START --> and <!-- MARKER_END --> replaced, literally; unchanged without them."""
    m = re.escape(marker)
    start, end = rf"<!--\s*{m}_START\s*-->", rf"<!--\s*{m}_END\s*-->"
    inner = F.lit(inner) if isinstance(inner, str) else inner
    head = F.regexp_extract(html, rf"(?s)^(.*?{start}).*?{end}", 1)
    tail = F.regexp_extract(html, rf"(?s)^.*?{start}.*?({end}.*)$", 1)
    return F.when(html.rlike(rf"(?s){start}.*?{end}"), F.concat(head, inner, tail)).otherwise(html)


def filled_template(template: Column, values: dict[str, Column | str]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit(f"__{name}__"), F.lit(value) if isinstance(value, str) else value)
    return template


def screener_state(weights: Column, strategy: Column, edits: Column) -> Column:
    """The state as base64 of JSON, as a link carries it; read_state reads it back."""
    return F.base64(F.to_json(F.struct(weights.alias("weights"), strategy.alias("strategy"), edits.alias("edits"))).cast("binary"))


def read_state(encoded: Column) -> Column:
    return F.from_json(F.unbase64(encoded).cast("string"), "weights map<string,double>, strategy string, edits map<string,map<string,int>>")
