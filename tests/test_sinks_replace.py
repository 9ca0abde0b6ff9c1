"""Files that are replaced as a whole, and work that is done once."""

import pytest
from pyspark.sql import functions as F

from tarn.sources import sinks


def test_a_file_is_replaced_as_a_whole(spark, tmp_path):
    path = tmp_path / "out.csv"
    lines = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b,\"x\"")], "place long, line string")
    sinks.replaced_file(lines, f"file://{path}")
    assert path.read_text() == 'a\nb,"x"\nc\n'
    with pytest.raises(Exception, match="broken"):
        sinks.replaced_file(lines.withColumn("line", F.when(F.col("place") < 2, F.col("line")).otherwise(F.raise_error(F.lit("broken")).cast("string"))), f"file://{path}")
    assert path.read_text() == 'a\nb,"x"\nc\n'
    with pytest.raises(ValueError):
        sinks.replaced_file(lines, f"file://{path}", most=2)
    sinks.replaced_file(lines.where("place = 1"), f"file://{path}")
    assert path.read_text() == 'b,"x"\n' and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.csv"]


def test_work_that_died_is_done_again_and_finished_work_is_not(spark, tmp_path):
    did, manifest = [], f"file://{tmp_path}/done"

    def dies():
        did.append("dies")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.once(spark, manifest, "batch-1", dies)
    assert sinks.once(spark, manifest, "batch-1", lambda: did.append("works")) and not sinks.once(spark, manifest, "batch-1", lambda: did.append("again"))
    assert did == ["dies", "works"]
