"""Nearest neighbours by cosine with cross-polytope hashing.

Each table turns unit vectors twice, with three rounds of random signs and a fast Hadamard transform each, and files a
vector under the pair of signed axes it comes closest to; of longer vectors the first AXES coordinates count. A query
looks into the PROBES pairs of every table whose axes are closest to it together, and in the first table goes on until
EXACT_ROWS vectors are met, so that tables of up to so many are searched whole; this holds at any size. What it meets is
ranked exactly, on the original vectors, within the bucket of the first axis, so that only `k + 1` candidates a bucket
and query leave it. Buckets and the queries that look into them are dealt into blocks of BLOCK rows, so a hot one is
many tasks' work.

Vectors that are null, zero, hold null or non-finite components, or have another length than most (the longest of these
if several are as frequent) take no part. Equal vectors count as one while searching: of each, the k + 1 smallest ids
are kept, which is all any answer can hold, and the answer goes to every query that has the vector; a query with several
vectors asks with each, and the best answers stay. Ties go to the smaller id; of rows that share an id and a vector one
is kept. Other columns, whatever their names, are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import map_batches, written

TABLES, PROBES, BLOCK, EXACT_ROWS, AXES, SEED = 10, 352, 4096, 2048, 64, 11
_FOUND = "key long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of x, whose length is a power of two; up to a factor."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """x, padded to a power of two, under the table's pseudo-rotation."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.Generator(np.random.PCG64([seed, table])).choice([-1.0, 1.0], (3, size))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(size)
    return x


def both_axes(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the closeness to every signed axis, under the table's two rotations."""
    turned = [rotated(x, 2 * table + k)[:, :AXES] for k in (0, 1)]
    return tuple(np.concatenate((t, -t), axis=1) for t in turned)


def usable(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _filed(vectors: DataFrame, tables: int, kind: str) -> DataFrame:
    """A row for each table: bucket (the table and the first axis), second (axis), id, vector."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _scaled(_matrix(batch.column(1)))
        pairs = [[v.argmax(axis=1) for v in both_axes(x, t)] for t in range(tables)]
        bucket = np.concatenate([one + t * 2 * AXES for t, (one, _) in enumerate(pairs)])
        rows = pa.array(np.tile(np.arange(len(x)), tables))
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.concatenate([two for _, two in pairs]).astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["bucket", "second", "id", "vector"])

    return map_batches(vectors, run, f"bucket int, second int, id long, vector array<{kind}>")


def _asked(queries: DataFrame, tables: int, probes: int, least: int, sizes: np.ndarray) -> DataFrame:
    """A row for each table and first axis that a query probes: bucket, seconds (a byte each), id.

    sizes: vectors filed under each (bucket, second axis).
    """
    sent = queries.sparkSession.sparkContext.broadcast(sizes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, bucket, seconds, row = _scaled(_matrix(batch.column(1))), [], [], []
        for t in range(tables):
            one, two = both_axes(x, t)
            held = sent.value[2 * AXES * t : 2 * AXES * (t + 1)]
            for q in range(len(x)):
                close = (one[q][:, None] + two[q])[: len(held)]
                best = np.argpartition(-close, min(probes, close.size) - 1, axis=None)[:probes]
                if not t and held.ravel()[_flat(best, close.shape, held.shape)].sum() < least:
                    best = np.argsort(-close, axis=None, kind="stable")
                    best = best[: max(probes, int(np.searchsorted(np.cumsum(held.ravel()[_flat(best, close.shape, held.shape)]), least)) + 1)]
                first, second = np.divmod(best, close.shape[1])
                full = held[first, second] > 0
                order = np.argsort(first[full], kind="stable")
                first, second = first[full][order], second[full][order].astype(np.uint8)
                for own in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first)) + 1) if len(first) else ():
                    bucket.append(first[own[0]] + t * 2 * AXES)
                    seconds.append(second[own].tobytes())
                    row.append(q)
        rows = pa.array(np.array(row, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.array(bucket, np.int32)), pa.array(seconds, pa.binary()), batch.column(0).take(rows)], names=["bucket", "seconds", "id"])

    return map_batches(queries, run, "bucket int, seconds binary, id long")


def _flat(at: np.ndarray, shape: tuple[int, int], other: tuple[int, int]) -> np.ndarray:
    """Flat places of one shape as those of a wider one."""
    first, second = np.divmod(at, shape[1])
    return first * other[1] + second


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(queries: np.ndarray, seconds: list[bytes], others: np.ndarray, second: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of others under the second axes that a query probes, the k of largest cosine, ties to smaller ids: query rows,
    ids, scores."""
    order = np.lexsort((ids, second))
    others, ids = others[order], ids[order]
    first = np.searchsorted(second[order], np.arange(2 * AXES + 1))
    unit, asked = _scaled(others), _scaled(queries)
    rows, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for q, probed in enumerate(seconds):
        met = np.concatenate([np.arange(first[s], first[s + 1]) for s in probed])
        if not len(met):
            continue
        rough = unit[met] @ asked[q]
        if len(met) > k:  # the product's rounding doesn't decide
            met = met[rough >= np.partition(rough, -k)[-k] - 1e-9]
        exact = cosines(np.broadcast_to(queries[q], (len(met), queries.shape[1])), others[met])
        best = np.lexsort((ids[met], -exact))[:k]
        rows.append(np.full(len(best), q))
        found.append(ids[met[best]])
        scores.append(exact[best])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _search(index: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, kind: str) -> DataFrame:
    filed = _filed(index, tables, kind)
    counts = filed.groupBy("bucket", "second").count().toArrow()  # as many rows as tables have buckets
    sizes = np.zeros((tables * 2 * AXES, 2 * AXES), np.int64)
    sizes[counts["bucket"].to_numpy(), counts["second"].to_numpy()] = counts["count"].to_numpy()
    asked = written(_asked(queries, tables, probes, max(EXACT_ROWS, k), sizes), "probes")
    spark = index.sparkSession
    blocks = spark.createDataFrame([(b, int(-(-n // BLOCK))) for b, n in enumerate(sizes.sum(axis=1)) if n], "bucket int, blocks int")
    asking = asked.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asking"))  # a row a bucket
    blocks = F.broadcast(blocks.join(asking, "bucket"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    filed = filed.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", every("asking"))
    asked = asked.join(blocks, "bucket").withColumn("block", every("blocks")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("asking")).cast("int")).join(queries.select("id", "vector"), "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        rows, ids, scores = nearest(_matrix(left["vector"].combine_chunks()), left["seconds"].to_pylist(), _matrix(right["vector"].combine_chunks()), right["second"].to_numpy(), right["id"].to_numpy(), k)
        return pa.table({"key": left["id"].to_numpy()[rows], "vec_id": ids, "score": scores})

    task = ("bucket", "block", "part")
    pairs = asked.select(*task, "seconds", "id", "vector").groupBy(*task).cogroup(filed.select(*task, "second", "id", "vector").groupBy(*task)).applyInArrow(run, _FOUND)
    pairs = pairs.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k)


def neighbours(table: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of table that is_query, the k nearest other rows."""
    own = table.schema[vector].dataType.elementType.simpleString()
    kind = own if own == "float" else "double"  # floats are shuffled as such, and compared as doubles
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable("vector"))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("vector") == F.lit(lengths["size"] if lengths else 0)).withColumn("key", F.xxhash64("vector"))
    # ranks beyond k + 1 are cut off before the shuffle (WindowGroupLimit), so a vector that many rows have is no one task's
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    index = written(rows.dropDuplicates(["vec_id", "vector"]).withColumn("place", place).where(F.col("place") <= k + 1).select(F.col("vec_id").alias("id"), "vector"), "vectors")
    asking = rows.where("asks").select("vec_id", "key", "vector")
    asked = written(asking.groupBy("key").agg(F.first("vector").alias("vector")).select(F.col("key").alias("id"), "vector"), "asked")
    found = written(_search(index, asked, k + 1, tables, probes, kind), "found")
    others = asking.select("key", F.col("vec_id").alias("query_id")).distinct().join(found.select("key", "vec_id", "score"), "key").where(F.col("query_id") != F.col("vec_id"))
    others = others.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
