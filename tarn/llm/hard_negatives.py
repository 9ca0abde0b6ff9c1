"""Hard negatives by a pivot table.

Each component x becomes floor(SCALE * x); a score is the integer inner product with the anchor. With M the longest of
all vectors, a vector v gets the coordinate sqrt(M^2 - |v|^2) more and an anchor q a zero, which makes the squared
distance |q|^2 + M^2 - 2 score, so that larger scores are smaller distances. The pivot table holds every vector's
distances to PIVOTS pivots. By the triangle inequality the differences and sums of an anchor's and a vector's pivot
distances bracket their distance, and so their score. What the brackets leave is scored exactly.

Pivots are taken from a sample of at most 2 * SAMPLE vectors, each the farthest from those before it; only the width of
the brackets follows from them. A vector lies in the cell of its nearest pivot. Cells, of which there are PIVOTS, are
dealt into blocks of about BLOCK rows by a hash of the id, and so are a block's anchors, so no label, cell or group of
equal vectors is one task's. Round one finds each anchor's positives: it searches the blocks of its label, and of these
first the anchor's own cell, then the cells whose ring of pivot distances admits a score that beats the least found.
Round two searches the cells whose rings admit the least score that any of the anchor's positives allows.

Rows with a null id, label or vector, with null or non-finite components, or of another length than most (the longest of
these if several are as frequent) take no part. Rows of one id and label and vector count once; an anchor's other rows
have other ids. Rows that share an id but differ are compared each. Ties go to the smaller id, then the smaller label. A
score beyond 64 bits is held to their range; scores are exact in that range, whatever the components. An anchor without
positives, or a positive without negatives in its range, gives no row. Other columns, whatever their names, are passed
over. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import map_batches, sampled, written

SCALE, PIVOTS, SAMPLE, BLOCK = 256, 16, 2000, 4096
#: What is taken off and put on a bracket for the rounding of distances, as a share of the squared lengths.
SLACK = 1e-9


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of integers that are held as doubles, within the range of 64 bits."""
    most = np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) * max(1, rows.shape[1])
    if most < 1 << 53:
        return (rows @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    sums = (sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in rows)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)


def farthest(x: np.ndarray, many: int) -> np.ndarray:
    """So many rows of x, the first one and then always the one farthest from those taken; fewer if x has fewer."""
    taken, far = [0], np.full(len(x), np.inf)
    while len(taken) < min(many, len(x)):
        far = np.minimum(far, np.sqrt(((x - x[taken[-1]]) ** 2).sum(axis=1)))
        taken.append(int(far.argmax()))
    return x[taken]


class Pivots:
    """points: of one coordinate more than vectors have; longest: the largest squared length of a vector."""

    def __init__(self, points: np.ndarray, longest: float):
        self.points, self.longest = points, longest

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))))

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((lifted - p) ** 2).sum(axis=1)) for p in self.points], axis=1)

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self.distances(np.column_stack((x, np.zeros(len(x)))))

    def bracket(self, anchor: np.ndarray, to_anchor: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score of vectors with pivot distances from `least` to `most` (rows by pivots)."""
        both = float(anchor @ anchor) + self.longest
        gap = np.maximum(np.maximum(to_anchor - most, least - to_anchor), 0).max(axis=1)
        reach = (to_anchor + most).min(axis=1)
        slack = SLACK * both + 1e-6
        return (both - reach**2) / 2 - slack, (both - gap**2) / 2 + slack


def best_scored(anchor: np.ndarray, rows: np.ndarray, upper: np.ndarray, lower: np.ndarray, order: tuple[np.ndarray, ...], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k largest scores of at least `least`, ties by `order`; upper, lower: the rows' brackets."""
    if len(rows) > k:
        least = max(least, float(np.partition(lower, -k)[-k]))
    left = np.flatnonzero(upper >= least)
    left = left[np.argsort(-upper[left], kind="stable")]
    places, scores, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 256
    for begin in range(0, len(left), step):
        some = left[begin : begin + step]
        if len(scores) == k and upper[some[0]] < scores[-1]:
            break
        places, scores = np.concatenate((places, some)), np.concatenate((scores, products(rows[some], anchor)))
        top = np.lexsort((*(x[places] for x in reversed(order)), -scores))[:k]
        places, scores = places[top], scores[top]
    fine = scores >= least
    return places[fine], scores[fine]


def floors(score: int) -> tuple[int, int]:
    """The least and largest negative score beside a positive one: 50 positive <= 100 negative <= 95 positive."""
    return -(-50 * score // 100), 95 * score // 100


def _tasks(left: DataFrame, right: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """left (anchors) and right (rows), both with columns `by`, dealt so that in each group every left row meets every
    right row once, in tasks of about BLOCK of each."""
    size = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = size(left, "parts").join(size(right, "blocks"), list(by))
    own = lambda many, name: F.pmod(F.xxhash64("id", F.lit(name)), F.col(many)).cast("int").alias(name)
    every = lambda many, name: F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias(name)
    a, b = left.join(sizes, list(by)), right.join(sizes, list(by))
    a = a.select(*left.columns, own("parts", "part"), every("blocks", "block"))
    b = b.select(*right.columns, own("blocks", "block"), every("parts", "part"))
    return a, b


_ROW = "id long, label long, vector array<double>, cell int, far array<double>"


class Miner:
    """The pivot table of one set of vectors; rows: (id, label, vector), already floored."""

    def __init__(self, rows: DataFrame, pivots: int):
        self.spark = rows.sparkSession
        sample = sampled(rows.select("id", "vector"), "id", SAMPLE).orderBy("id", "vector").toArrow()
        longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
        known = Pivots(np.zeros((0, 0)), longest)
        known.points = farthest(known.lifted(matrix(sample["vector"].combine_chunks())), pivots)
        self.pivots = known

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            far = known.distances(known.lifted(matrix(batch.column(2))))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1]).astype(np.int32)), pa.array(far.ravel()))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1).astype(np.int32)), lists], names=["id", "label", "vector", "cell", "far"])

        self.rows = written(map_batches(rows, run, _ROW), "pivot_table")
        many = len(known.points)
        # a row for each cell, of which there are `pivots`
        ends = [f(F.col("far")[j]) for f in (F.min, F.max) for j in range(many)]
        self.rings = [(r[0], np.array(r[1 : 1 + many]), np.array(r[1 + many :])) for r in self.rows.groupBy("cell").agg(*ends).orderBy("cell").collect()]

    def routed(self, anchors: DataFrame, least: str | None) -> DataFrame:
        """anchors, once for each other cell than their own whose ring admits a score of column `least` (null: all admit)."""
        known, rings, names = self.pivots, self.rings, anchors.columns

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch.column(names.index("vector")))
            far, floor, own = known.of_anchors(x), batch.column(names.index(least)).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False), []
            low, high = np.stack([r[1] for r in rings]), np.stack([r[2] for r in rings])
            for q in range(len(x)):
                own.append(np.flatnonzero(known.bracket(x[q], far[q], low, high)[1] >= floor[q]))
            cells = np.array([r[0] for r in rings], np.int32)[np.concatenate([np.zeros(0, np.int64), *own])]
            at = pa.array(np.repeat(np.arange(len(x)), [len(c) for c in own]))
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(cells)], names=[*names, "at"])

        return map_batches(anchors, run, ", ".join(f"{c} {t}" for c, t in anchors.dtypes) + ", at int")

    def positives(self, anchors: DataFrame, k: int) -> DataFrame:
        """(anchor, anchor_label, vector, positive, score, place) of the k best other rows of the anchor's label."""
        known = self.pivots
        names = ["id", "label", "vector", "least"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros((0, 3), np.int64)]
            if left.num_rows and right.num_rows:
                asked, rows = matrix(left["vector"].combine_chunks()), matrix(right["vector"].combine_chunks())
                far, to, ids = matrix(right["far"].combine_chunks()), known.of_anchors(asked), right["id"].to_numpy()
                floor = left["least"].cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
                for q, anchor in enumerate(left["id"].to_numpy()):
                    other = np.flatnonzero(ids != anchor)
                    lower, upper = known.bracket(asked[q], to[q], far[other], far[other])
                    places, scores = best_scored(asked[q], rows[other], upper, lower, (ids[other],), k, floor[q])
                    out.append(np.column_stack((np.full(len(places), q), other[places], scores)))
            at = np.concatenate(out)
            cut = lambda t, c, j: t[c].combine_chunks().take(pa.array(at[:, j]))
            return pa.table({"anchor": cut(left, "id", 0), "anchor_label": cut(left, "label", 0), "vector": cut(left, "vector", 0), "positive": cut(right, "id", 1), "score": pa.array(at[:, 2])})

        def searched(asking: DataFrame) -> DataFrame:
            a, b = _tasks(asking, self.rows.select("id", "label", "vector", "cell", "far"), "label", "cell")
            task = ("label", "cell", "part", "block")
            return written(a.groupBy(*task).cogroup(b.groupBy(*task)).applyInArrow(run, "anchor long, anchor_label long, vector array<double>, positive long, score long"), "positives")

        place = F.row_number().over(Window.partitionBy("anchor", "anchor_label", "vector").orderBy(F.desc("score"), "positive"))
        own = searched(anchors.select("id", "label", "vector", "cell", F.lit(None).cast("long").alias("least")))
        # the k-th score so far, by anchor
        kth = own.withColumn("place", place).where(F.col("place") == k).select(F.col("anchor").alias("id"), F.col("anchor_label").alias("label"), "vector", F.col("score").alias("least"))
        asking = anchors.select("id", "label", "vector", "cell").join(kth, ["id", "label", "vector"], "left")
        others = searched(self.routed(asking, "least").where("at != cell").select(*names, F.col("at").alias("cell")))
        return own.unionByName(others).withColumn("place", place).where(F.col("place") <= k)

    def negatives(self, found: DataFrame, k: int) -> DataFrame:
        """(anchor, positive, negative, positive_score, negative_score) of each positive's k best rows of other labels in its range, and those of other blocks."""
        known = self.pivots
        pair = F.struct(F.col("positive"), F.col("score"))
        asking = found.where("score >= 0").groupBy(F.col("anchor").alias("id"), F.col("anchor_label").alias("label"), "vector").agg(F.sort_array(F.collect_list(pair)).alias("pairs"), F.min("score").alias("low"))
        asking = asking.withColumn("least", F.ceil(F.col("low") / 2).cast("long")).drop("low")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros((0, 6), np.int64)]
            if left.num_rows and right.num_rows:
                asked, rows = matrix(left["vector"].combine_chunks()), matrix(right["vector"].combine_chunks())
                far, to, ids, kind = matrix(right["far"].combine_chunks()), known.of_anchors(asked), right["id"].to_numpy(), right["label"].to_numpy()
                own, pairs = left["label"].to_numpy(), left["pairs"].to_pylist()
                for q, anchor in enumerate(left["id"].to_numpy()):
                    _, upper = known.bracket(asked[q], to[q], far, far)
                    left_ = np.flatnonzero((upper >= min(floors(p["score"])[0] for p in pairs[q])) & (kind != own[q]) & (ids != anchor))
                    scores = products(rows[left_], asked[q])
                    order = np.lexsort((kind[left_], ids[left_], -scores))
                    left_, scores = left_[order], scores[order]
                    for p in pairs[q]:
                        low, high = floors(p["score"])
                        some = np.flatnonzero((scores >= low) & (scores <= high))[:k]
                        out.append(np.column_stack((np.full(len(some), anchor), np.full(len(some), own[q]), np.full(len(some), p["positive"]), ids[left_[some]], np.full(len(some), p["score"]), scores[some])))
            at = np.concatenate(out)
            return pa.table({c: pa.array(at[:, j]) for j, c in enumerate(("anchor", "anchor_label", "positive", "negative", "positive_score", "negative_score"))})

        routed = self.routed(asking, "least").select("id", "label", "vector", "pairs", F.col("at").alias("cell"))
        a, b = _tasks(routed, self.rows, "cell")
        task = ("cell", "part", "block")
        return a.groupBy(*task).cogroup(b.groupBy(*task)).applyInArrow(run, "anchor long, anchor_label long, positive long, negative long, positive_score long, negative_score long")


def mined(table: DataFrame, is_anchor: Column, label: Column, vector: str = "embedding", positives: int = 5, negatives: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    whole = F.transform(F.col(vector).cast("array<double>"), _floor)
    rows = table.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector"), is_anchor.alias("asks")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None or not lengths["size"]:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = written(rows.where(F.size("vector") == F.lit(lengths["size"])).groupBy("id", "label", "vector").agg(F.max("asks").alias("asks")), "floored")
    miner = Miner(rows.select("id", "label", "vector"), pivots)
    anchors = miner.rows.join(rows.where("asks").select("id", "label", "vector"), ["id", "label", "vector"], "left_semi")
    found = written(miner.positives(written(anchors, "anchors"), positives), "first_positives")
    place = F.row_number().over(Window.partitionBy("anchor", "anchor_label", "positive", "positive_score").orderBy(F.desc("negative_score"), "negative"))
    best = miner.negatives(found, negatives).withColumn("rank", place).where(F.col("rank") <= negatives)
    return best.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", "negative_score")


def _floor(x: Column) -> Column:
    """floor(SCALE * x) as a double, whatever its size."""
    scaled = x * F.lit(float(SCALE))
    return F.when(F.abs(scaled) < F.lit(float(1 << 52)), F.floor(scaled).cast("double")).otherwise(scaled)


def oracle() -> str:
    """The same in DuckDB."""
    return """
with fine as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other, list_dot_product(a.v, b.v)::bigint as score
from fine a join fine b on a.vec_id % 50 = 0 and a.vec_id != b.vec_id),
positive as (select anchor_id, other as positive_id, score as positive_score from scored where same
qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::int as rank, other as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 3"""
