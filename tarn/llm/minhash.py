"""Near-duplicates by one-permutation hashing with optimal densification, bands, and star-shaped candidate edges.

One hash of each shingle fills BANDS * ROWS bins with minima; an empty bin takes the value of a bin that it finds with
hash functions of its own number, the same for all documents (Shrivastava, 2017). Equal runs of ROWS bins put
documents in one bucket. Documents with equal shingle sets are one node throughout, so copies never meet in a bucket.

A bucket gives star edges only: its smallest node with every other member, so that buckets around one group share
their centers. They are confirmed on the full sets and make components. A bucket whose members still lie in several
components is open; its members outside the largest component meet a second center, a member of that component that
differs from bucket to bucket. What is open after that is settled exactly, for what a star can miss: a link between two
members in different components. Two linked sets share one of their rarest shingles (the prefix filter, with a bound
from the places of the shared shingle), so the open members' rarest shingles are joined and only such pairs compared.
How rare a shingle is comes from a table of SLOTS counters; any order finds the same links.

A document's set: its distinct shingles of `width` words (runs of other than \\x20 and \\x09-\\x0D, A-Z in lower case); of
fewer words, the whole sequence; of none, the empty set, linked with nothing. A null doc_id or text: empty set, its own
component (null for a null doc_id). Rows that share a doc_id count as one document with several texts: a link of one
is a link of all. Very long texts count whole; a worker takes BATCH_ROWS texts of one Arrow batch, which Spark bounds in
bytes, at a time. Other columns of docs, whatever their names, are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import wordhash
from tarn.llm.common import checked_broadcast, map_batches, sliced, steps, utf8, written
from tarn.operators.components import components

WIDTH, PERCENT, BANDS, ROWS = 5, 80, 24, 6
#: Counters of shingles among the open members, and partners of a node that one task compares it with.
SLOTS, BLOCK = 1 << 18, 32
#: Texts with one shingle beyond which sizes are joined too, and the logarithm of a size class's width.
FEW_PAIRS, SIZE_STEP = 16, 0.03


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit hashes."""
    out = []
    for begin, end in steps(texts, 1 << 20):
        hashes, first = wordhash.words(texts[begin:end], lower=True)
        grams = wordhash.windows(hashes, width)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            else:
                out.append(wordhash.windows(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _probe_table(bins: int, tries: int = 256) -> np.ndarray:
    """For each bin the order in which it asks other bins for a value; fixed, as all documents must ask alike."""
    seeds = np.arange(bins * tries, dtype=np.uint64).reshape(bins, tries)
    return (wordhash.mix(seeds + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


class Signer:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.probes = _probe_table(self.bins)
        self.edges = (np.arange(1, self.bins, dtype=object) * (1 << 64) // self.bins).astype(np.uint64)

    def bins_of(self, hashes: np.ndarray) -> np.ndarray:
        """The densified signature of a set that isn't empty."""
        at = np.searchsorted(hashes, self.edges)
        first = np.concatenate(([0], at))
        full = first < np.concatenate((at, [len(hashes)]))
        out = np.zeros(self.bins, np.uint64)
        out[full] = hashes[first[full]]
        if not full.all():
            missing = np.flatnonzero(~full)
            asked = full[self.probes[missing]]
            found = asked.any(axis=1)
            other = self.probes[missing, asked.argmax(axis=1)]
            other[~found] = np.flatnonzero(full)[0]
            out[missing] = out[other]
        return out

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        bins = self.bins_of(hashes).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            key = wordhash.mix(key * np.uint64(0xD6E8FEB86659FD93) + bins[:, k])
        return key.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a hash of the set; null if empty) and buckets."""
    held: list[Signer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held or held.append(Signer(bands, rows))
        sets = shingle_sets(utf8(batch.column(1)), width)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([held[0].buckets(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "buckets"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))
    return map_batches(texts, run, "doc_id long, n_shingles long, set_id binary, buckets array<long>")


def _near(sizes: tuple[str, str], percent: int) -> Column:
    """What the sizes of linked sets must fulfil."""
    return F.least(*sizes) * 100 >= F.greatest(*sizes) * percent


def _compared(requests: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b). requests: (task, side, node); in each task every node of side 0 is compared with every of side 1."""
    rows = requests.join(texts, "node").select("task", "side", "node", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, side, raw = table["node"].to_numpy(), table["side"].to_numpy(), utf8(table["text"].combine_chunks())
        once = sorted({(s, n, t): k for k, (s, n, t) in enumerate(zip(side.tolist(), nodes.tolist(), raw, strict=True))}.values())
        nodes, side, sets = nodes[once], side[once], shingle_sets([raw[k] for k in once], width)
        own, a, b = np.flatnonzero(side == 0), [], []
        for other in np.flatnonzero(side == 1):
            s = sets[other]
            for k in own:
                t = sets[k]
                if nodes[k] == nodes[other] or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * common >= percent * (len(s) + len(t) - common):
                    a.append(nodes[k])
                    b.append(nodes[other])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def _pair_tasks(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Tasks for pairs (a, b): each of one node and up to about `block` of its partners; the node with more of them leads."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("task"), F.lit(0).alias("side"), F.col("a").alias("node"))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    both = pairs.join(ends.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(ends.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    lead = F.col("da") >= F.col("db")
    led = both.select(F.when(lead, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(lead, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest("da", "db").alias("degree"))
    tasks = led.select(F.xxhash64("x", F.pmod(F.xxhash64("y"), F.ceil(F.col("degree") / block))).alias("task"), "x", "y")
    return tasks.select("task", F.lit(0).alias("side"), F.col("x").alias("node")).distinct().unionByName(tasks.select("task", F.lit(1).alias("side"), F.col("y").alias("node")))


def _shingle_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How often shingles come in the texts of rows (.., text), by SLOTS counters; at most so many rows are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in sliced(batch):
                sets = shingle_sets(utf8(part.column(0)), width)
                counts += np.bincount((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(counts[slots])], names=["slot", "n"])

    sums = rows.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return out


def _rarest(rows: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Of each text's shingles the rarest, as many as hold one of those shared with any set that it can be linked with.

    rows: (node, component, outside, text). Out: (shingle, node, component, outside, size, rest); rest: shingles of
    the set that are not rarer.
    """
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, row, size, rest = [np.zeros(0, np.uint64)], [], [], []
        for k, s in enumerate(shingle_sets(utf8(batch.column(3)), width)):
            keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
            order = np.lexsort((s, sent.value[(s % np.uint64(SLOTS)).astype(np.int64)]))[:keep]
            shingles.append(s[order])
            row.append(np.full(keep, k))
            size.append(np.full(keep, len(s)))
            rest.append(len(s) - np.arange(keep))
        at = pa.array(np.concatenate(row).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), *(batch.column(c).take(at) for c in range(3)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(rest).astype(np.int32))], names=["shingle", "node", "component", "outside", "size", "rest"])

    return map_batches(rows.select("node", "component", "outside", "text"), run, "shingle long, node long, component long, outside boolean, size int, rest int")


def _sharing(rarest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components, one of them outside, that share one of their rarest shingles early enough.

    The places of a shared shingle bound the overlap, so a row can only meet sets of some sizes. Rows of a shingle that
    more than FEW_PAIRS texts have are joined by the classes of both sizes too, which keeps apart what the bound would drop.
    """
    postings = rarest.groupBy("shingle").agg(F.count("*").alias("n"), F.max("outside").alias("any")).where("n > 1 and any").select("shingle", "n")
    rows = written(rarest.join(postings, "shingle"), "postings")
    size_class = lambda c: F.floor(F.log(c.cast("double")) / SIZE_STEP).cast("int")
    least, most = F.ceil(F.col("size") * percent / 100), F.floor(F.col("rest") * (100 + percent) / percent) - F.col("size")
    rows = rows.withColumns({"own": size_class(F.col("size")), "least": least, "most": most}).where("most >= least")
    hot = rows.where(F.col("n") > FEW_PAIRS).withColumn("other", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))))
    out = None
    for some, keys in ((rows.where(F.col("n") <= FEW_PAIRS), {}), (hot, {"own": "other", "other": "own"})):
        side = lambda s, swap, some=some, keys=keys: some.select("shingle", *[F.col(keys[k] if swap else k).alias(k) for k in keys], *[F.col(c).alias(f"{s}_{c}") for c in ("node", "component", "outside", "size", "rest")])
        both = side("x", False).where("x_outside").join(side("y", True), ["shingle", *keys])
        fine = F.least("x_rest", "y_rest") * (100 + percent) >= (F.col("x_size") + F.col("y_size")) * percent
        both = both.where((F.col("x_component") != F.col("y_component")) & fine).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
        out = both if out is None else out.unionByName(both)
    return out.distinct()


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component), with components that are linked by (a, b) made one."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = written(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "between")
    if between.isEmpty():
        return found
    whole = components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    known = found.unionByName(whole.select(F.col("component").alias("node"), "component")).distinct()
    return written(known.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).groupBy("node").agg(F.min("component").alias("component")), "merged")


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with `outside`: not in the bucket's largest one."""
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("n")).where("n > 1")
    return written(placed.join(mixed.select("bucket", "main"), "bucket").withColumn("outside", F.col("component") != F.col("main")), "open")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    signed = written(signatures(docs, width, bands, rows), "signed")
    # One node for each set, named by its smallest doc_id; sums and minima are made before the shuffle.
    nodes = signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("buckets").alias("buckets"))
    nodes = written(nodes, "nodes")
    members = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min(F.struct("node", "size")).alias("center"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("center.node").alias("center"), F.col("center.size").alias("center_size"))
    members = written(members.join(stars, "bucket"), "shared")
    edge = (F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b"))
    pairs = written(members.where((F.col("node") != F.col("center")) & _near(("size", "center_size"), percent)).select(*edge).distinct(), "star_pairs")
    members = members.select("bucket", "node", "size")
    # The texts of nodes that share a bucket with others, for all comparisons.
    shared = written(members.select("node").distinct(), "shared_nodes")
    texts = written(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(checked_broadcast(shared), "node", "left_semi"), "texts")
    compared = lambda some: written(_compared(_pair_tasks(some), texts, width, percent), "links")
    found = written(components(compared(pairs)), "components")

    open_ = _open(members, found)
    second = open_.where("not outside").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("o"), "node", "size")).alias("c")).select("bucket", F.col("c.node").alias("center"), F.col("c.size").alias("center_size"))
    more = open_.where("outside").join(second, "bucket").where(_near(("size", "center_size"), percent)).select(*edge).distinct().join(pairs, ["a", "b"], "left_anti")
    found = _merged(found, compared(more))

    open_ = _open(members, found).groupBy("node").agg(F.max("outside").alias("outside"), F.first("component").alias("component"))
    rest = written(texts.join(open_, "node"), "open_texts")
    if not rest.isEmpty():
        rarest = written(_rarest(rest, _shingle_counts(rest, width), width, percent), "rarest")
        found = _merged(found, compared(_sharing(rarest, percent)))
    of_set = nodes.select("set_id", "node").join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
