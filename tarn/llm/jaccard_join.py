"""The n-gram Jaccard join, by T-occurrence search with DivideSkip.

A set of s shingles that is linked with another shares at least T of them, percent of s rounded up. An inverted list
names the sets that hold a shingle. A search leaves the T - 1 longest of a set's s lists aside: whoever is linked is on
one of the others. Those short lists are all that is built over all documents; they are ordered by how frequent a
shingle is (a power of two; the LISTED most frequent shingles are told apart, the others count as rare) and then by
hash, and any order finds the same links.

The sets that meet on short lists are dealt into tasks, each a set and up to BLOCK others, which are searched there by
`Lists`: DivideSkip on the inverted lists of the task's own sets, with fewer lists left aside (as its rule says), the
short ones merged by a heap that skips what cannot reach its count, the long ones probed by binary search for what the
merge has found, until the exact overlap says who is linked.

Equal sets are one node, the smallest of their doc_ids. What meets is chosen so that groups of near copies give no
square of searches: first every node of a list with the list's smallest node, then those outside the list's largest
component with a second center, at last every two nodes of a list that lie in different components; sizes, and the
places of the shared shingle in both orders, bound who can be linked. So no link between two components is missed.

A document's set: its distinct shingles of `width` words (runs of other than \\x20 and \\x09-\\x0D, A-Z in lower case); of
fewer words, the whole sequence; of none, the empty set, linked with nothing. Shingles are 64-bit hashes. A null doc_id
or text: empty set, its own component (null for a null doc_id). Rows that share a doc_id are one document: a link of one
is a link of all, and they are linked among themselves if they hold anything. Very long texts count whole. Other columns
of docs, whatever their names, are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import wordhash
from tarn.llm.common import checked_broadcast, map_batches, sliced, utf8, written
from tarn.llm.minhash import _merged, _near, _pair_tasks, _sharing, shingle_sets
from tarn.operators.components import components

WIDTH, PERCENT, BLOCK = 5, 80, 64
#: Shingles that are told apart by frequency, and in how many texts they are at least.
LISTED, FREQUENT = 1 << 19, 5
#: Shingles that one task counts, and that a task gathers before it hands counts on.
COUNTED, GATHERED = 1 << 21, 1 << 21
#: DivideSkip leaves T / (MU * log2(longest list) + 1) lists aside.
MU = 0.0085


def required(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def merged_short(lists: list[list[int]], least: int) -> dict[int, int]:
    """Entries on at least so many of the sorted lists, with their counts: a heap merge that skips what can't get there."""
    heap = [(own[0], k, 0) for k, own in enumerate(lists) if own]
    heapq.heapify(heap)
    found = {}
    while len(heap) >= least:
        entry, popped = heap[0][0], []
        while heap and heap[0][0] == entry:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found[entry] = len(popped)
            target = entry + 1
        else:  # what is smaller than the next top is on less than `least` lists
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(entry + 1, heap[0][0])
        for _, k, at in popped:
            own, step, low = lists[k], 1, at
            while low + step < len(own) and own[low + step] < target:  # gallop, then halve
                low, step = low + step, step * 2
            high = min(low + step, len(own))
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if own[middle] < target else (low, middle)
            if low < len(own):
                heapq.heappush(heap, (own[low], k, low))
    return found


class Lists:
    """Inverted lists of some sets (sorted hashes)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner, shingles = np.repeat(np.arange(len(sets)), self.sizes), np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.lexsort((owner, shingles))
        self.owner, shingles = owner[order], shingles[order]
        self.shingles, first = np.unique(shingles, return_index=True)
        self.first = np.append(first, len(shingles))

    def linked(self, asked: np.ndarray, percent: int) -> list[int]:
        """Which of the sets are linked with the set asked, by DivideSkip."""
        fine = (100 * np.minimum(self.sizes, len(asked)) >= percent * np.maximum(self.sizes, len(asked))) & (self.sizes > 0)
        if not len(asked) or not fine.any():
            return []
        at = np.minimum(np.searchsorted(self.shingles, asked), len(self.shingles) - 1)
        at = at[self.shingles[at] == asked]
        least = required(len(asked), int(self.sizes[fine].min()), percent)
        if len(at) < least:
            return []
        lengths = self.first[at + 1] - self.first[at]
        at = at[np.argsort(lengths, kind="stable")]
        aside = min(least - 1, int(least / (MU * math.log2(max(2, lengths.max())) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        counts = merged_short([self.owner[self.first[k] : self.first[k + 1]].tolist() for k in short], least - aside)
        met = np.array([k for k in sorted(counts) if fine[k]], np.int64)
        overlap, need = np.array([counts[k] for k in met], np.int64), np.array([required(len(asked), int(self.sizes[k]), percent) for k in met], np.int64)
        for left, k in zip(range(len(long), 0, -1), long, strict=True):
            stays = overlap + left >= need
            if not stays.all():
                met, overlap, need = met[stays], overlap[stays], need[stays]
            if not len(met):
                break
            own = self.owner[self.first[k] : self.first[k + 1]]
            overlap += own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
        return met[overlap >= need].tolist()


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a hash of the set; null if empty)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(utf8(batch.column(1)), width)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "set_id"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))
    return map_batches(texts, run, "doc_id long, n_shingles long, set_id binary")


class Frequencies:
    """Of the most frequent shingles a class, the logarithm of their number; shingles are known by some of their bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, mask: int):
        order = np.argsort(keys)
        self.keys, self.classes, self.mask = keys[order], np.log2(np.maximum(counts[order], 1)).astype(np.uint8), np.uint64(mask)

    def classes_of(self, shingles: np.ndarray) -> np.ndarray:
        """0 for a shingle that is not listed."""
        if not len(self.keys):
            return np.zeros(len(shingles), np.uint8)
        key = shingles & self.mask
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.classes[at], 0)

    def ordered(self, shingles: np.ndarray) -> np.ndarray:
        """The set's shingles, rare ones first."""
        return shingles[np.lexsort((shingles, self.classes_of(shingles)))]


def _gathered(texts: DataFrame, width: int, handed: Callable[[list, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """handed(nodes, sets) of texts (node, text), for about GATHERED shingles of a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, many = [], [], 0
        for batch in batches:
            for part in sliced(batch):
                own = shingle_sets(utf8(part.column(1)), width)
                nodes, sets, many = nodes + part.column(0).to_pylist(), sets + own, many + sum(map(len, own))
                if many >= GATHERED:
                    yield handed(nodes, sets)
                    nodes, sets, many = [], [], 0
        yield handed(nodes, sets)

    return texts.select("node", "text").mapInArrow(run, schema)


def _pieces(column: np.ndarray, first: np.ndarray, kind: type) -> pa.Array:
    """The column's values from each place of `first` to the next, as bytes."""
    return pa.array([x.astype(kind).tobytes() for x in np.split(column, first[1:])] if len(first) else [], pa.binary())


def _whole(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def frequencies(texts: DataFrame, width: int, total: int, listed: int = LISTED) -> Frequencies:
    """Counted over all texts (node, text), which have `total` shingles: in tasks of about COUNTED of them, each counted
    before the shuffle by GATHERED, and told apart by 24 bits of their hash and the task's number. At most `listed` come
    to the driver: where more are frequent, the bound rises."""
    buckets = 1 << (total // COUNTED).bit_length()
    low = np.uint64(buckets - 1)

    def handed(_: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate([np.zeros(0, np.uint64), *sets])
        keys, counts = np.unique((hashes & low) << np.uint64(24) | hashes >> np.uint64(40), return_counts=True)
        used, first = np.unique(keys >> np.uint64(24), return_index=True)
        # sorted numbers as the steps between them, of two bytes each where all of a piece are so small
        steps = np.diff(keys & np.uint64(0xFFFFFF), prepend=np.uint64(0))
        steps[first] = keys[first] & np.uint64(0xFFFFFF)
        small = np.maximum.reduceat(steps, first) <= 0xFFFF if len(first) else np.zeros(0, bool)
        steps = pa.array([x.astype(np.uint16 if s else np.uint32).tobytes() for x, s in zip(np.split(steps, first[1:]), small, strict=len(first) > 0)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(small), steps, _pieces(counts, first, np.uint32)], names=["bucket", "small", "steps", "counts"])

    def count(table: pa.Table) -> pa.Table:
        rest = [np.cumsum(np.frombuffer(x, np.uint16 if s else np.uint32), dtype=np.uint64) for s, x in zip(table["small"].to_pylist(), table["steps"].to_pylist(), strict=True)]
        rest, inverse = np.unique(np.concatenate(rest), return_inverse=True)
        n = np.bincount(inverse, weights=_whole(table, "counts", np.uint32).astype(np.float64)).astype(np.int64)
        often = n >= FREQUENT
        keys = rest[often] << np.uint64(40) | np.uint64(table["bucket"][0].as_py())
        return pa.table({"key": pa.array(keys.view(np.int64)), "n": pa.array(n[often])})

    counted = _gathered(texts, width, handed, "bucket long, small boolean, steps binary, counts binary")
    counted = written(counted.groupBy("bucket").applyInArrow(count, "key long, n long"), "frequent")
    least = FREQUENT
    while counted.where(F.col("n") >= least).count() > listed:
        least *= 2
    rows = counted.where(F.col("n") >= least).toArrow()
    return Frequencies(rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy(), 0xFFFFFF0000000000 | (buckets - 1))


def short_lists(texts: DataFrame, known: Frequencies, width: int, percent: int, total: int) -> DataFrame:
    """(shingle, node, size, rest) of each text's rarest shingles, all but T - 1, that several texts may share; rest: its
    shingles not before this one.

    Most shingles are one text's own, and go: they are dealt by hash into tasks of about COUNTED / 4, as bytes. Those
    that `known` lists are several texts' and need no such look; they pass by parts, so that none is one task's.
    """
    buckets = 1 << (total // COUNTED).bit_length()
    sent = texts.sparkSession.sparkContext.broadcast(known)
    names = {"shingle": np.uint64, "node": np.uint32, "node_high": np.int32, "size": np.uint16, "size_high": np.uint16, "rest": np.uint16, "rest_high": np.uint16}

    def handed(nodes: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        keep = [len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0 for s in sets]
        shingle = np.concatenate([np.zeros(0, np.uint64), *(sent.value.ordered(s)[:k] for s, k in zip(sets, keep, strict=True))])
        rest = np.concatenate([np.zeros(0, np.int64), *(len(s) - np.arange(k) for s, k in zip(sets, keep, strict=True))])
        size, node = np.repeat(np.array([len(s) for s in sets], np.int64), keep), np.repeat(np.array(nodes, np.int64), keep)
        passes = sent.value.classes_of(shingle) > 0
        bucket = np.where(passes, -1 - wordhash.mix(shingle ^ node.view(np.uint64)).view(np.int64) % buckets, (shingle % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        planes = [shingle, node & 0xFFFFFFFF, node >> 32, size & 0xFFFF, size >> 16, rest & 0xFFFF, rest >> 16]
        return pa.RecordBatch.from_arrays([pa.array(used), *(_pieces(x[order], first, kind) for x, kind in zip(planes, names.values(), strict=True))], names=["bucket", *names])

    def shared(table: pa.Table) -> pa.Table:
        c = {name: _whole(table, name, kind) for name, kind in names.items()}
        several = np.ones(len(c["shingle"]), bool)
        if table["bucket"][0].as_py() >= 0:
            _, inverse, n = np.unique(c["shingle"], return_inverse=True, return_counts=True)
            several = n[inverse] > 1
        both = lambda name: c[f"{name}_high"][several].astype(np.int64) << (32 if name == "node" else 16) | c[name][several]
        return pa.table({"shingle": c["shingle"][several].view(np.int64), "node": both("node"), "size": both("size").astype(np.int32), "rest": both("rest").astype(np.int32)})

    rows = _gathered(texts, width, handed, "bucket long, " + ", ".join(f"{name} binary" for name in names))
    return rows.groupBy("bucket").applyInArrow(shared, "shingle long, node long, size int, rest int")


def _searched(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of nodes that are linked, found by searches in tasks of one node and up to BLOCK partners."""
    tasks = written(_pair_tasks(pairs, BLOCK), "search_tasks")
    rows = texts.join(checked_broadcast(tasks), "node").select("task", "side", "node", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, side, raw = table["node"].to_numpy(), table["side"].to_numpy(), utf8(table["text"].combine_chunks())
        once = sorted({(s, n, t): k for k, (s, n, t) in enumerate(zip(side.tolist(), nodes.tolist(), raw, strict=True))}.values())
        nodes, side, sets = nodes[once], side[once], shingle_sets([raw[k] for k in once], width)
        others = np.flatnonzero(side == 1)
        lists, found = Lists([sets[k] for k in others]), []
        for k in np.flatnonzero(side == 0):
            found += [(nodes[k], nodes[others[other]]) for other in lists.linked(sets[k], percent) if nodes[k] != nodes[others[other]]]
        return pa.table({c: pa.array([f[j] for f in found], pa.int64()) for j, c in enumerate("ab")})

    return written(rows.groupBy("task").applyInArrow(run, "a long, b long"), "links")


def _open_lists(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (bucket, node, ..) of lists that hold several components, with component and `outside`: not in the list's
    largest one. What is looked up, a row a node and a row an open list, is few beside the members and sent to them."""
    placed = members.join(checked_broadcast(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("n")).where("n > 1").select("bucket", "main")
    return written(placed.join(checked_broadcast(written(mixed, "mixed")), "bucket").withColumn("outside", F.col("component") != F.col("main")), "open")


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    signed = written(_signed(docs, width), "signed")
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    nodes = written(signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node")), "nodes")
    whole = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = whole.join(checked_broadcast(nodes.select("node").distinct()), "node", "left_semi")
    rows = written(short_lists(texts, frequencies(texts, width, total), width, percent, total), "short_lists")
    shared = rows.groupBy("shingle").agg(F.min(F.struct("node", "size", "rest")).alias("center"), F.max("node").alias("last")).where("center.node != last")
    shared = shared.select("shingle", F.col("center.node").alias("center"), F.col("center.size").alias("center_size"), F.col("center.rest").alias("center_rest"))
    members = written(rows.join(checked_broadcast(written(shared, "centers")), "shingle"), "lists")
    enough = lambda a, b: F.least(f"{a}rest", f"{b}rest") * (100 + percent) >= (F.col(f"{a}size") + F.col(f"{b}size")) * percent
    edge = (F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b"))
    pairs = written(members.where((F.col("node") != F.col("center")) & _near(("size", "center_size"), percent) & enough("", "center_")).select(*edge).distinct(), "first_pairs")
    members = members.select(F.col("shingle").alias("bucket"), "node", "size", "rest")
    texts = written(whole.join(checked_broadcast(written(members.select("node").distinct(), "met")), "node", "left_semi"), "texts")
    links = _searched(pairs, texts, width, percent).unionByName(_same_document(signed, nodes))
    found = written(components(links), "components")

    open_ = _open_lists(members, found)
    second = open_.where("not outside").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("o"), "node", "size", "rest")).alias("c")).select("bucket", F.col("c.node").alias("center"), F.col("c.size").alias("center_size"), F.col("c.rest").alias("center_rest"))
    more = open_.where("outside").join(second, "bucket").where(_near(("size", "center_size"), percent) & enough("", "center_")).select(*edge).distinct().join(pairs, ["a", "b"], "left_anti")
    found = _merged(found, _searched(more, texts, width, percent))

    open_ = _open_lists(members, found)
    found = _merged(found, _searched(_sharing(open_.withColumnRenamed("bucket", "shingle").drop("main"), percent), texts, width, percent))
    of_set = nodes.select("set_id", "node").join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = signed.join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _same_document(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of a document that has several texts."""
    several = written(signed.where("set_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("s"), F.max("set_id").alias("t")).where("s != t").select("doc_id"), "several")
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    own = signed.where("set_id is not null").join(several, "doc_id", "left_semi").join(nodes, "set_id")
    least = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    return own.join(least, "doc_id").where("a != node").select("a", F.col("node").alias("b")).distinct()


def oracle() -> str:
    """The same in DuckDB."""
    return r"""
with recursive split as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
word as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as k from split),
five as (select doc_id, k, concat_ws(' ', w, lead(w, 1) over own, lead(w, 2) over own, lead(w, 3) over own, lead(w, 4) over own) as x, count(*) over (partition by doc_id) as many from word window own as (partition by doc_id order by k)),
every as materialized (select distinct doc_id, x from five where k <= greatest(many - 4, 1)),
shingles as materialized (select doc_id, hash(x) as x from every),
shared as materialized (select doc_id, x from shingles where x in (select x from shingles group by x having count(*) > 1)),
sizes as (select documents.doc_id, count(x) as n from documents left join every using (doc_id) group by documents.doc_id),
common as (select p.doc_id as a, q.doc_id as b, count(*) as n from shared p join shared q on p.x = q.x and p.doc_id < q.doc_id group by all),
links as materialized (select a, b from common join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * common.n >= 80 * (s.n + t.n - common.n)),
ways as materialized (select a, b from links union select b, a from links),
reach(node, least) as (select doc_id, doc_id from documents union select ways.b, reach.least from reach join ways on ways.a = reach.node where reach.least < ways.b)
select doc_id, n::bigint as n_shingles, least as component_id from sizes join (select node, min(least) as least from reach group by node) on node = doc_id"""
