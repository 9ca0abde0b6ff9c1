"""Ranked lexical search: MaxScore in every shard, then the best of all shards.

Documents are reduced to their postings in the items' terms, once, and stay where they lie: a part of that table is a
shard. A shard goes through its postings in Arrow batches, each with inverted lists of its own, and keeps an item's best
k so far, whose least score is the item's threshold. A list's upper bound is its largest contribution. Lists in order of
their bounds are non-essential as long as the bounds sum to less than the threshold: no document that is on these alone
can qualify. Documents on an essential list are scored on those; then the non-essential lists are probed by binary
search, from the largest bound down, for the documents that can still reach the threshold. Only k documents an item
and shard are shuffled.

Terms are the longest runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case, known by 64-bit
hashes. Weights and lengths come from counts over all documents (see `impacts` and `weights`). A document without a text
or terms is none of the N; one without a doc_id counts in N, L and df but is not returned. Every row is a document, so a
repeated row comes as often as it is there; equal scores go by doc_id. Items without an id are left out; rows of one
item_id ask together, equal ones once. Long texts count whole, on both sides. Other columns, whatever their names, are
passed over. Empty tables, and items without a term that any document has, give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import wordhash
from tarn.llm.common import map_batches, steps, utf8, written

#: Terms of items that are sent to the shards at a time, and documents that are scored at a time.
ASKED, CHUNK = 1 << 19, 2048


def _counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of each text's distinct terms; hashes of all texts, which begin at `first`."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.flatnonzero(np.concatenate(([True] * (len(text) > 0), (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))))
    return text[new], hashes[new], np.diff(np.append(new, len(text)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of items (item_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, parts = utf8(batch.column(1)), []
        for begin, end in steps(texts):
            text, term, times = _counted(*wordhash.words(texts[begin:end], lower=True, between=wordhash.NO_TERM))
            parts.append((text + begin, term, times))
        text, term, times = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))], names=["item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").where("item_id is not null").distinct()
    return map_batches(asked, run, f"item_id {kind}, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Per document doc_id, n (its terms with repeats), and of those in `terms` (sorted) the places and occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, known, lengths, places, times, sizes = utf8(batch.column(1)), sent.value, [], [], [], []
        for begin, end in steps(texts):
            hashes, first = wordhash.words(texts[begin:end], lower=True, between=wordhash.NO_TERM)
            lengths.append(np.diff(first))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            before = np.concatenate(([0], np.cumsum(hit)))
            text, place, n = _counted(at[hit], before[first])
            places.append(place)
            times.append(n)
            sizes.append(np.bincount(text, minlength=end - begin))
        joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        offsets = pa.array(np.concatenate(([0], np.cumsum(joined(sizes)))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(joined(x).astype(np.int32))) for x in (places, times)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined(lengths).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "times"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, terms array<int>, times array<int>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Of each term, from the documents that hold it; 0 for a term that none does."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)


def impacts(times: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a posting's weight is multiplied with."""
    m = 25 + 75 * length * documents // total
    return 1_000_000_000 * times // (1000 * times + 8 * m)


class Shard:
    """Inverted lists of one Arrow batch: rows in order, with impacts; `bound`: each term's largest impact."""

    def __init__(self, terms: np.ndarray, row: np.ndarray, impact: np.ndarray, many: int):
        order = np.lexsort((row, terms))
        self.row, self.impact, terms = row[order], impact[order], terms[order]
        self.first = np.searchsorted(terms, np.arange(many + 1))
        self.bound = np.zeros(many, np.int64)
        held = np.flatnonzero(np.diff(self.first))
        self.bound[held] = np.maximum.reduceat(self.impact, self.first[held]) if len(held) else 0

    def best(self, terms: np.ndarray, weight: np.ndarray, ids: np.ndarray, found: tuple[np.ndarray, np.ndarray], k: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best among `found` and this batch's rows, by MaxScore, larger scores and then smaller ids first."""
        bound = weight * self.bound[terms]
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] > 0]
        terms, weight, upto = terms[order], weight[order], np.cumsum(bound[order])
        for begin in range(0, len(ids), chunk) if len(terms) else ():
            end, least = min(begin + chunk, len(ids)), max(1, int(found[0][-1])) if len(found[0]) == k else 1
            essential = int(np.searchsorted(upto, least))  # the lists before it sum to less than the least score
            if essential == len(terms):
                break  # no document of this batch can qualify any more
            score = np.zeros(end - begin, np.int64)
            for t, w in zip(terms[essential:], weight[essential:], strict=True):
                a, b = self.first[t] + np.searchsorted(self.row[self.first[t] : self.first[t + 1]], (begin, end))
                score[self.row[a:b] - begin] += w * self.impact[a:b]
            met = np.flatnonzero(score)
            for j in range(essential - 1, -1, -1):
                met = met[score[met] + upto[j] >= least]
                if not len(met):
                    break
                t = terms[j]
                own = self.row[self.first[t] : self.first[t + 1]]
                at = np.minimum(np.searchsorted(own, met + begin), len(own) - 1)
                on = own[at] == met + begin
                score[met[on]] += weight[j] * self.impact[self.first[t] + at[on]]
            met = met[score[met] >= least]
            scores, those = np.concatenate((found[0], score[met])), np.concatenate((found[1], ids[met + begin]))
            top = np.lexsort((those, -scores))[:k]
            found = scores[top], those[top]
        return found


def _ranked_in_shards(rows: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], many: int, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of every shard; asked: each item's terms and weights."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(sent.value)
        for batch in batches:
            lists, ids = batch.column(2), batch.column(0).to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            terms, times = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            length = np.repeat(batch.column(1).to_numpy(), sizes)
            shard = Shard(terms, np.repeat(np.arange(len(ids)), sizes), impacts(times.astype(np.int64), length, documents, total), many)
            found = [shard.best(*own, ids, best, k) for own, best in zip(sent.value, found, strict=True)]
        item = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)])) for c in (1, 0))], names=["item", "doc_id", "score"])

    return rows.where("doc_id is not null").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, asked: int = ASKED) -> DataFrame:
    """item_id, rank, doc_id, score: of all docs (doc_id, text) the k best for each of items (item_id, text)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    terms = written(item_terms(items), "item_terms")
    blocks = max(1, -(-terms.count() // asked))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    for block in range(blocks):  # one, unless items have more terms than a worker should be sent
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").toArrow()
        if not own.num_rows:
            continue
        known, at = np.unique(own["term"].to_numpy().view(np.uint64), return_inverse=True)
        names = own["item_id"].to_pylist()
        begin = np.flatnonzero([j == 0 or names[j] != names[j - 1] for j in range(len(names))])
        rows = written(postings(docs, known), "postings")
        documents, total = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        counted = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row a term at most
        df = np.zeros(len(known), np.int64)
        df[counted["term"].to_numpy()] = counted["count"].to_numpy()
        weight = weights(df, documents)[at] * own["times"].to_numpy()
        asks = list(zip(np.split(at, begin[1:]), np.split(weight, begin[1:]), strict=True))
        best = _ranked_in_shards(rows, asks, len(known), documents, total, k).withColumn("rank", place).where(F.col("rank") <= k)
        named = F.broadcast(spark.createDataFrame([(n, names[b]) for n, b in enumerate(begin)], f"item long, item_id {kind}"))
        out = out.unionByName(best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def oracle() -> str:
    """The same in DuckDB."""
    return r"""
with terms as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asked as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
lengths as (select doc_id, count(*) as n from terms group by doc_id),
whole as (select count(*)::bigint as docs, sum(n)::bigint as total from lengths),
found as (select doc_id, term, count(*)::bigint as tf from terms where term in (select term from asked) group by all),
weight as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from found, whole group by term),
scored as (select item_id, found.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
from asked join found using (term) join weight using (term) join lengths on lengths.doc_id = found.doc_id, whole group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0)
select * from ranked where rank <= 10"""
