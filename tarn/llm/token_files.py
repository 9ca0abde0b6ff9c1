"""Documents as token ids in files of directly addressable codes (dac.py), in ascending doc_id order.

Texts are encoded where they lie; only ids, which take less room than their text, are shuffled into order.

Null texts are empty; a null doc_id sorts first and stays null. Rows that share a doc_id follow each other, ordered by
a hash of their text; equal rows of a hot doc_id are dealt to several shards. Very long texts are encoded
whole, each a segment of its own. Other columns, whatever their names, are passed over. An empty table writes no segment
and reads back as no document.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import dac, wordhash
from tarn.llm.common import Remembered, byte_of_symbol, few, library_tokenizer, map_batches, once_a_worker, sampled, shared_dir, sliced, steps, utf8

#: Tokens after which a segment ends, at the next document; a longer document is a segment of its own.
SEGMENT_TOKENS = 1 << 20
#: Rows a shard that the bounds between shards are taken from.
SAMPLED = 100
#: Words, and pieces of words, whose ids a worker remembers.
CACHED_WORDS, CACHED_PIECES = 300_000, 300_000


#: Pieces of lower-case ASCII and Latin text: runs of letters, contractions, digits, runs of punctuation. Those of
#: U+00C0 to U+023F are all letters but two; these, U+0130, whose lower case is two characters, and all characters
#: beyond are unusual, and so are starts of added tokens.
_PIECE = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf]|[\xc4-\xc8][\x80-\xbf])+)+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9\x80-\xff]+")
_USUAL = bytes((*range(128), *range(0xC3, 0xC9), *range(0x80, 0xC0)))
_BUT = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
_LETTERS = bytes((*range(97, 123), *range(0xC3, 0xC9), *range(0x80, 0xC0)))
#: A word's last byte in merges: a letter stands for itself in upper case, a later byte of one for a control or digit.
_LAST = {c: c - 32 if c < 128 else c - 128 for c in (*range(97, 123), *range(0x80, 0xC0))}


def unusual(text: bytes) -> bool:
    return b"<|" in text or not text.isascii() and (bool(text.translate(None, _USUAL)) or any(b in text for b in _BUT))


class WordEncoder:
    """Encodes texts word by word with the tokenizers library, and remembers the words.

    For tokenizers whose pattern cuts at white space, around runs of letters, at each digit and around contractions,
    and whose pieces end in an end-of-word token; the constructor probes for that. A word's ids are those of its pieces;
    many pieces are encoded as one text and told apart by their end-of-word tokens. Texts with unusual characters are
    cut at white space only, and their words left to the library.
    """

    def __init__(self, tokenizer_json: str, most: int = CACHED_WORDS):
        self.library = library_tokenizer(tokenizer_json)
        self.words, self.known = Remembered(most), Remembered(CACHED_PIECES)
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or not t.content.startswith("<|") for t in added.values()):
            raise ValueError("an added token takes white space with it, or starts in another way")
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.merge = self._merger(json.loads(tokenizer_json)["model"])
        probe = b"Ab it's 12 x,y (a-b) I'LL q!"
        pieces = self._pieces(probe)
        if self._together(pieces) is None or [i for p in pieces for i in self._alone([p])[0]] != self.library.encode(probe.decode(), add_special_tokens=False).ids:
            raise ValueError("the pieces of this tokenizer are other ones")

    @staticmethod
    def _pieces(text: bytes) -> list[bytes]:
        # both bytes.split() and bytes.lower() know ASCII alone
        return text.split() if unusual(text) else _PIECE.findall(text.lower())

    @staticmethod
    def _merger(model: dict):
        """Merges of a word's bytes by rank with the tiktoken library, where the merges' order is that of their ids."""
        import tiktoken

        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if ids != sorted(ids) or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix") != "</w>":
            return None
        symbols, letters, ranks = byte_of_symbol(), set(_LETTERS), {}
        for token, i in model["vocab"].items():
            own = [symbols[c] for c in token.removesuffix("</w>")] if all(c in symbols for c in token.removesuffix("</w>")) else []
            if own and letters.issuperset(own) and (not token.endswith("</w>") or own[-1] in _LAST):
                ranks[bytes(own[:-1] + [_LAST[own[-1]] if token.endswith("</w>") else own[-1]])] = i
        if not all(bytes([c]) in ranks for c in (*_LETTERS, *_LAST.values())):
            return None
        merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        return lambda piece: merge(piece[:-1] + bytes((_LAST[piece[-1]],)))

    def _alone(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _together(self, pieces: list[bytes]) -> list[bytes] | None:
        """Each piece's ids as bytes, from one encoding of them all; None if its pieces are not these."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(pieces).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            return None
        data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def _merged(self, word: bytes) -> bytes | None:
        """The ids of a run of letters; None if it is something else."""
        if self.merge is None or word.translate(None, _LETTERS):
            return None
        if not word.isascii() and (unusual(word) or (word := word.decode().lower().encode()).translate(None, _LETTERS)):
            return None
        return array("I", self.merge(word)).tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        """Fills in pieces of usual text."""
        self.known.update({p: own for p in pieces if (own := self._merged(p)) is not None})
        rest = [p for p in pieces if p not in self.known]
        for at in range(0, len(rest), 2048):
            some = rest[at : at + 2048]
            found = self._together(some)
            self.known.update(zip(some, found if found is not None else [np.array(i, np.uint32).tobytes() for i in self._alone(some)], strict=True))

    def _learn_words(self, words: list[bytes]) -> None:
        """Fills in the words; those of unusual characters are left to the library."""
        own = {w: self._merged(w) for w in words}
        self.words.update(own)
        rest = [w for w, ids in own.items() if ids is None]
        odd = [w for w in rest if unusual(w)]
        for at in range(0, len(odd), 2048):
            some = odd[at : at + 2048]
            self.words.update(zip(some, [np.array(i, np.uint32).tobytes() for i in self._alone(some)], strict=True))
        rest = [w for w in rest if self.words[w] is None]
        split = [_PIECE.findall(w.lower()) for w in rest]
        new = self.known.unknown(set().union(*split))
        self._learn(new)
        get = self.known.__getitem__
        self.words.update(zip(rest, [b"".join(map(get, pieces)) for pieces in split], strict=True))
        self.known.settle(new)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        # equal words are found by their hashes, and then compared byte for byte
        plain = [t if unusual(t) else t.lower() for t in texts]
        buffer = b"\n".join(plain)
        hashes, starts, ends = wordhash.placed_words(buffer)
        _, some, number = np.unique(hashes, return_index=True, return_inverse=True)
        if not _same(np.frombuffer(buffer, np.uint8), starts, ends, some[number]):
            some = number = np.arange(len(hashes))
        distinct = [buffer[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        new = self.words.unknown(set(distinct))
        self._learn_words(new)
        own = list(map(self.words.__getitem__, distinct))
        self.words.settle(new)
        # each distinct word's ids once, in one array; the texts are gathered from it by number
        flat = np.frombuffer(b"".join(own), np.uint32)
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        begins = (np.cumsum(lengths) - lengths)[number]
        counts = lengths[number]
        until = np.cumsum(counts)
        ids = flat[_ranges(begins, counts)]
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in plain)]))
        at = np.concatenate(([0], until))[first]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, .., for counts[0] numbers, and so on."""
    until = np.cumsum(counts)
    kind = np.int32 if len(until) and max(until[-1], begins.max() + counts.max()) < 1 << 31 else np.int64
    return np.arange(until[-1] if len(until) else 0, dtype=kind) + np.repeat((begins - until + counts).astype(kind), counts)


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether every word is that with the number in `other`."""
    sizes = ends - starts
    return bool((sizes == sizes[other]).all()) and all(np.array_equal(data[_ranges(starts[k : k + 65536], sizes[k : k + 65536])], data[_ranges(starts[other[k : k + 65536]], sizes[k : k + 65536])]) for k in range(0, len(starts), 65536))


def id_type(tokenizer_json: str, end_id: int) -> str:
    """16-bit numbers where all ids fit, for the shuffle's sake."""
    described = json.loads(tokenizer_json)
    return "<u2" if max(end_id, *described["model"]["vocab"].values(), *(t["id"] for t in described["added_tokens"]), 0) < 1 << 16 else "<u4"


Key = tuple[bool, int, int]


def key_of(doc_id: int | None, tie: int) -> Key:
    return doc_id is not None, doc_id or 0, tie


def shard_bounds(docs: DataFrame, shards: int) -> list[Key]:
    """Keys that part the rows into about equal shards, from about SAMPLED rows a shard of smallest hash (twice at most).

    A key that very many rows share is several bounds in a row.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("at"))
    some = sorted(key_of(r["doc_id"], r["tie"]) for r in sampled(keys, "at", SAMPLED * shards).select("doc_id", "tie").collect())
    return [some[len(some) * k // shards] for k in range(1, shards)] if some else []


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int, bounds: list[Key]) -> DataFrame:
    """Per row: shard, doc_id, tie (a hash of the text), n_tokens, and the ids as little-endian numbers of id_type, the
    end id included. Rows at a key that is several bounds are dealt to all shards between them."""
    sent, kind = docs.sparkSession.sparkContext.broadcast((tokenizer_json, bounds)), id_type(tokenizer_json, end_id)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, edges = sent.value
        encoder = once_a_worker(("word encoder", text), lambda: WordEncoder(text))
        raw, ids, end = utf8(batch.column(1)), [], np.array([end_id], kind).tobytes()
        for a, b in steps(raw, 1 << 20):
            ids += [own.astype(kind).tobytes() + end for own in encoder(raw[a:b])]
        shards = []
        for k, (doc, tie) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            key = key_of(doc, tie)
            least, most = bisect_left(edges, key), bisect_right(edges, key)
            shards.append(least + (k % (most - least + 1) if most > least + 1 else most - least))
        counts = pa.array([len(own) // np.dtype(kind).itemsize for own in ids], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0), batch.column(2), counts, pa.array(ids, pa.binary())], names=["shard", "doc_id", "tie", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return map_batches(rows, run, "shard int, doc_id long, tie long, n_tokens long, ids binary")


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, path: str, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Writes segments (shard, segment, n_docs, n_tokens, payload) to path; shard, then segment, is doc_id order."""
    spark, kind = docs.sparkSession, id_type(tokenizer_json, end_id)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # more shards than tasks, so that tasks, to which a hash deals the shards, have about as many rows each
    ordered = encoded(docs, tokenizer_json, end_id, shard_bounds(docs, 4 * tasks)).repartition(tasks, "shard")
    ordered = ordered.sortWithinPartitions("shard", "doc_id", "tie").select("shard", "doc_id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, total = -1, 0, 0
        ids: list[bytes] = []
        held: list[int | None] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            first = np.concatenate(([0], np.cumsum(counts)))
            payload = dac.encode(np.frombuffer(b"".join(ids), kind), held, first)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "n_docs": pa.array([len(held)], pa.int64()), "n_tokens": pa.array([int(first[-1])], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for part in (part for batch in batches for part in sliced(batch)):
            for of, doc, n, own in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (of != shard or total >= segment_tokens):
                    yield flush()
                    ids, held, counts, total, number = [], [], [], 0, number + 1
                if of != shard:
                    shard, number = of, 0
                ids.append(own)
                held.append(doc)
                counts.append(n)
                total += n
        if held:
            yield flush()

    ordered.mapInArrow(run, "shard int, segment int, n_docs long, n_tokens long, payload binary").write.option("compression", "none").parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """segments (shard, segment, n_tokens, ..) with `begin`, the tokens before each. One row a segment, of some MB each:
    their running sum is small, and needs their order only."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    in_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("begin", F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0))).join(shards, "shard").withColumn("begin", F.col("begin") + F.col("shard_start")).drop("shard_start")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema("shard int, segment int, n_docs long, n_tokens long, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 1)):
            for shard, number, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                segment = dac.Segment(payload)
                ids, first = segment.all().astype("<u4"), segment.first
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(segment.doc_ids, pa.int64()), "shard": pa.array(np.full(len(first) - 1, shard), pa.int32()), "segment": pa.array(np.full(len(first) - 1, number), pa.int32()),
                    "within": pa.array(first[:-1]), "n_tokens": pa.array(np.diff(first)), "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.int64()),
                })

    rows = segments.select("shard", "segment", "payload").mapInArrow(run, "doc_id long, shard int, segment int, within long, n_tokens long, ids_crc32 long")
    starts = segment_starts(segments.drop("payload")).select("shard", "segment", F.col("begin").alias("segment_start"))
    return rows.join(starts, ["shard", "segment"]).select("doc_id", (F.col("segment_start") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


SEGMENT_SCHEMA = "shard int, segment int, n_docs long, n_tokens long, payload binary"


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(position, token) for positions, counted over the whole dataset, in wanted's `position`; those beyond it are left out.

    Only the segments that hold a wanted position are decoded, and of these only the asked tokens, level by level.
    """
    starts = segment_starts(spark.read.schema(SEGMENT_SCHEMA).parquet(path).drop("payload")).select("shard", "segment", "begin", (F.col("begin") + F.col("n_tokens")).alias("end"))
    # segments are long, so a coarse cell of positions meets few of them: an equality join, no range scan of all
    cell = lambda c: F.floor(c / SEGMENT_TOKENS)
    filed = starts.where("end > begin").withColumn("cell", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end") - 1))))
    asked = wanted.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct().withColumn("cell", cell(F.col("position")))
    hits = asked.join(F.broadcast(filed) if few(filed) else filed, "cell").where("position >= begin and position < end").select("shard", "segment", "position", (F.col("position") - F.col("begin")).alias("within"))
    lists = hits.groupBy("shard", "segment").agg(F.collect_list(F.struct("position", "within")).alias("asked"))  # distinct, so a segment's tokens at most
    payloads = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("shard", "segment", "payload").join(lists, ["shard", "segment"]).select("payload", F.col("asked.position").alias("positions"), F.col("asked.within").alias("within"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        positions, tokens = [], []
        for payload, own, within in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            segment = dac.Segment(payload)
            positions += own
            tokens += [segment.access(k) for k in within]
        return pa.RecordBatch.from_arrays([pa.array(positions, pa.int64()), pa.array(tokens, pa.int64())], names=["position", "token"])

    return map_batches(payloads, run, "position long, token long")


def token_table(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tarn/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_json, end_id, path)
    return read_documents(spark, path)
