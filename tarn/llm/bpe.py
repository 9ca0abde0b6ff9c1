"""Byte-level BPE by forced boundaries: encode fragments independently, concatenate, decode from the ids.

A pair of bytes that never lies inside any vocabulary token can't be inside a token of any encoding, so no merge ever
crosses it. Where in addition the first byte ends a visible character and the second is ASCII white space, or an ASCII
letter meets punctuation, the pattern that splits text before the merges ends a piece there too and looks no further
back or ahead: such a cut is certain. Fragments between certain cuts are encoded on their own and remembered, as texts
repeat them; long ones are not, so that what a worker remembers is bounded in bytes.

Null texts are empty: no ids, and the empty text comes back. Rows are independent of each other, so repeated rows,
doc_ids and clashing names don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Remembered, byte_of_symbol, library_tokenizer, map_batches, once_a_worker, steps, utf8

CACHED_FRAGMENTS = 250_000


class ForcedBoundaryBpe:
    """Encoder and decoder for a byte-level tokenizer of the tokenizers library."""

    def __init__(self, tokenizer_json: str, most: int = CACHED_FRAGMENTS):
        self.library, self.known = library_tokenizer(tokenizer_json), Remembered(most)
        added = self.library.get_added_tokens_decoder()
        if self.library.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("cuts are certain only without a normalizer and added tokens that take white space")
        symbols = byte_of_symbol()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
        for symbol, i in vocabulary.items():
            self.bytes_of[i] = added[i].content.encode() if i in added else bytes(map(symbols.__getitem__, symbol))
        self.inside = np.zeros((256, 256), bool)
        for token in self.bytes_of:
            b = np.frombuffer(token or b"", np.uint8)
            self.inside[b[:-1], b[1:]] = True
        # Certain cuts among the pairs that are never inside: a visible character before white space, and an ASCII letter
        # before punctuation. Other pairs are left alone, as the pattern may look over them.
        last = lambda c: c.encode()[-1]
        visible = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x250))]
        white = "".join(w for w in "\t\n\r " if not self.inside[[last(c) for c in visible if c.isascii()], ord(w)].any())
        ends = "".join(c for c in visible if not self.inside[last(c), [ord(w) for w in white]].any())
        letters = [ord(c) for c in visible if c.isascii() and c.isalpha()]
        marks = "".join(c for c in visible if c.isascii() and not c.isalnum() and not self.inside[letters, ord(c)].any())
        self.cuts = (ends, white, marks)
        next_ = f"[{re.escape(white + marks)}]"
        if white and marks and all(chr(c) in ends for c in letters):
            word = rf"\x20?[A-Za-z]++(?={next_}|\Z)|"
            cut = rf"(?<=[A-Za-z])(?={next_})|(?<=[{re.escape(ends)}])(?=[{re.escape(white)}])|\Z"
        else:
            word, cut = "", r"\Z"
        self.merge = self._merger(tokenizer_json, set(added))
        self.fragment = re.compile(rf"{word}(?s:.+?)(?:{cut})")

    def fragments(self, text: str) -> list[str]:
        return self.fragment.findall(text)

    def _learn(self, fragments: list[str]) -> None:
        rest = fragments
        if self.merge is not None:  # ASCII words are one piece of the pattern each, and only its merges are to do
            merge = self.merge
            for f in fragments:
                if f.isascii() and f[f[0] == " " :].isalpha():
                    self.known[f] = (np.array(own := merge(f), np.uint32).tobytes(), ",".join(map(str, own)))
            rest = [f for f in fragments if f not in self.known]
        for at in range(0, len(rest), 2048):
            some = rest[at : at + 2048]
            for f, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[f] = (np.array(own := e.ids, np.uint32).tobytes(), ",".join(map(str, own)))

    def _merger(self, tokenizer_json: str, added: set[int]):
        """Merges by rank with the tiktoken library, where the merges' order is that of their results' ids."""
        import tiktoken

        model = json.loads(tokenizer_json)["model"]
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if ids != sorted(ids) or model.get("ignore_merges") or model.get("dropout"):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes_of) if b is not None and i not in added}
        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pieces(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        """For each text its fragments' ids, as 32-bit numbers and as text."""
        split = [self.fragments(t) for t in texts]
        new = self.known.unknown(set().union(*split))
        self._learn(new)
        get = self.known.__getitem__
        out = [list(map(get, fs)) for fs in split]
        self.known.settle(new)
        return out

    def encode(self, text: str) -> list[int]:
        return joined_ids(self.pieces([text])[0])

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False): bytes of all tokens, read as UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def joined_ids(parts: list[tuple[bytes, str]]) -> list[int]:
    return np.frombuffer(b"".join([own for own, _ in parts]), np.uint32).tolist()


def encoded(docs: DataFrame, tokenizer_json: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""
    text = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = once_a_worker(("byte bpe", text.value), lambda: ForcedBoundaryBpe(text.value))
        raw = utf8(batch.column(1))
        out: dict[str, list] = {"n": [], "ids": [], "decoded": [], "list": []}
        for begin, end in steps(raw, 1 << 20):
            for parts in bpe.pieces([t.decode() for t in raw[begin:end]]):
                ids = joined_ids(parts)
                out["n"].append(len(ids))
                out["ids"].append(hashlib.sha256(",".join([s for _, s in parts]).encode()).hexdigest())
                out["decoded"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    out["list"].append(np.array(ids, np.int32))
        columns = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["decoded"], pa.string())]
        if with_ids:
            columns.append(pa.array(out["list"], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
