"""Quality rules with compression bands: zstandard ratios of whole documents and of fixed chunks.

The base rules count words, symbols, repeated lines and repeated windows of words. The bands then compare compressed
with plain size: text that shrinks far more than the corpus's text of its length is repetitive, text that hardly
shrinks is noise. The ratio falls with length, so each class of a quarter octave has limits of its own, apart for each
quarter of bytes outside ASCII, as scripts of several bytes a character shrink otherwise.

The limits come from the corpus itself, labels unseen: `fitted` takes the quartiles of the ratios of all texts and
chunks that pass the base, equal ones counted once, so that copies don't weigh. The lower limit lies REACH times the
lower quartile's distance under the median (3.4 deviations of a normal law), but at LEAST of the median, as text that
shrinks twice as far as usual is repetitive however wide a class spreads; the upper one lies as far above, or by
LEAST_UPPER of the median if that is more: noise stands well apart from text (hexadecimal digits, the mildest, take 14%
more), while another language in the corpus may lie a little above. With n texts in a class, median and distances are
means of its own, weighing n, and those of general prose (`expected`), weighing PRIOR_TEXTS, so that rare classes have
wide limits.

Every chunk of CHUNK_BYTES is held against the limits of its own size, so that a repetitive or random stretch of a long
document is seen; a document is rejected when a chunk is out of band.

Null and empty texts have no words and fail the base. Any length is handled whole. Given the limits rows are
independent, so ties and repeated rows don't matter; an empty table gives an empty result; extra columns are passed over
(or, in kept_documents, kept as they are).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import wordhash
from tarn.llm.common import map_batches, steps, utf8

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
CHUNK_BYTES, LEVEL = 8192, 1
REACH, LEAST_UPPER, LEAST = 5.0, 0.12, 0.5
PRIOR_TEXTS = 20
#: Distances of the quartiles of general prose from its median, as shares of it.
PRIOR_LOWER, PRIOR_UPPER = 0.08, 0.05
#: Ratios are counted in steps of 1 / STEP.
STEP = 10_000
Limits = dict[int, tuple[float, float]]
SYMBOLS = b"#*$%&|<>"
_WORD = re.compile(rb"[^\x20\x09-\x0D]")
_CONTINUES = bytes(range(128, 192))
_SPACES = bytes([32, *range(9, 14)])


_HIGH = bytes(range(128, 256))


def class_of(data: bytes) -> int:
    """The quarter octave of the size, times four, and the quarter of the share of bytes outside ASCII."""
    outside = len(data) - len(data.translate(None, _HIGH))
    return 4 * int(4 * math.log2(len(data))) + min(3, 4 * outside // len(data))


def expected(size: float) -> float:
    """The median ratio of general prose of a size, as licences and manuals have it at level 1."""
    return 0.33 + 3 * size**-0.37


def limits_of(kind: int, n: int = 0, lower: float = 0.0, median: float = 0.0, upper: float = 0.0) -> tuple[float, float]:
    """Least and most ratio of a class in which n texts have these quartiles."""
    usual, own = expected(2 ** ((kind // 4 + 0.5) / 4)), n / (n + PRIOR_TEXTS)
    below = own * (median - lower) + (1 - own) * PRIOR_LOWER * usual
    above = own * (upper - median) + (1 - own) * PRIOR_UPPER * usual
    middle = own * median + (1 - own) * usual
    return max(middle - REACH * below, LEAST * middle), middle + max(REACH * above, LEAST_UPPER * middle)


class Compressor:
    """Ratios and verdicts under given limits; classes that these don't hold have those of general prose."""

    def __init__(self, limits: Limits | None = None, level: int = LEVEL):
        import zstandard

        self._one = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self._limits = limits or {}

    def ratio(self, data: bytes) -> float:
        return len(self._one.compress(data)) / len(data)

    def within(self, data: bytes, ratio: float) -> bool:
        kind = class_of(data)
        low, high = self._limits.get(kind) or limits_of(kind)
        return low <= ratio <= high

    def verdict(self, data: bytes) -> tuple[float, float, bool]:
        """The ratio of the whole, the share of chunks out of band, and whether the document is within its bands."""
        if not data:
            return 1.0, 0.0, True
        whole = self.ratio(data)
        held = [self.within(x, self.ratio(x)) for x in chunks(data)]
        share = held.count(False) / len(held) if held else 0.0
        return whole, share, self.within(data, whole) and all(held)


def chunks(data: bytes) -> Iterator[bytes]:
    """The chunks of a text of more than one."""
    if len(data) > CHUNK_BYTES:
        for k in range(0, len(data), CHUNK_BYTES):
            yield data[k : k + CHUNK_BYTES]


def base_fails(n_words: int, n_repeats: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeats > MAX_REPEAT_PERCENT * n_words


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    grams = wordhash.windows(hashes, WINDOW)
    if len(grams) < 2:
        return 0
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    hit = twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams
    delta = np.zeros(len(hashes) + 1, np.int32)
    delta[:-WINDOW] += hit
    delta[WINDOW:] -= hit
    return int((np.cumsum(delta[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if _WORD.search(x)]
    return len(lines) - len(set(lines))


def measured(texts: list[bytes], compressor: Compressor) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "chunks_out", "kept")}
    for begin, end in steps(texts, 1 << 20):
        some = texts[begin:end]
        hashes, first = wordhash.words(some)
        for k, text in enumerate(some):
            n, repeats = int(first[k + 1] - first[k]), repeated_words(hashes[first[k] : first[k + 1]])
            failed = base_fails(n, repeats)
            ratio, share, fine = compressor.verdict(text)
            row = (n, len(text.translate(None, _CONTINUES + _SPACES)), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeats, failed, ratio, share, fine and not failed)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
    return out


_TYPES = {"base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "chunks_out": pa.float64()}


def ratios(docs: DataFrame) -> DataFrame:
    """A row for each text that passes the base, and for each of its chunks: hash, class, and ratio in steps."""
    held: list[Compressor] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held or held.append(Compressor())
        out: tuple[list, list, list] = [], [], []
        texts = utf8(batch.column(0))
        for begin, end in steps(texts, 1 << 20):
            hashes, first = wordhash.words(texts[begin:end])
            for k, text in enumerate(texts[begin:end]):
                mine = hashes[first[k] : first[k + 1]]
                if base_fails(len(mine), repeated_words(mine)):
                    continue
                for x in (text, *chunks(text)):
                    row = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True), class_of(x), int(STEP * held[0].ratio(x))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["hash", "kind", "step"])

    return map_batches(docs.select("text"), run, "hash long, kind int, step int")


def fitted(docs: DataFrame) -> Limits:
    """Limits of every class of docs, from the quartiles of all ratios of different texts and chunks.

    Ratios are counted in steps before any class is gathered, so a class is some thousand counts at any size of the
    corpus; what comes to the driver is a row a class, some hundred of them.
    """
    counts = ratios(docs).distinct().groupBy("kind", "step").agg(F.count("*").alias("n"))
    upto = counts.select("kind", "step", F.sum("n").over(Window.partitionBy("kind").orderBy("step")).alias("upto"), F.sum("n").over(Window.partitionBy("kind")).alias("n"))
    quartile = [F.min(F.when(4 * F.col("upto") >= q * F.col("n"), F.col("step"))) / STEP for q in (1, 2, 3)]
    rows = upto.groupBy("kind").agg(F.max("n").alias("n"), *(c.alias(x) for c, x in zip(quartile, ("lower", "median", "upper"), strict=True)))
    return {r["kind"]: limits_of(**r.asDict()) for r in rows.collect()}


def quality(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, the whole's ratio, the share of chunks out of band, and kept.

    The limits are fitted to docs unless given."""
    limits = fitted(docs) if limits is None else limits
    held: list[Compressor] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held or held.append(Compressor(limits))
        found = measured(utf8(batch.column(1)), held[0])
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, _TYPES.get(k, pa.int64())) for k, v in found.items())], names=["doc_id", *found])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks_out double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def kept_documents(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; the limits are fitted to docs unless given."""
    limits = fitted(docs) if limits is None else limits
    held, place = [], docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held or held.append(Compressor(limits))
        return batch.filter(pa.array(measured(utf8(batch.column(place)), held[0])["kept"], pa.bool_()))

    return map_batches(docs, run, docs.schema)
