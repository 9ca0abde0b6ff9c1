"""What the training-data operators share: scratch tables, Arrow batch bounds, tables by name."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.scratch import shared_dir, written  # noqa: F401

#: Rows that a worker handles in one step; with documents of some kB that is a few MB.
BATCH_ROWS = 512
#: Workers remember nothing under a longer key than LONGEST; once they are full, what is new is forgotten after its
#: step, until a share of MANY of a step's is new.
LONGEST, MANY = 48, 0.5
#: Keys (8 bytes each) up to which a table of keys is broadcast, after a count; beyond it is joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Bytes of text that a worker handles in one step; a longer document is its own step.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bound(rows: int, about: int) -> int | None:
    """What the hash of a key must be under for about so many of rows to be left; None to keep all."""
    return None if rows <= about else about * (1 << 64) // rows - (1 << 63)


def sampled(df: DataFrame, key: str, about: int) -> DataFrame:
    """About so many rows (twice that at most), those whose hash of key is smallest; all where there are no more."""
    bound = hash_bound(df.count(), about)
    return df if bound is None else df.where(F.xxhash64(key) < F.lit(bound)).limit(2 * about)


def few(rows: DataFrame, most: int = BROADCAST_KEYS) -> bool:
    """Whether there are at most so many rows, so that they may be broadcast."""
    return rows.limit(most + 1).count() <= most


def checked_broadcast(rows: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """rows marked for broadcast if there are few, else as they are, to be joined by shuffle."""
    return F.broadcast(rows) if few(rows, most) else rows


def sliced(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows. Spark bounds a batch in bytes, whatever its rows; the session's settings stay."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over the rows of df, BATCH_ROWS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(fn, sliced(batch))

    return df.mapInArrow(run, schema)


def library_tokenizer(tokenizer_json: str):
    """The tokenizers library's tokenizer, without truncation and padding, on the calling thread alone."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(tokenizer_json)
    out.no_truncation()
    out.no_padding()
    return out


class Remembered(dict):
    """What a worker remembers between steps: at most `most` entries, none with a key of over LONGEST bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def unknown(self, keys: set) -> list:
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most and len(new) > MANY * len(keys):
            self.clear()
            return list(keys)
        return new

    def settle(self, new: list) -> None:
        """After the step that filled them in, lets new keys go that there is no room for."""
        full = len(self) > self.most
        for k in new:
            if full or len(k) > LONGEST:
                del self[k]


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_per_worker: dict = {}


def once_a_worker(key: object, make: Callable[[], object]) -> object:
    """make()'s result, kept for the later tasks of this Python worker; only the latest of each kind of key."""
    kind = key[0]
    if _per_worker.get(kind, (None,))[0] != key:
        _per_worker[kind] = (key, make())
    return _per_worker[kind][1]


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
