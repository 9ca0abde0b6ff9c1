"""Token ids as directly addressable codes: a file format with random access to any token.

Ids are cut into chunks of bits, low bits first. Level k holds the k-th chunk of every id that is long enough to have
one; a bitmap of the level has a 1 where the id goes on to the next level, and a directory holds the number of ones
before every BLOCK bits. Token i is read by following at most `levels` positions: pos' = ones before pos.

A segment is a self-contained byte string: header, level table, then the document table (doc ids and first tokens) and
the levels. Segments are the rows of a Parquet folder, so Spark's commit protocol makes a file appear whole or not at
all, on any store; their payload is not encoded by Parquet a second time. All numbers are little-endian.

    magic 'TDAC' | u32 version | u64 n_docs | u64 n_tokens | u32 levels | u32 doc_id_nulls_bytes
    levels x (u32 bits | u64 n | u64 chunk bytes | u64 bitmap bytes | u64 directory bytes)
    doc ids i64 | null mask u8 | first tokens u64 (n_docs + 1) | levels: chunks, bitmap, directory
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, VERSION, BLOCK = b"TDAC", 1, 512
_HEAD, _LEVEL = struct.Struct("<4sIQQII"), struct.Struct("<IQQQQ")
#: Chunk widths of the levels. 8 and 16 bits are read as they lie; together they hold any 32-bit id.
WIDTHS = (8, 8, 16)


def encode(ids: np.ndarray, doc_ids: list[int | None], first: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """A segment of all ids; document d has the tokens first[d] to first[d + 1]."""
    left, levels = ids.astype(np.uint32), []
    for k, bits in enumerate(widths):
        kind = np.uint8 if bits <= 8 else np.uint16
        chunk, rest = (left & np.uint32((1 << bits) - 1)).astype(kind), left >> np.uint32(bits)
        more = rest > 0 if k + 1 < len(widths) else np.zeros(len(left), bool)
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
        directory = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
        levels.append((bits, len(left), chunk.tobytes(), bitmap.tobytes(), directory.tobytes()))
        left = rest[more]
        if not len(left):
            break
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(levels), len(nulls))
    table = b"".join(_LEVEL.pack(bits, n, len(c), len(b), len(d)) for bits, n, c, b, d in levels)
    return b"".join([head, table, known.tobytes(), nulls.tobytes(), first.astype("<u8").tobytes(), *(x for _, _, c, b, d in levels for x in (c, b, d))])


class Segment:
    """Reads a segment; access() touches a few words, all() decodes every id."""

    def __init__(self, data: bytes):
        magic, version, n_docs, self.n_tokens, levels, nulls = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment of this version")
        table = [_LEVEL.unpack_from(data, _HEAD.size + k * _LEVEL.size) for k in range(levels)]
        at = _HEAD.size + levels * _LEVEL.size

        def take(kind: str, size: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at)
            at += size
            return out

        ids, missing = take("<i8", 8 * n_docs), take("u1", nulls)
        self.doc_ids = [None if m else int(i) for i, m in zip(ids, missing, strict=True)]
        self.first = take("<u8", 8 * (n_docs + 1)).astype(np.int64)
        self.levels = [(bits, n, take("u1" if bits <= 8 else "<u2", c), take("u1", b), take("<u4", d)) for bits, n, c, b, d in table]

    def _rank(self, level: int, pos: int) -> int:
        """Ones before bit pos: the directory, then the bytes of one block."""
        _, _, _, bitmap, directory = self.levels[level]
        block = pos // BLOCK
        tail = np.unpackbits(bitmap[block * BLOCK // 8 : pos // 8 + 1], bitorder="little")[: pos - block * BLOCK]
        return int(directory[block]) + int(tail.sum())

    def access(self, pos: int) -> int:
        """Token pos of the segment."""
        value = shift = 0
        for level, (bits, _, chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[pos]) << shift
            shift += bits
            if not bitmap[pos // 8] >> (pos % 8) & 1:
                break
            pos = self._rank(level, pos)
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Tokens begin to end, read level by level."""
        out, at, shift = np.zeros(end - begin, np.uint32), np.arange(end - begin), 0
        for level, (bits, _, chunk, bitmap, _) in enumerate(self.levels):
            out[at] |= chunk[begin:end].astype(np.uint32) << np.uint32(shift)
            shift += bits
            byte = begin // 8
            more = np.flatnonzero(np.unpackbits(bitmap[byte : (end + 7) // 8], bitorder="little")[begin - byte * 8 : end - byte * 8])
            if not len(more) or level + 1 == len(self.levels):
                break
            at, begin, end = at[more], (b := self._rank(level, begin)), b + len(more)
        return out

    def all(self) -> np.ndarray:
        return self.tokens(0, self.n_tokens)
