"""64-bit hashes of words and word windows for whole batches of texts, in numpy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D. Its hash is a sum of table values of its bytes times
powers of an odd number, mod 2**64, then mixed; so prefix sums over a buffer give all words at once.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: All of ASCII but letters and digits; what UTF-8 makes of other characters belongs to words.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 (public domain)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE * 2)
        _powers[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _piece(buffer: np.ndarray, lower: bool, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = between[buffer]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers_to(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[_LOWER[buffer] if lower else buffer] * up, out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes], lower: bool = False, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and for each text the place of its first one, with the total at the end."""
    hashes, starts, _ = placed_words(b"\n".join(texts), lower, between)
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def placed_words(text: bytes, lower: bool = False, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words, and where each begins and ends; `between` marks the bytes that are in no word.

    Work goes in pieces of about a megabyte cut at white space, so that a very long text needs little more memory
    than itself.
    """
    whole = np.frombuffer(text, np.uint8)
    starts, ends, hashes, begin = [], [], [], 0
    while begin < len(whole):
        end = begin + _PIECE
        while end < len(whole):
            if len(found := np.flatnonzero(between[whole[end : end + 4096]])):
                end += int(found[0])
                break
            end += 4096
        own, until, hashed = _piece(whole[begin:end], lower, between)
        starts.append(own + begin)
        ends.append(until + begin)
        hashes.append(hashed)
        begin = min(end, len(whole))
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; those over the border of two texts are for the caller to leave out."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + mix(hashes[k : k + n] + np.uint64((k + 1) * int(_BASE) % (1 << 64)))
    return mix(out)
