"""Array kernels over the bytes of many texts at once.

Texts come as one byte array and offsets. Prefix sums of ``table[byte] * base^i``
modulo 2^64 give the polynomial hash of any range in constant time; hashes are
finished by a mixer, since the low bits of such sums are weak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are handled in groups of about so many bytes; a longer text is handled alone.
GROUP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finisher: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    return mix(mix(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(seed * 7919 + 1)))


BYTE_VALUES = random_words(256, 11)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges; equal bytes hash alike wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_class(separators: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in separators]] = True
    return table


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Fixed value: what parts words in the near-duplicate contract.
BLANK = byte_class(" \t\n\x0b\x0c\r")


def word_ranges(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = separator[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


SHINGLE = 5
_FACTORS = random_words(SHINGLE, 23) | U64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of each text, in order, and n + 1 offsets.

    ``words`` are word hashes, ``first`` the n + 1 offsets of the texts in them. A text
    of one to four words has one shingle, of all its words; one without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], U64)
    if len(words) >= SHINGLE:
        full = len(words) - SHINGLE + 1
        total = np.zeros(full, U64)
        for j in range(SHINGLE):
            total += words[j : j + full] * _FACTORS[j]
        long = counts >= SHINGLE
        index = np.repeat(first[:-1][long] - at[:-1][long], n[long]) + np.flatnonzero(np.repeat(long, n))
        out[np.repeat(long, n)] = total[index]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = words[first[i] : first[i + 1]]
        out[at[i]] = (own * _FACTORS[: len(own)]).sum(dtype=U64) + U64(len(own))
    return mix(out), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each lower-cased text, and n + 1 offsets."""
    low = ASCII_LOWER[data]
    starts, ends, first = word_ranges(low, offsets)
    hashes, at = shingle_hashes(range_hashes(prefix_hashes(low), starts, ends), first)
    sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """Shingle set of each text, worked out over about ``GROUP_BYTES`` at a time."""
    out: list[np.ndarray] = []
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    for lo, hi in groups(offsets):
        hashes, at = shingle_sets(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offsets[lo : hi + 1] - offsets[lo])
        out += [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def signatures(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """MinHash signature, k 32-bit values a set; all ones for an empty set."""
    out = np.full((len(at) - 1, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        factors, shifts = random_words(k, 31) | U64(1), random_words(k, 37)
        for j in range(k):
            out[full, j] = np.minimum.reduceat((hashes * factors[j] + shifts[j]) >> U64(32), at[full]).astype(np.uint32)
    return out
