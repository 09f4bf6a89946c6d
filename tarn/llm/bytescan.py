"""Words of many texts at once, found in the bytes of an Arrow column with NumPy.

A column of texts is one buffer of bytes and one of offsets. cut() hands out blocks of whole texts of about
BLOCK bytes, so that temporary arrays stay a small multiple of that; a longer text is a block of its own.
words() finds maximal runs of bytes outside a class; distinct() numbers equal words: words are sorted by the high bits of a
64-bit hash, and neighbours of equal hash are compared byte by byte. Where a comparison fails (a collision) the
block is numbered by a dict of the words themselves, so results never rest on the hash.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 4 << 20
_LONG = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def byte_class(members: bytes) -> np.ndarray:
    """A table of 256 booleans, true for the given bytes."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Texts:
    """Texts first .. first + size - 1 of a column: bytes data[0:n] followed by eight zero bytes; text i is data[at[i]:at[i + 1]]."""

    first: int
    size: int
    data: np.ndarray
    at: np.ndarray

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The number of true flags in each text, from prefix sums over its bytes."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.at])


@dataclass
class Runs:
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray


def cut(column: pa.Array, limit: int = BLOCK) -> Iterator[Texts]:
    """Blocks of the column's texts; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        padded = np.zeros(int(at[j] - at[i]) + 8, np.uint8)
        padded[:-8] = data[at[i] : at[j]]
        yield Texts(i, j - i, padded, at[i : j + 1] - at[i])
        i = j


def words(block: Texts, outside: np.ndarray) -> Runs:
    """Maximal runs of bytes that aren't in the class `outside`; runs end with their text."""
    inner = np.zeros(len(block.data) - 6, bool)  # one byte before, one after
    inner[1:-1] = ~outside[block.data[:-8]]
    opens = inner[1:-1] & ~inner[:-2]
    closes = inner[1:-1] & ~inner[2:]
    edges = block.at[1:-1]
    at = edges[edges < len(opens)]
    opens[at] = inner[1:-1][at]
    at = edges[edges > 0] - 1
    closes[at] = inner[1:-1][at]
    start = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - start
    counts = np.diff(np.searchsorted(start, block.at))
    return Runs(start, length, np.repeat(np.arange(block.size), counts))


def _eights(data: np.ndarray) -> np.ndarray:
    """data read as a little-endian 64-bit number at every position."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:start + length], the same for equal bytes in any block and process."""
    view = _eights(data)
    h = (view[start] & _MASK[np.minimum(length, 8)]) * _M1 + length.astype(np.uint64)
    at, k = np.flatnonzero(length > 8), 8
    while len(at) and k < _LONG:
        x = h[at]
        h[at] = (x ^ (x >> np.uint64(29))) * _M2 + (view[start[at] + k] & _MASK[np.minimum(length[at] - k, 8)])
        k += 8
        at = at[length[at] > k]
    for i in at.tolist():
        s = int(start[i])
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[s : s + int(length[i])]))
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def _equal(data: np.ndarray, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether word a[i] has the bytes of word b[i] for every i."""
    if (length[a] != length[b]).any():
        return False
    view, k = _eights(data), 0
    while len(a) and k < _LONG:
        mask = _MASK[np.minimum(length[a] - k, 8)]
        if ((view[start[a] + k] ^ view[start[b] + k]) & mask).any():
            return False
        k += 8
        more = length[a] > k
        a, b = a[more], b[more]
    cut = lambda i: data[start[i] : start[i] + length[i]]
    return all(np.array_equal(cut(i), cut(j)) for i, j in zip(a.tolist(), b.tolist(), strict=True))


def distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's class, a member of each class): words of one group with the same bytes are a class."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the place stands in the key's low bits: sorting numbers takes a fraction of the time that sorting places by them does
    bits = np.uint64(max(1, (len(start) - 1).bit_length()))
    keys = ((h ^ (group.astype(np.uint64) * _M1)) >> bits << bits) | np.arange(len(start), dtype=np.uint64)
    keys.sort()
    order = (keys & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    keys >>= bits
    new = np.empty(len(order), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    same = np.flatnonzero(~new)
    ids = np.empty(len(order), np.int64)
    sizes, eight, groups = length[order], (_eights(data)[start] & _MASK[np.minimum(length, 8)])[order], group[order]
    differ = (sizes[1:] != sizes[:-1]) | (eight[1:] != eight[:-1]) | (groups[1:] != groups[:-1])
    long = same[sizes[same] > 8]
    if not (differ & ~new[1:]).any() and _equal(data, start, length, order[long], order[long - 1]):
        ids[order] = np.cumsum(new) - 1
        return ids, order[new]
    seen: dict[tuple[int, bytes], int] = {}
    members = []
    for i, (g, s, n) in enumerate(zip(group.tolist(), start.tolist(), length.tolist(), strict=True)):
        word = (g, data[s : s + n].tobytes())
        ids[i] = seen.setdefault(word, len(seen))
        if len(seen) > len(members):
            members.append(i)
    return ids, np.array(members, np.int64)


def strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The words as an Arrow column of binaries."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[spread(start, length)])])


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[0], start[0] + 1, ..., for length[0] of them, then those of the next, and so on."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)
