"""Shared pieces: file systems, and word hashing over Arrow buffers. Tables are stored in the folder all executors share."""

from __future__ import annotations

import ctypes
import sys

import numpy as np

from ..storage import batches_of, drop, new_path, release, shared_dir, stored

__all__ = ["batches_of", "drop", "give_back", "new_path", "open_fs", "release", "shared_dir", "stored", "text_buffer", "word_hashes", "mix", "LOWER", "SPACES"]

#: The characters between words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def open_fs(uri: str):
    """A pyarrow file system and the path in it, for file:, hdfs:, s3: and gs: addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def give_back() -> None:
    """Returns the memory that a reused Python worker holds on to: encoders of earlier steps, and what allocators keep."""
    import pyarrow as pa

    if tokens := sys.modules.get(__package__ + ".tokens"):
        tokens._made.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd_powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(0x9E3779B97F4A7C15)
    return np.multiply.accumulate(out)


CHUNK = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWER = _odd_powers(64)
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and where each row starts and ends; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[:1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each row, the words' first word index by row (with the end), and the words' byte starts.

    A row's boundary ends a word. table maps bytes first; space tells which mapped bytes part words."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
    inside = ~space[table][data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    hashes = np.empty(len(starts), np.uint64)
    # In chunks of words of about a megabyte, for the wide arrays' sake.
    cuts = np.unique(np.searchsorted(starts, np.arange(0, n + CHUNK, CHUNK)))
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = starts[a], starts[b] if b < len(starts) else n
        kept = np.flatnonzero(inside[lo:hi])
        own = starts[a:b] - lo
        word = np.cumsum(first[lo:hi][kept], dtype=np.int32) - 1
        place = kept - own[word]
        value = _BYTE[table[data[lo:hi][kept]]]
        value *= (_POWER if place.max() < len(_POWER) else _odd_powers(int(place.max()) + 1))[place]
        hashes[a:b] = mix(np.add.reduceat(value, np.searchsorted(kept, own)) + np.uint64(1))
    return hashes, np.searchsorted(starts, offsets), starts
