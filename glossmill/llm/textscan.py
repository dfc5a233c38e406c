"""Vectorised scans over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; as the separators are ASCII,
this equals the code-point pattern ``[^\\x20\\x09-\\x0D]+``. Texts are laid one after another with a
newline behind each, so no word or line spans two of them. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIZE = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def at_place(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values mixed with their place in a sequence; sums of them hash the sequence."""
    return mix(values + (place.astype(np.uint64) + np.uint64(1)) * _STEP)


def sequence_hashes(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of some consecutive, non-empty runs that together are ``values`` from ``first[0]`` on.

    Every value is mixed with its place before the sum is taken, so no regular pattern of values cancels out.
    """
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    terms = at_place(values[first[0] : first[0] + len(place)], place)
    return mix(np.add.reduceat(terms, np.cumsum(size) - size) ^ size.astype(np.uint64) * _SIZE)


def chained(values: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of the n values from each place of ``at`` on."""
    h = np.full(len(at), seed, np.uint64)
    for k in range(n):
        h = mix(h + values[at + k])
    return h


def trim() -> None:
    """Hand the memory that a chunk took back to the system; a worker keeps it otherwise, however small its next task."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


@functools.lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library
        return None


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together (one text at least), with the first's index."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class Words:
    """The words of a block: byte positions, the text of each, a 64-bit hash of each."""

    buf: np.ndarray
    doc_start: np.ndarray  # one more than there are texts; each text is followed by one newline byte
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word; one more than there are texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return buf, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range; ranges don't overlap. Eight bytes at a time are mixed with their place, then summed."""
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    out = at_place(eights[start] & _KEEP[np.minimum(size, 8)], np.zeros(1))
    long = np.flatnonzero(size > 8)
    if len(long):
        steps = (size[long] - 1) // 8  # beyond the first eight bytes
        place = 1 + np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
        at = np.repeat(start[long], steps) + 8 * place
        left = np.repeat(end[long], steps) - at
        out[long] += np.add.reduceat(at_place(eights[at] & _KEEP[np.minimum(left, 8)], place), np.cumsum(steps) - steps)
    return mix(out ^ size.astype(np.uint64) * _SIZE)


def scan_words(texts: list[bytes], lower: bool = False) -> Words:
    buf, doc_start = lay(texts)
    if lower:
        buf = LOWER[buf]
    inside = np.concatenate([[False], ~SPACE[buf]])  # the last byte is a newline
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    first = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, doc_start, start, end, doc, span_hashes(buf, start, end), first)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and starting word of every run of n words that stays within its text."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    return chained(words.hash, at, n), at


def in_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made to differ between texts."""
    return mix(h ^ mix(doc.astype(np.uint64) + np.uint64(0x51ED270B)))


def per_text(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)
