"""Texts cut into pieces whose tokens don't depend on their surroundings, so that rules see each distinct piece once.

A piece is a stretch without ASCII white space, or less: where a stretch has no ``@``, ``/`` or ``www.``, so that
neither an address nor a URL can lie in it, marks that no token of several characters holds stand alone. Whatever
isn't certain stays in a piece: the tokenizer then cuts it as it would have cut it within the text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE_BYTES = 4 << 20

#: Of each byte: white space; a mark; a mark unless a digit may follow; a sign of addresses and URLs.
BLANK, MARK, POINT, ADDRESS = 1, 2, 4, 8
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = BLANK
CLASS[list(b'!"$%&()*;<=>?[\\]^`{|}~')] = MARK
CLASS[list(b".,:")] = POINT
CLASS[list(b"@/")] = ADDRESS
#: ASCII but digits: what may follow a mark that numbers hold, too.
FREE = np.array([i < 0x80 and not 0x30 <= i <= 0x39 for i in range(256)])
#: Marks and white space of several bytes in UTF-8, by their first two bytes: which third bytes.
LONG = {b"\xe2\x80": [x for x in range(0x80, 0xC0) if x != 0x99], b"\xe3\x80": [0x80, 0x81, 0x82], b"\xef\xbc": [0x81, 0x8C, 0x9F]}


def cut_up(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts (a string array): the pieces as a string array, how many each text has, and of each piece where
    it starts in its text and how long it is, in code points. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    none = np.zeros(0, np.int64)
    if len(texts) == 0 or bounds[-1] == bounds[0]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64), none, none
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds, n = bounds - bounds[0], bounds[-1] - bounds[0]
    kind = CLASS[data]
    blank = kind == BLANK
    starts = bounds[:-1][bounds[:-1] < n]
    edge = np.zeros(n + 1, bool)  # a piece or white space begins here
    edge[1:n] = blank[1:] != blank[:-1]
    edge[starts] = edge[0] = edge[n] = True
    # marks that stand alone
    alone = kind == MARK
    point = np.flatnonzero(kind == POINT)
    follow = np.minimum(point + 1, n - 1)
    last = np.zeros(n + 1, bool)
    last[bounds] = True
    alone[point[FREE[data[follow]] | last[point + 1]]] = True
    wide = np.zeros(n, bool)
    if n > 2:
        for head, thirds in LONG.items():
            at = np.flatnonzero((data[:-2] == head[0]) & (data[1:-1] == head[1]))
            wide[at[np.isin(data[at + 2], thirds)]] = True
    # no marks where a stretch may hold an address
    stretch = np.flatnonzero(edge[:-1])
    held = kind == ADDRESS
    if n > 3:
        w = data == ord("w")
        held[:-3] |= w[:-3] & w[1:-2] & w[2:-1] & (data[3:] == ord("."))
    owner = np.searchsorted(stretch, np.flatnonzero(held), side="right") - 1
    if len(owner):
        ends = np.append(stretch[1:], n)
        for s in np.unique(owner).tolist():
            alone[stretch[s] : ends[s]] = wide[stretch[s] : ends[s]] = False
    at = np.flatnonzero(alone)
    edge[at] = edge[at + 1] = True
    at = np.flatnonzero(wide)
    edge[at] = edge[at + 3] = True
    cuts = np.flatnonzero(edge)
    full = ~blank[cuts[:-1]]
    segments = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text_of = np.searchsorted(bounds, cuts[:-1][full], side="right") - 1
    lengths = np.diff(points[cuts])[full]
    return segments.filter(pa.array(full)), np.bincount(text_of, minlength=len(texts)), points[cuts[:-1][full]] - points[bounds[text_of]], lengths


def piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of a text and more columns: those columns, each piece of their texts, and how often it occurs."""
    for batch in batches:
        share = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield _counted(batch.slice(a, z - a))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    found, counts, _, _ = cut_up(batch.column(0))
    words = found.dictionary_encode()
    group = np.zeros(batch.num_rows, np.int64)  # rows that agree in the other columns
    for column in batch.columns[1:]:
        try:
            code = column.dictionary_encode("encode").indices.to_numpy()
        except (pa.ArrowNotImplementedError, pa.ArrowInvalid):  # nested: each row by itself
            code = np.arange(batch.num_rows)
        _, group = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_inverse=True)
    _, row = np.unique(group, return_index=True)
    many = max(1, len(words.dictionary))
    pair, n = np.unique(np.repeat(group, counts) * many + words.indices.to_numpy(), return_counts=True)
    rows = pa.array(row[pair // many])
    columns = [*(x.take(rows) for x in batch.columns[1:]), words.dictionary.take(pa.array(pair % many)).cast(pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "_piece", "n"])


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2^31, their bytes in planes."""
    planes = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def trim() -> None:
    """Hand freed memory back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)
