"""Byte-level BPE by the ranks of a file, with vectorised pre-tokenisation.

The pre-tokens are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found without a regex. Each
code point has a class: letter, number, white space, other. As a transition function, a code point whose class
differs from the one before is constant (a run starts here) and any other one is the identity; composed, the
last constant wins, so an associative scan (a running maximum of positions) gives each place the start of its
run. White space gives its last blank to the run behind it, and an apostrophe alone before s, t, m, d, re, ve
or ll starts a contraction. Each distinct slice is merged once and kept.

The byte offset of every pre-token is kept beside the ids. Decoding finds the ids of each pre-token by the lengths of
its tokens, so any range of pre-tokens is decoded without what lies before it, and ids that don't meet the offsets
are an error.

Nulls: a null text is empty and has no tokens. Repeated rows keep a row each; empty tables give empty results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import textscan as ts

L, N, S, O = range(4)  # noqa: E741
CACHE, RECENT = 400_000, 200_000
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": L, "N": N}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = S
    return table


def boundaries(points: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """First code point of every pre-token of texts laid one after another; ``doc_start`` ends with the total."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[doc_start] = True
    place = np.arange(n)
    run_start = np.maximum.accumulate(np.where(change[:n], place, 0))
    last = np.zeros(n + 1, bool)  # the last code point of a text
    last[doc_start[1:] - 1] = True
    start = change[:n].copy()
    # white space before more of the same text: its last code point stands apart, and a blank joins what follows
    tail = np.flatnonzero((kind == S) & change[1:] & ~last[:n])
    start[tail] = True
    blank = tail[points[tail] == 0x20]
    start[blank + 1] = False
    # an apostrophe that is a whole run and starts a pre-token
    mark = np.flatnonzero((points == 0x27) & change[:n] & change[1:] & start & ~last[:n])
    mark = mark[kind[mark + 1] == L]
    one = points[mark + 1]
    two = np.where((mark + 2 < n) & ~change[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    short = np.isin(one, [ord(c) for c in "stmd"])
    for hit, size in ((mark[short], 2), (mark[long], 3)):
        start[hit + 1] = False
        rest = hit + size
        rest = rest[rest < n]
        start[rest] |= run_start[rest] < rest
    return np.flatnonzero(start)


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.token = {v: k for k, v in self.ranks.items()}
        self.sizes = np.zeros(max(self.token) + 1, np.int64)
        self.sizes[list(self.token)] = [len(t) for t in self.token.values()]
        self.known: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one slice: of adjacent parts, the pair of lowest rank is merged first, without any splitting before."""
        return self.core._encode_single_piece(piece)

    def encode_pieces(self, pieces: list[bytes]) -> np.ndarray:
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4")
        except KeyError:
            if len(self.known) > CACHE + RECENT:
                for p in list(self.known)[CACHE:]:
                    del self.known[p]
            for p in pieces:
                if p not in self.known:
                    self.known[p] = np.array(self.merge(p), "<u4").tobytes()
            return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4")

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids, and the byte offset of every pre-token, of each text."""
        out = []
        for _, part in ts.blocks(texts):
            whole = b"".join(part)
            points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), "<u4")
            at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))])
            ends = np.cumsum([0, *map(len, part)])
            starts = np.append(at[boundaries(points, np.searchsorted(at, np.unique(ends)))], len(whole))
            first = np.searchsorted(starts, ends)
            for i, t in enumerate(part):
                offsets = starts[first[i] : first[i + 1]] - ends[i]
                cuts = [*offsets.tolist(), len(t)]
                out.append((self.encode_pieces([t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), offsets))
        return out

    def places(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The place in ``ids`` where each pre-token starts, and the number of ids at the end."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.sizes)):
            raise ValueError("an id that no token has")
        starts = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        at = np.searchsorted(starts, offsets)
        if (at >= len(ids)).any() or (starts[at] != offsets).any() or bool(len(ids)) != bool(len(offsets)):
            raise ValueError("ids and offsets are not of one text")
        return np.append(at, len(ids))

    def decode(self, ids: np.ndarray, offsets: np.ndarray, first: int = 0, last: int | None = None) -> bytes:
        """The bytes of the pre-tokens from ``first`` up to ``last`` (not included; None: all)."""
        chosen = self.places(ids, offsets)[first : None if last is None else last + 1]
        return b"".join(map(self.token.__getitem__, ids[chosen[0] : chosen[-1]].tolist())) if len(chosen) else b""


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, offsets array<int>``: tokens, and where each pre-token starts in the UTF-8 text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = codec(path).encode(ts.texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([o.astype(np.int32) for _, o in found], pa.list_(pa.int32()))], ["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """``doc_id, text binary``: the bytes of the pre-tokens from ``first`` up to ``last`` of what encode_documents gives.

    A range beyond the last pre-token is empty there; null ids or offsets give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            texts = [None if i is None or o is None else c.decode(np.array(i, np.int64), np.array(o, np.int64), first, last) for i, o in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""
    kinds = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        decimal = [b"%d" % i for i in range(max(c.token) + 1)]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, offsets in c.encode(ts.texts_of(batch, "text")):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids, offsets)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], kinds)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
