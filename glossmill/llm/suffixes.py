"""Removal of byte strings that occur more than once, by blockwise comparison of suffixes to a fixed depth.

Whether a string of LENGTH bytes starts anywhere else shows between neighbours of the sorted suffixes. Full
suffix order isn't needed, only suffixes compared to depth LENGTH, and only where a repeat is possible:

1. Cover sample. With D a perfect difference cover modulo V, any two places i and j have some d < V with i + d
   and j + d both in the sample (their residues are in D). The sample's strings of LENGTH - V + 1 bytes are
   looked up over the whole corpus (exchange.py): is this string at another place too?
2. Two equal strings of LENGTH bytes agree at that sample place, so a suffix none of whose sample places
   within V has a shared string is unique: this settles most suffixes without comparing them.
3. The other suffixes are cut into buckets by a 64-bit hash of their first LENGTH bytes, and each bucket is sorted
   by itself, in PASSES rounds; neighbours that are equal in this and 32 more bits of another hash are repeats.
   Ties of any length and of any number cost one key a chunk, and a bucket's size is fixed, so memory is bounded
   whatever repeats.

The suffixes left by step 2 aren't sorted by their bytes with cover ranks for long ties, as the method has it:
they are as many as the repeated bytes are, and each would have to be sent with its bytes and ranks (README).

Matches don't cross documents and are judged on the input: every copy of a repeat goes. Nulls: a null text is
empty; rows with null or equal ids keep a row each. Texts shorter than LENGTH keep all bytes. Empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.plans.lineage import cut, release

from . import exchange as ex
from . import textscan as ts

LENGTH = 200
PASSES = 2  # a power of two: so many blocks of suffix buckets are sorted one after the other, which bounds the disk needed
Q = 11  # the cover's modulus is Q*Q + Q + 1 = 133
_COARSE = np.uint64(16)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(8)
def difference_cover(q: int = Q) -> tuple[int, tuple[int, ...]]:
    """Modulus v = q*q + q + 1 (q prime) and q + 1 residues whose differences cover all residues.

    The exponents i for which x**i has no quadratic term in GF(q**3), for a suitable cubic, are such a set.
    """
    v = q * q + q + 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):
                power, found = (1, 0, 0), []
                for i in range(v):
                    if power[2] == 0:
                        found.append(i)
                    low, mid, high = power
                    power = (c * high % q, (low + b * high) % q, (mid + a * high) % q)
                if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
                    return v, tuple(found)
    raise ValueError(f"no cover for {q}")


class Rolling:
    """Hashes of all byte ranges of one length of a buffer.

    The eight bytes from each place on are mixed first; a range's hash is a sum of these over every eighth place,
    each times a power of an odd base, so it follows from two sums over all places before.
    """

    def __init__(self, buf: np.ndarray, bases: tuple[int, ...] = _BASES[:1]):
        n = len(buf)
        rows = n // 8 + 1
        padded = np.concatenate([buf, np.zeros(8 * rows + 8 - n, np.uint8)])
        self.mixed = ts.mix(np.ndarray((8 * rows,), "<u8", padded.data, 0, (1,)) + np.uint64(1))
        self.sums, self.back = [], []
        for base in bases:
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(rows, base, np.uint64)]))
            sums = np.zeros((rows + 1, 8), np.uint64)
            np.cumsum(self.mixed.reshape(rows, 8) * power[:rows, None], axis=0, dtype=np.uint64, out=sums[1:])
            self.sums.append(sums.ravel())
            self.back.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(rows, pow(base, -1, 1 << 64), np.uint64)])))

    def of(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """The hash of ``length`` bytes, eight at least, from each place on."""
        sums = self.sums[which]
        h = (sums[at + length // 8 * 8] - sums[at]) * self.back[which][at // 8]
        return ts.mix(h ^ ts.mix(self.mixed[at + length - 8])) if length % 8 else ts.mix(h)


def _sample(lengths: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and place of each sample string of texts of these lengths."""
    v, cover = difference_cover(q)
    size = length - v + 1
    of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(lengths >= length):
        places = (np.arange(0, lengths[i], v)[:, None] + np.array(cover)).ravel()
        places = places[places + size <= lengths[i]]
        of.append(np.full(len(places), i))
        at.append(places)
    return np.concatenate(of), np.concatenate(at), size


def sample_keys(texts: list[bytes], length: int = LENGTH, q: int = Q) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for _, part in ts.blocks(texts):
        buf, start = ts.lay(part)
        of, at, size = _sample(np.diff(start) - 1, length, q)
        out.append(Rolling(buf).of(start[of] + at, size) >> _COARSE << _COARSE)
    return np.concatenate(out)


def suffix_keys(texts: list[bytes], ranks: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys and checks of the suffixes that may repeat; the places of each block's, among its laid texts."""
    v, _ = difference_cover(q)
    _, which = np.unique(sample_keys(texts, length, q), return_inverse=True)
    shared = ranks[which] if len(which) else np.zeros(0, bool)
    keys, checks, places, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [], 0
    for _, part in ts.blocks(texts):
        buf, start = ts.lay(part)
        lengths = np.diff(start) - 1
        of, at, _ = _sample(lengths, length, q)
        hit = shared[done : done + len(of)]
        done += len(of)
        of, at = of[hit], at[hit]
        steps = np.zeros(len(buf) + 1, np.int64)
        np.add.at(steps, start[of] + np.maximum(0, at - v + 1), 1)
        np.add.at(steps, start[of] + at + 1, -1)
        maybe = np.cumsum(steps[:-1]) > 0
        fits = np.zeros(len(buf) + 1, np.int64)
        long = lengths >= length
        fits[start[:-1][long]] = 1
        np.add.at(fits, start[:-1][long] + lengths[long] - length + 1, -1)
        place = np.flatnonzero(maybe & (np.cumsum(fits[:-1]) > 0))
        places.append(place)
        hashes = Rolling(buf, _BASES)
        keys.append(hashes.of(place, length))
        checks.append((hashes.of(place, length, 1) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(keys), np.concatenate(checks), places


def _keys_of_pass(number: int, length: int, q: int):
    """Only the keys whose top bits are ``number``: the suffix buckets of one pass."""

    def keys(batch: pa.RecordBatch, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, checks, _ = suffix_keys(ts.texts_of(batch, "text"), shared, length, q)
        mine = found >> np.uint64(64 - (PASSES.bit_length() - 1)) == number
        return found[mine], checks[mine]

    return keys


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row of ``docs`` (doc_id, text).

    ``kept`` are the remaining bytes; they need not be whole UTF-8 characters.
    """
    spark = docs.sparkSession
    chunks = ex.chunk_table(docs)
    total = ex.corpus_bytes(chunks)
    ranks = cut(ex.occurs_again(chunks, lambda batch: sample_keys(ts.texts_of(batch, "text"), length, q), ex.bucket_count(total // (q - 1), total)))
    release(spark)
    again = None
    for half in range(PASSES):
        found = cut(ex.occurs_again(chunks, _keys_of_pass(half, length, q), ex.bucket_count(total // 4, total), ranks))
        again = found if again is None else again.union(found)
    release(spark)

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        ts.trim()
        batch = ex.unpack(left["payload"][0].as_py())
        texts = ts.texts_of(batch, "text")
        second = np.asarray(right["second"]).astype(bool)
        keys, checks, places = suffix_keys(texts, ex.flags_of(right.filter(pa.array(~second))), length, q)
        which = ex.distinct(keys, checks)[2]
        flags = ex.flags_of(right.filter(pa.array(second)))
        hit = flags[which] if len(keys) else np.zeros(0, bool)
        rows, done = [], 0
        for (_, part), place in zip(ts.blocks(texts), places, strict=True):
            buf, start = ts.lay(part)
            found = place[hit[done : done + len(place)]]
            done += len(place)
            steps = np.zeros(len(buf) + 1, np.int64)
            steps[found] += 1
            np.add.at(steps, found + length, -1)
            gone = np.cumsum(steps[:-1]) > 0  # the newline behind a text is never covered, so runs end there
            before = np.concatenate([[0], np.cumsum(gone)])
            heads = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
            for i, t in enumerate(part):
                a, b = start[i], start[i] + len(t)
                n = int(before[b] - before[a])
                rest = t if not n else buf[a:b][~gone[a:b]].tobytes()
                rows.append((len(t), n, int(heads[b] - heads[a]), hashlib.sha256(rest).hexdigest(), rest))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    both = ranks.withColumn("second", F.lit(False)).union(again.withColumn("second", F.lit(True)))
    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
