"""SimHash fingerprints of documents, and search within a Hamming radius by permuted block tables.

The terms of a text are its runs of TERM words (all its words, if it has fewer), weighted by how often they
occur. Each term's hash votes on BITS signed bits; a bit of the fingerprint is set where the sum is positive.
The likeness of two fingerprints is the cosine that their Hamming distance estimates, 0 at least.

Nulls: a null text is empty; texts without words have the fingerprint 0. A null id comes before all others.
Rows with one id follow each other in order of a hash of their texts, and may be any share of the rows. Empty
tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.plans.lineage import cut

from . import textscan as ts

BITS = 128
TERM = 3
RADIUS = 3
BUCKET = 64


def fingerprints(texts: list[bytes], term: int = TERM) -> np.ndarray:
    """A row of BITS / 8 bytes for each text."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, part in ts.blocks(texts):
        w = ts.scan_words(part)
        h, at = ts.shingles(w, term)
        doc = w.doc[at]
        few = np.flatnonzero((w.counts > 0) & (w.counts < term))
        lone = np.concatenate([np.arange(w.first[k], w.first[k + 1]) for k in few]) if len(few) else np.zeros(0, np.int64)
        h, doc = np.concatenate([h, w.hash[lone]]), np.concatenate([doc, w.doc[lone]])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        if not len(h):
            continue
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        votes = np.empty((len(head), BITS), np.int32)
        for word in range(BITS // 64):
            bits = np.unpackbits(ts.mix(h + np.array([word + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8), axis=1)
            votes[:, 64 * word : 64 * word + 64] = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
        size = np.diff(np.append(head, len(h)))
        out[i + doc[head]] = np.packbits(2 * votes > size[:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    distance = np.bitwise_count(a ^ b).sum(axis=1)
    return np.where(distance == 0, 1.0, np.clip(np.cos(np.pi * distance / BITS), 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    own = fingerprints([t.encode() for t in texts])
    nxt = fingerprints([t.encode() for t in following[-1:]])  # the others are the next rows' own
    nxt = np.concatenate([own[1:], nxt]) if following[:-1] == texts[1:] else fingerprints([t.encode() for t in following])
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    marks = fingerprints(changed)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
        pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in marks]), pa.array(likeness(own, marks)), pa.array(likeness(own, nxt)),
    ]


def with_next(docs: DataFrame) -> DataFrame:
    """Figures of each document (doc_id, text) and of its edit with the one of the next id; after the last comes the first.

    One sorted shuffle puts neighbours together. The first and last document of each partition are set aside,
    and each last one meets the first one of the next partition.
    """
    names = [c.split()[0] for c in _FIELDS.split(", ")] + ["part", "head", "tail"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if not ids:
                continue
            first = texts[0] if first is None else first
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            for a in range(0, len(ids) - 1, 256):
                b = min(a + 256, len(ids) - 1)
                none = pa.nulls(b - a, pa.string())
                yield pa.RecordBatch.from_arrays([*_compare(ids[a:b], texts[a:b], texts[a + 1 : b + 1]), pa.nulls(b - a, pa.int32()), none, none], names)
        if held:
            row = [held[0], None, None, None, None, None, None, part, first, held[1]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    spread = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = spread.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    found = cut(ordered.mapInArrow(walk, f"{_FIELDS}, part int, head string, tail string"))
    edge = found.where("part is not null")
    parts = edge.select("part")  # one number a partition
    order = Window.orderBy("part")
    least = F.min("part").over(Window.partitionBy())
    after = parts.withColumn("next", F.coalesce(F.lead("part").over(order), least))
    pairs = edge.select("part", "doc_id", "tail").join(after, "part").join(edge.select(F.col("part").alias("next"), "head"), "next").select("doc_id", "tail", "head")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(_compare(*(batch.column(i).to_pylist() for i in range(3))), names[:7])

    return found.where("part is null").select(*names[:7]).union(pairs.mapInArrow(close, _FIELDS))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``query, fingerprint, distance``: the fingerprints (hex) at most ``radius`` bits from each query, itself included.

    Both inputs have one column ``fingerprint``. The bits are cut into radius + 1 blocks, of which two such
    fingerprints agree on one at least: table t is keyed by block t. In a bucket of more than ``bucket``
    fingerprints the bits outside the block are cut into blocks again, and so on while there are bits, so what
    meets in the end agrees on nearly all of them.
    """
    digits = BITS // 4
    start = lambda df, own: df.where("fingerprint is not null").distinct().select(F.col("fingerprint").alias("fp"), F.lit("").alias("key"), F.col("fingerprint").alias("rest"), F.lit(own).alias("query"))
    level = cut(start(prints, False).union(start(queries, True)))
    met_all = None
    while True:
        size = F.length("rest")
        edge = lambda t: F.floor(size * t / (radius + 1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda t: F.struct(
            F.concat_ws("|", F.col("key"), t.cast("string"), F.substring(F.col("rest"), edge(t) + 1, edge(t + 1) - edge(t))).alias("key"),
            F.concat(F.substring(F.col("rest"), F.lit(1), edge(t)), F.substring(F.col("rest"), edge(t + 1) + 1, F.lit(digits))).alias("rest")))
        table = cut(level.select("fp", "query", F.explode(blocks).alias("x")).select("fp", "query", "x.key", "x.rest"))
        full = cut(table.groupBy("key").agg(F.count_if("query").alias("asked"), F.count_if(~F.col("query")).alias("n")).where("asked > 0 and n > 0").select("key", "n"))
        met = table.join(full, "key")
        done = (F.col("n") <= bucket) | (F.length("rest") <= radius)
        x, y = met.where(done & F.col("query")).select("key", F.col("fp").alias("query")), met.where(done & ~F.col("query")).select("key", F.col("fp").alias("fingerprint"))
        xor = [F.bit_count(F.conv(F.substring("query", 1 + 8 * k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("fingerprint", 1 + 8 * k, 8), 16, 10).cast("long"))) for k in range(digits // 8)]
        near = x.join(y, "key").withColumn("distance", sum(xor[1:], xor[0])).where(F.col("distance") <= radius).select("query", "fingerprint", "distance")
        met_all = near if met_all is None else met_all.union(near)
        level = met.where(~done).select("fp", "key", "rest", "query")
        if not level.limit(1).count():
            return met_all.distinct()


def fingerprinted(docs: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """``with_next``, and ``n_within``: how many rows' fingerprints lie within ``radius`` bits of the row's own.

    It is asked for rows whose id is divisible by ``every`` and null for the others; the row itself counts. A
    text without words has fingerprint 0 and is near the others of that kind.
    """
    rows = cut(with_next(docs))
    counts = cut(rows.groupBy("fingerprint").agg(F.count("*").alias("rows")))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = within_radius(rows.where(asked).select("fingerprint"), counts.select("fingerprint"), radius)
    sums = cut(found.join(counts, "fingerprint").groupBy("query").agg(F.sum("rows").alias("n_within")).withColumnRenamed("query", "fingerprint"))
    known = rows.where(asked).join(sums, "fingerprint").select(*rows.columns, "n_within")
    return known.union(rows.where(~asked).withColumn("n_within", F.lit(None).cast("long")))
