"""Quality rules: counting rules, then a hashed n-gram log-likelihood ratio.

The score of a text is the mean, over its byte n-grams, each hashed to a bucket, of log p_target - log p_raw.
The target multinomial is counted over trusted texts (labelled good, not toxic), the raw one over every text. A text
is kept if it passes the counting rules and its score reaches ``threshold``; every text gets a verdict.

Nulls: a null text is an empty one (no words, base_failed); a null id or label row is never trusted.
Repeated rows each get the same verdict. Empty tables give empty results. Columns of the input other than
the id and the text are not read. Texts shorter than the n-gram have score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

NGRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 0.5
THRESHOLD = -0.25
MAX_TRUSTED = 50_000  # the bound of the labelled sample that the target multinomial is counted over
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def ngram_buckets(w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram of a block."""
    m = max(0, len(w.buf) - NGRAM + 1)
    gram = np.zeros(m, np.uint32)
    for k in range(NGRAM):
        gram |= w.buf[k : k + m].astype(np.uint32) << np.uint32(8 * k)
    gram *= np.uint32(0x9E3779B1)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x85EBCA77)
    counts = np.maximum(0, np.diff(w.doc_start) - 1 - (NGRAM - 1))
    take = np.zeros(m + 1, np.int64)
    full = counts > 0
    np.add.at(take, w.doc_start[:-1][full], 1)
    np.add.at(take, w.doc_start[:-1][full] + counts[full], -1)
    buckets = (gram >> np.uint32(16))[np.cumsum(take[:m]).astype(bool)].astype(np.int64)
    return buckets, np.repeat(np.arange(len(counts)), counts)


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> np.ndarray:
    """Ids labelled good and not toxic in all their rows; of more than ``limit``, those of lowest hash."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id").toPandas()
    return np.sort(rows["doc_id"].to_numpy(np.int64))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRUSTED) -> np.ndarray:
    """log p_target - log p_raw by bucket: a table of BUCKETS values, whatever the size of the input."""
    spark = docs.sparkSession
    trusted = spark.sparkContext.broadcast(trusted_ids(labels, limit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), trusted.value
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.isin(ids, good) & ~np.asarray(batch.column(0).is_null())
            for i, part in ts.blocks(ts.texts_of(batch, "text")):
                buckets, doc = ngram_buckets(ts.scan_words(part))
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[known[i + doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(target[at]), pa.array(raw[at])], ["bucket", "target", "raw"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    tables = []
    for name in ("target", "raw"):
        c = np.zeros(BUCKETS)
        c[counts["bucket"].to_numpy(np.int64)] = counts[name].to_numpy(float)
        tables.append(np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * BUCKETS))
    if not counts["target"].sum():  # without trusted texts there is nothing to compare with
        return np.zeros(BUCKETS)
    return tables[0] - tables[1]


def measure(texts: list[bytes], ratio: np.ndarray, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """All figures of a block of texts."""
    n, w = len(texts), ts.scan_words(texts)
    inside = ~ts.SPACE[w.buf]
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.doc_start])
    out = {"n_words": w.counts.astype(np.int64), "word_chars": total(inside & ((w.buf & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[w.buf])}

    stop = np.flatnonzero(w.buf == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    seen = np.concatenate([[0], np.cumsum(inside)])
    full = seen[stop] > seen[begin]
    begin, stop = begin[full], stop[full]
    doc = np.searchsorted(w.doc_start, begin, "right") - 1
    _, one = np.unique(ts.in_text(ts.span_hashes(w.buf, begin, stop), doc), return_index=True)
    out["n_dup_lines"] = ts.per_text(doc, n) - ts.per_text(doc[one], n)

    h, at = ts.shingles(w, 8)
    key = ts.in_text(h, w.doc[at])
    order = np.argsort(key)
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    again = at[order[same[1:] | same[:-1]]] if len(at) else at
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 8, -1)
    out["n_repeat_words"] = ts.per_text(w.doc[np.cumsum(cover[:-1]) > 0], n)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])

    buckets, doc = ngram_buckets(w)
    sums = np.bincount(doc, weights=ratio[buckets], minlength=n)
    out["llr"] = np.round(sums / np.maximum(np.bincount(doc, minlength=n), 1), 9)
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_TRUSTED) -> DataFrame:
    """One row of figures and a verdict for each row of ``docs`` (doc_id, text)."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in ts.blocks(ts.texts_of(batch, "text")):
                found = measure(part, ratio.value, threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), *map(pa.array, found.values())], ["doc_id", *found])

    order = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA).select(*order)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_TRUSTED) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in ts.blocks(ts.texts_of(batch, "text")):
                yield batch.slice(i, len(part)).filter(pa.array(measure(part, ratio.value, threshold)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
