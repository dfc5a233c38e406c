"""Substring dedup over sliding sentence spans.

A sentence ends with the word that ends in . ! or ? (closing quotes or brackets may follow), at the end of a
line, and behind every word whose hash has its top two bits unset: one rule for all texts, which looks at
nothing but the word and what follows it, so a passage is cut alike in any surroundings, punctuated or not.

Runs of several lengths are hashed: from every sentence on, and up to every sentence, the run of the fewest
sentences, RUN at least, with LEAST words or more. A text that has no such run is one run by itself. So every
repeated stretch of RUN sentences and LEAST words is covered to its ends. Runs are looked up in the whole corpus
by 128 bits of hash. Of equal runs the first, by (doc_id, place), stays; each sentence that a later one covers is
removed, with the white space behind it. The rest of a text stays byte for byte.

Nulls: a null text stays null and has no sentences; a row with a null id comes after all others. Repeated
rows are different documents here: the first keeps what the others lose. Empty tables give empty results.
Other columns pass through; the two figures have names of the caller's choice, so they can't clash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.plans.lineage import cut, release

from . import exchange as ex
from . import textscan as ts

RUN = 2
LEAST = 10
_COARSE = np.uint64(8)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]}")] = True


def sentences(w: ts.Words) -> np.ndarray:
    """First word of each sentence of a block, and the number of words at the end."""
    if not len(w.hash):
        return np.zeros(1, np.int64)
    last = w.end - 1
    for _ in range(3):
        last = np.where(_CLOSER[w.buf[last]] & (last > w.start), last - 1, last)
    lines = np.concatenate([[0], np.cumsum(w.buf == 10)])
    ends = _STOP[w.buf[last]]
    ends[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]  # a text ends with a newline, so it ends a sentence too
    ends[-1] = True
    ends |= w.hash >> np.uint64(62) == 0
    return np.append(np.flatnonzero(np.concatenate([[True], ends[:-1]])), len(w.hash))


class Runs(NamedTuple):
    """The runs of a list of texts: two hashes, text, first sentence, number of sentences.

    ``lead`` is the place, among the runs, of the shortest run from the same sentence on: it lies within the run,
    so a run can only be repeated if its lead is. ``places`` are the byte places of each text's sentences.
    """

    hash: np.ndarray
    check: np.ndarray
    text: np.ndarray
    at: np.ndarray
    size: np.ndarray
    lead: np.ndarray
    places: list[np.ndarray]


def runs(texts: list[bytes], run: int = RUN, least: int = LEAST) -> Runs:
    none = np.zeros(0, np.int64)
    found, places, done = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none, none)], [], 0
    for i, part in ts.blocks(texts):
        w = ts.scan_words(part)
        head = sentences(w)
        of = w.doc[head[:-1]]
        first = np.searchsorted(of, np.arange(len(part) + 1))
        for k in range(len(part)):
            a, b = first[k], first[k + 1]
            places.append(np.append(w.start[head[a:b]] - w.doc_start[k], len(part[k])) if b > a else none)
        each = np.arange(len(of))
        stop = np.maximum(each + run, np.searchsorted(head, head[:-1] + least))
        ahead = stop <= first[of + 1]
        begin = np.minimum(each + 1 - run, np.searchsorted(head, head[1:] - least, "right") - 1)
        back = begin >= first[of]
        has = np.zeros(len(part), bool)
        has[of[ahead]] = True
        whole = np.flatnonzero(~has & (np.diff(first) > 0))
        a = np.concatenate([each[ahead], begin[back], first[whole]])
        b = np.concatenate([stop[ahead], each[back] + 1, first[whole + 1]])
        pairs = np.unique(a << 32 | b)
        a, size = pairs >> 32, (pairs & 0xFFFFFFFF) - (pairs >> 32)
        one = ts.sequence_hashes(w.hash, head[:-1], np.diff(head))
        hashes = [np.full(len(a), seed, np.uint64) for seed in (1, 2)]
        for k in range(int(size.max(initial=0))):
            more = size > k
            for h in hashes:
                h[more] = ts.mix(h[more] + one[a[more] + k])
        lead = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))[np.cumsum(np.concatenate([[False], a[1:] != a[:-1]]))] if len(a) else none
        found.append((*hashes, of[a] + i, a - first[of[a]], size, lead + done))
        done += len(a)
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)), places)


def remove_spans(docs: DataFrame, run: int = RUN, least: int = LEAST, figures: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """``docs`` with the repeated sentences removed from ``text``, and beside it its sentences and how many of them went."""
    spark = docs.sparkSession
    names = docs.columns
    chunks = ex.chunk_table(docs, names)
    total = ex.corpus_bytes(chunks)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        r = runs(ts.texts_of(batch, "text"), run, least)
        return r.hash[r.lead == np.arange(len(r.lead))] >> _COARSE << _COARSE

    def hits(batch: pa.RecordBatch, again: np.ndarray) -> tuple[Runs, np.ndarray]:
        """The runs of a chunk, and which of them have a lead that may be repeated."""
        r = runs(ts.texts_of(batch, "text"), run, least)
        lead = np.flatnonzero(r.lead == np.arange(len(r.lead)))
        may = np.zeros(len(r.lead), bool)
        if len(lead):
            may[lead] = again[np.unique(r.hash[lead] >> _COARSE << _COARSE, return_inverse=True)[1]]
        return r, np.flatnonzero(may[r.lead])

    def found_in(batch: pa.RecordBatch, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r, hit = hits(batch, again)
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        text = r.text[hit]
        return r.hash[hit], r.check[hit], ids.fill_null(0).to_numpy(zero_copy_only=False)[text].astype(np.int64), np.asarray(ids.is_null())[text].astype(bool)

    answers = cut(ex.occurs_again(chunks, keys, ex.bucket_count(total // 20, total)))
    lost = cut(ex.loses(chunks, answers, found_in, ex.bucket_count(total // 20, total)))
    release(spark)

    shape = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in figures)])

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        ts.trim()
        batch = ex.unpack(left["payload"][0].as_py())
        texts = ts.texts_of(batch, "text")
        at_text = batch.schema.get_field_index("text")
        null = batch.column(at_text).is_null().to_pylist()
        second = np.asarray(right["second"]).astype(bool)
        r, hit = hits(batch, ex.flags_of(right.filter(pa.array(~second))))
        later = ex.flags_of(right.filter(pa.array(second)))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        rank = np.empty(batch.num_rows, np.int64)  # of the rows, by id, nulls last, then by place
        rank[np.lexsort((np.arange(batch.num_rows), ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()).astype(bool)))] = np.arange(batch.num_rows)
        order = np.lexsort((r.at[hit], rank[r.text[hit]], r.check[hit], r.hash[hit]))
        key, check = r.hash[hit][order], r.check[hit][order]
        one = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]) if len(key) else np.zeros(0, bool)
        gone: dict[int, set[int]] = {}
        for k in hit[order[~one | later[np.cumsum(one) - 1]]].tolist() if len(key) else ():
            gone.setdefault(int(r.text[k]), set()).update(range(int(r.at[k]), int(r.at[k] + r.size[k])))
        out, total, lost = [], [], []
        for i, t in enumerate(texts):
            cut_out = gone.get(i, ())
            p = r.places[i]
            n = max(0, len(p) - 1)
            if cut_out:
                t = t[: p[0]] + b"".join(t[p[k] : p[k + 1]] for k in range(n) if k not in cut_out)
            out.append(None if null[i] else t)
            total.append(n)
            lost.append(len(cut_out))
        columns = list(batch.columns)
        columns[at_text] = pa.array(out, pa.binary()).cast(pa.string())
        return pa.table([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*names, *figures])

    both = answers.withColumn("second", F.lit(False)).union(lost.withColumn("second", F.lit(True)))
    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cleaned, shape)
