"""Texts identified in chunks: tokens are neither shuffled nor stored one by one.

A chunk keeps its texts as numbers of distinct pieces (see ``functions.pieces``). It asks for each piece once, is
told the piece's tokens with what rules, lexicon and classifier say of them, and goes over its texts with that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions import text as tx
from glossmill.functions.pieces import cut_up, pack_numbers, trim, unpack_numbers
from glossmill.plans.lineage import cut

from .decode import chains

CHUNK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
CHUNK_ROWS = 1 << 20  # empty texts have no bytes
PART_PIECES = 1 << 18  # gone over at once


def pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``chunk, keys, counts, codes, gaps, words``: texts in chunks, cut from lineage.

    ``words`` are the distinct pieces; ``codes`` tell the pieces of all texts, ``counts`` how many each text has,
    ``gaps`` the code points between a piece and the one before.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            first = part = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                size, part = size + n, part + n
                whole = size >= CHUNK_BYTES or rows + i + 1 - first >= CHUNK_ROWS
                if whole or part >= SLICE_BYTES:
                    held.append(numbered(batch.slice(first, i + 1 - first)))
                    rows, first, part = rows + i + 1 - first, i + 1, 0
                if whole:
                    yield row(at, held)
                    at, held, size, rows = at + 1, [], 0, 0
            if first < batch.num_rows:
                held.append(numbered(batch.slice(first)))
                rows += batch.num_rows - first
        if held:
            yield row(at, held)

    def numbered(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
        pieces, counts, starts, lengths = cut_up(batch.column(1))
        gaps = starts.copy()
        gaps[1:] -= (starts + lengths)[:-1]
        ends = np.cumsum(counts)
        begins = (ends - counts)[counts > 0]
        gaps[begins] = starts[begins]
        return batch.column(0), counts, pieces.dictionary_encode(), gaps

    def row(at: int, held: list[tuple]) -> pa.RecordBatch:
        trim()
        keys = pa.table({"key": pa.chunked_array([x[0] for x in held])}).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, keys.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(keys)
        whole = pa.chunked_array([x[2] for x in held]).unify_dictionaries()
        words = whole.chunk(0).dictionary.cast(pa.string())
        counts, codes, gaps = (pack_numbers(np.concatenate(x)) for x in ([x[1] for x in held], [x.indices.to_numpy() for x in whole.chunks], [x[3] for x in held]))
        listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), counts, codes, gaps)), listed], ["chunk", "keys", "counts", "codes", "gaps", "words"])

    return cut(docs.select(key, text).mapInArrow(fill, "chunk long, keys binary, counts binary, codes binary, gaps binary, words array<string>"))


def asked(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk").alias("to"), F.posexplode("words").alias("code", "piece"))


def piece_tokens(chunks: DataFrame) -> DataFrame:
    """``piece, start, length, text, kind``: the tokens of each distinct piece."""
    pieces = asked(chunks).select("piece").distinct().withColumn("whole", F.col("piece"))
    return cut(tx.tokenize(pieces, "piece", "whole").select("piece", F.col("start").cast("int").alias("start"), (F.col("end") - F.col("start")).cast("int").alias("length"), "text", "kind"))


def answers(chunks: DataFrame, found: DataFrame, decisions: DataFrame, config) -> DataFrame:
    """``to, code, start, length, flags`` and the emission as ``e0`` and so on, for each token of a chunk's pieces.

    ``flags``: 1 for a token in the chain; 2 for a word, 4 for the end of a sentence; 8 where a capital within a
    sentence flattens the emission; from 16 on the source, from 64 on 1 and what label is forced, if any.
    """
    labels = (*config.labels, "univ")
    rows = found.join(decisions, ["text", "kind"], "left")
    place = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0))
    forced = F.coalesce("forced", F.lit(""))
    chain = (F.col("kind") != "UNIV") & (forced != "univ")
    sign = F.when(F.col("kind") != "UNIV", 2).when(F.col("text").isin(*tx.SENTENCE_END), 4).otherwise(0)
    known = F.when((forced != "") & ~forced.isin(*labels), F.raise_error(F.concat(F.lit("no such label: "), forced)).cast("long")).otherwise(place(F.col("forced"), labels))
    flags = chain.cast("int") + sign + F.when(F.col("named").isNotNull(), 8).otherwise(0) + 16 * F.greatest(place(F.col("source"), tx.SOURCES) - 1, F.lit(0)) + 64 * known
    settled = cut(rows.select("piece", "start", "length", flags.cast("int").alias("flags"), *(F.get("emission", F.lit(i)).alias(f"e{i}") for i in range(len(config.labels)))))
    return asked(chunks).join(settled, "piece").drop("piece")


class Settled(NamedTuple):
    """Tokens of some texts of a chunk, in order; ``label`` and ``source`` are places."""

    texts: slice  # in the chunk
    pieces: slice
    sizes: np.ndarray  # tokens of each text
    piece: np.ndarray  # of each token, its piece among ``pieces``
    kinds: np.ndarray  # of each token, its row in what the chunk was told
    label: np.ndarray
    confidence: np.ndarray
    source: np.ndarray


def settle(left: pa.Table, told: pa.Table, config) -> Iterator[Settled]:
    """All tokens of a chunk, some texts at a time; ``told`` is in order of codes and starts."""
    k, univ = len(config.labels), len(config.labels)
    counts, codes = (unpack_numbers(left[x][0].as_py()).astype(np.int32) for x in ("counts", "codes"))
    many = np.bincount(told["code"].to_numpy(), minlength=int(codes.max(initial=-1)) + 1)
    first = np.cumsum(many) - many
    flags = told["flags"].to_numpy()
    emission = np.stack([pc.fill_null(told[f"e{i}"], 0.0).to_numpy() for i in range(k)], axis=1) if len(flags) else np.zeros((0, k))
    w, flat = config.name_weight, (1 - config.name_weight) / k
    table = np.concatenate([emission, w * emission + flat])
    tops = table.argmax(axis=1)
    router, context = tx.SOURCES.index("router"), tx.SOURCES.index("context")

    def part(texts: slice, pieces: slice) -> Settled:
        n = many[codes[pieces]]
        ends = np.cumsum(n)
        piece = np.repeat(np.arange(len(n)), n)
        kinds = first[codes[pieces]][piece] + np.arange(len(piece)) - (ends - n)[piece]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts[texts])])]
        sizes = np.diff(bounds)
        mine = flags[kinds]
        # a word of the same sentence before?
        signed = np.where(mine & 6, np.arange(len(mine)), -1)
        before = np.concatenate([[-1], np.maximum.accumulate(signed)[:-1]]) if len(mine) else signed
        named = (before >= np.repeat(bounds[:-1], sizes)) & (mine[before] & 2 > 0) & (mine & 8 > 0)

        links = np.flatnonzero(mine & 1)
        row = (kinds + named * len(flags))[links]
        held = np.concatenate([[0], np.cumsum(mine & 1)])
        post = chains(table[row], np.diff(held[bounds]), config.stay)
        forced = (mine[links] >> 6) - 1
        chosen = np.where(forced >= 0, forced, post.argmax(axis=1))
        own = post[np.arange(len(links)), chosen]
        by = np.where(chosen == tops[row], np.where(named[links], context, mine[links] >> 4 & 3), context)
        label, confidence, source = np.full(len(mine), univ), np.ones(len(mine)), np.full(len(mine), router)
        label[links], confidence[links], source[links] = chosen, np.where(forced >= 0, np.maximum(own, table[row, chosen]), own), np.where(forced >= 0, router, by)
        return Settled(texts, pieces, sizes, piece, kinds, label, confidence, source)

    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    cuts = [0, *(np.flatnonzero(np.diff(ends[1:] // PART_PIECES)) + 1).tolist(), len(counts)]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield part(slice(a, z), slice(int(ends[a]), int(ends[z])))


def in_order(told: pa.Table) -> pa.Table:
    return told.combine_chunks().sort_by([("code", "ascending"), ("start", "ascending")])


def _over(chunks: DataFrame, told: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    return chunks.groupBy("chunk").cogroup(told.groupBy("to")).applyInArrow(work, schema)


def tokens(chunks: DataFrame, told: DataFrame, key: str, key_type: T.DataType, config) -> DataFrame:
    labels = pa.array([*config.labels, "univ"])
    sources = pa.array(tx.SOURCES)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        told = in_order(right)
        keys = pa.ipc.open_stream(left["keys"][0].as_py()).read_all()["key"]
        words = left["words"].combine_chunks().flatten()
        points = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        counts, codes, gaps = (unpack_numbers(left[x][0].as_py()) for x in ("counts", "codes", "gaps"))
        after = np.concatenate([[0], np.cumsum(gaps + points[codes])])
        at = after[1:] - points[codes] - np.repeat(after[np.cumsum(counts) - counts], counts)  # code points before a piece in its text
        of, begin, length = (told[x].to_numpy() for x in ("code", "start", "length"))
        names = words.take(pa.array(of)).to_pylist()
        for i in np.flatnonzero(length != points[of]).tolist():
            names[i] = names[i][begin[i] : begin[i] + length[i]]
        names = pa.array(names, pa.string())

        def rows(s: Settled) -> pa.Table:
            start = at[s.pieces][s.piece] + begin[s.kinds]
            pos = np.arange(len(s.kinds)) - np.repeat(np.cumsum(s.sizes) - s.sizes, s.sizes)
            return pa.table({
                "key": keys.take(pa.array(np.repeat(np.arange(s.texts.start, s.texts.stop), s.sizes))), "pos": pa.array(pos, pa.int32()), "text": names.take(pa.array(s.kinds)), "start": pa.array(start, pa.int64()), "end": pa.array(start + length[s.kinds], pa.int64()),
                "label": labels.take(pa.array(s.label)), "confidence": pa.array(s.confidence), "source": sources.take(pa.array(s.source)),
            })

        return pa.concat_tables(map(rows, settle(left, told, config)))

    schema = T.StructType([T.StructField("key", key_type), *T.StructType.fromDDL("pos int, text string, start long, end long, label string, confidence double, source string")])
    return _over(chunks, told, work, schema).withColumn("confidence", F.round("confidence", 4)).withColumnRenamed("key", key)


def tally(chunks: DataFrame, told: DataFrame, config) -> DataFrame:
    names, many = [*config.labels, "univ"], len(tx.SOURCES)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        n = np.zeros(len(names) * many, np.int64)
        for s in settle(left, in_order(right), config):
            n += np.bincount(s.label * many + s.source, minlength=len(n))
        full = np.flatnonzero(n)
        return pa.table({"label": pa.array([names[x // many] for x in full], pa.string()), "source": pa.array([tx.SOURCES[x % many] for x in full], pa.string()), "n": pa.array(n[full], pa.int64())})

    found = _over(chunks.select("chunk", "counts", "codes"), told.drop("length"), work, "label string, source string, n long")
    return found.groupBy("label", "source").agg(F.sum("n").alias("n"))
