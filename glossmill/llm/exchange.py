"""Finding keys that occur more than once in a corpus, with little shuffling.

The texts are kept in compressed chunks. Each chunk sends its sorted distinct 64-bit keys, cut by their top
bits into buckets and delta-coded; a bucket merges what the chunks sent and answers each chunk with one bit
a key: does it occur more than once in all? A chunk names a key once however often it holds it, so a key that
a third of all rows share costs a bucket one entry a chunk.

Chunks times buckets is the number of messages, so both grow with the square root of the corpus, from CHUNK_BYTES
and BUCKET_KEYS up to GROWTH times as much (about 100 TB): the messages then grow in proportion to the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.plans.lineage import cut

from . import textscan as ts

CHUNK_BYTES = 6 << 20
BUCKET_KEYS = 1 << 21
LEAST_BUCKETS = 64
GROWTH = 8
GROWS_FROM = 1 << 40  # bytes of corpus


def growth(corpus: int) -> float:
    """How much larger chunks and buckets are than their least sizes."""
    return min(GROWTH, max(1.0, (corpus / GROWS_FROM) ** 0.5))


def chunk_table(docs: DataFrame, columns: list[str] | None = None, target: int | None = None) -> DataFrame:
    """``chunk, n_bytes, payload``: rows packed in chunks of about ``target`` bytes of text, cut from lineage.

    A chunk is named by the task that packed it; as the table is kept, the names stay as they are. Without a
    target the planner's estimate of the input's bytes sets it; one that can't be right counts as small.
    """
    if target is None:
        guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        target = int(CHUNK_BYTES * growth(guess if guess < 1 << 60 else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            first = 0
            for i, t in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
                size += t + 16
                if size >= target:
                    held.append(batch.slice(first, i + 1 - first))
                    yield row(at, size, held)
                    at, held, size, first = at + 1, [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield row(at, size, held)

    def row(at: int, size: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(whole)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "payload"])

    return cut(docs.select(*(columns or ["doc_id", "text"])).mapInArrow(pack, "chunk long, n_bytes long, payload binary"))


def unpack(payload: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return table.to_batches()[0]


def encode(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    if len(keys) < 16:
        return steps.tobytes()
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.T).tobytes())


def decode(blob: bytes, n: int) -> np.ndarray:
    if n < 16:
        return np.cumsum(np.frombuffer(blob, np.uint64), dtype=np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_count(keys: int, corpus: int = 0) -> int:
    """A power of two, so that a bucket holds some BUCKET_KEYS keys, times the corpus's growth."""
    return max(LEAST_BUCKETS, 1 << max(0, int(keys / (BUCKET_KEYS * growth(corpus)))).bit_length())


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts by (key, check), where each distinct pair begins in it, and each pair's number."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if (checks[order][1:] != checks[order][:-1])[same].any():  # two texts of one key: rare, so checks are sorted only then
        order = np.lexsort((checks, keys))
        same = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    first = np.concatenate([[True], ~same]) if len(keys) else np.zeros(0, bool)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), which


def occurs_again(chunks: DataFrame, keys_of: Callable[..., np.ndarray], buckets: int, given: DataFrame | None = None) -> DataFrame:
    """``chunk, bucket, n, flags``: for the sorted distinct keys of every chunk, whether a key occurs twice or more in all.

    ``keys_of`` gives a chunk's keys, each as often as it occurs, or a pair of keys and 32-bit checks, which must
    then agree too; it is also handed the flags the chunk got in the answers ``given``, if any.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def message(at: int, found: np.ndarray | tuple[np.ndarray, np.ndarray]) -> pa.Table:
        checks = None
        if isinstance(found, tuple):
            order, first, _ = distinct(*found)
            keys, checks = (x[order[first]] for x in found)
            times = np.diff(np.append(first, len(order)))
        else:
            keys, times = np.unique(found, return_counts=True)
        cuts = np.concatenate([np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << shift), [len(keys)]])
        full = np.flatnonzero(np.diff(cuts))
        blobs = [encode(keys[cuts[b] : cuts[b + 1]]) for b in full]
        twice = [np.packbits(times[cuts[b] : cuts[b + 1]] > 1).tobytes() for b in full]
        more = [None if checks is None else checks[cuts[b] : cuts[b + 1]].tobytes() for b in full]
        return pa.table({"chunk": pa.array([at] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "n": pa.array(np.diff(cuts)[full], pa.int64()), "keys": pa.array(blobs, pa.binary()), "twice": pa.array(twice, pa.binary()), "checks": pa.array(more, pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from message(at, keys_of(unpack(payload))).to_batches()
                ts.trim()

    def send_given(left: pa.Table, right: pa.Table) -> pa.Table:
        ts.trim()
        return message(left["chunk"][0].as_py(), keys_of(unpack(left["payload"][0].as_py()), flags_of(right)))

    def settle(table: pa.Table) -> pa.Table:
        ts.trim()
        sizes = table["n"].to_pylist()
        keys = np.concatenate([decode(k, n) for k, n in zip(table["keys"].to_pylist(), sizes, strict=True)])
        times = 1 + np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(table["twice"].to_pylist(), sizes, strict=True)]).astype(np.int64)
        checks = np.concatenate([np.zeros(n, np.uint32) if c is None else np.frombuffer(c, np.uint32) for c, n in zip(table["checks"].to_pylist(), sizes, strict=True)])
        order, run, _ = distinct(keys, checks)
        again = np.empty(len(keys), bool)
        again[order] = np.repeat(np.add.reduceat(times[order], run) > 1, np.diff(np.append(run, len(keys))))
        ends = np.cumsum(sizes)
        flags = [np.packbits(again[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "n": table["n"], "flags": pa.array(flags, pa.binary())})

    schema = "chunk long, bucket int, n long, keys binary, twice binary, checks binary"
    kept = chunks.select("chunk", "payload")
    sent = kept.mapInArrow(send, schema) if given is None else kept.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(send_given, schema)
    return sent.groupBy("bucket").applyInArrow(settle, "chunk long, bucket int, n long, flags binary")


def loses(chunks: DataFrame, given: DataFrame, found_in: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """``chunk, bucket, n, flags``: for the distinct (key, check) of every chunk, in order, does a row of another chunk come first?

    ``found_in(rows, flags)`` gives key, check, id and whether the id is null of all occurrences in a chunk. Ids
    are in order, nulls last; of equal ids the lower chunk comes first. A chunk sends one entry a key, its first.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    planes = lambda x: zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
    flat = lambda b, n: np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, n).T).view(np.int64).ravel()

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        ts.trim()
        key, check, ids, null = found_in(unpack(left["payload"][0].as_py()), flags_of(right))
        order = np.lexsort((ids, null, check, key))
        key, check, ids, null = key[order], check[order], ids[order], null[order]
        one = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]) if len(key) else np.zeros(0, bool)
        key, check, ids, null = key[one], check[one], ids[one], null[one]
        cuts = np.concatenate([np.searchsorted(key, np.arange(buckets, dtype=np.uint64) << shift), [len(key)]])
        full = np.flatnonzero(np.diff(cuts)).tolist()
        part = lambda x: [x[cuts[b] : cuts[b + 1]] for b in full]
        return pa.table({
            "chunk": pa.array([left["chunk"][0].as_py()] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "n": pa.array(np.diff(cuts)[full], pa.int64()), "keys": pa.array([encode(x) for x in part(key)], pa.binary()),
            "checks": pa.array([x.tobytes() for x in part(check)], pa.binary()), "ids": pa.array([planes(x) for x in part(ids)], pa.binary()), "nulls": pa.array([np.packbits(x).tobytes() for x in part(null)], pa.binary()),
        })

    def settle(table: pa.Table) -> pa.Table:
        ts.trim()
        sizes = table["n"].to_pylist()
        all_of = lambda name, read: np.concatenate([read(b, n) for b, n in zip(table[name].to_pylist(), sizes, strict=True)])
        key, check = all_of("keys", decode), all_of("checks", lambda b, n: np.frombuffer(b, np.uint64))
        ids, null = all_of("ids", flat), all_of("nulls", lambda b, n: np.unpackbits(np.frombuffer(b, np.uint8), count=n))
        order = np.lexsort((np.repeat(table["chunk"].to_numpy(), sizes), ids, null, check, key))
        key, check = key[order], check[order]
        lost = np.zeros(len(key), bool)
        lost[order[1:]] = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        ends = np.cumsum(sizes)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "n": table["n"], "flags": pa.array([np.packbits(lost[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    sent = chunks.select("chunk", "payload").groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(send, "chunk long, bucket int, n long, keys binary, checks binary, ids binary, nulls binary")
    return sent.groupBy("bucket").applyInArrow(settle, "chunk long, bucket int, n long, flags binary")


def flags_of(answers: pa.Table) -> np.ndarray:
    """A chunk's answers as one array, beside its sorted distinct keys."""
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["flags"].to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for _, n, f in rows)])


def with_answers(chunks: DataFrame, answers: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work(rows, flags)`` over every chunk and the answers it got, and the chunk beside."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        ts.trim()
        out = work(unpack(left["payload"][0].as_py()), flags_of(right))
        return out.append_column("chunk", pa.array([left["chunk"][0].as_py()] * out.num_rows, pa.int64()))

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, f"{schema}, chunk long")


def corpus_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
