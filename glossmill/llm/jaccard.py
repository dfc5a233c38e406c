"""N-gram Jaccard join over prefix trees.

1. Texts with equal shingle sets form one class, named by 128 bits of hash over the set.
2. A shingle that only one class of the corpus holds can't be shared. A set of n shingles with fewer than
   threshold * n shared ones has no partner and is done (exchange.py tells which are shared).
3. The other sets' shingles are put in global order, the rarest first, so that passages which many documents
   share come last. Two sets that link share a shingle of their prefixes. The sets that hold one shingle in
   their prefix are a group; of groups with equal members one is kept.
4. Each group has a hub, the set with the largest share of shared shingles. A hub meets its members of fitting
   size in a prefix tree, in parts of BLOCK members. This joins copies of one text around their hub.
5. Groups whose members are not all joined by then are walked whole: their sets, in one order, as a prefix
   tree; one overlap counter for each set of the group is kept along the path, so sets with a common prefix
   share that work; a subtree is left as soon as its remaining length can't lift any counter of a set that
   isn't joined yet to the bound. A group above BLOCK sets is dealt into parts, and each part meets each.

No link is lost: every pair that links is in a group, and a group is only left once its members are joined.
Groups hold ids until they are walked, and no group is joined to another, so they don't merge as a corpus grows.
Shingles are compared by 64 bits of hash: a pair of sets that meets is misjudged with a chance of about 2**-50.

Nulls: null or wordless texts have an empty set and are linked with nothing; a row with a null id never names
a component, and its own is null unless its component has another row. Repeated rows keep a row each. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.plans.lineage import cut, release

from . import exchange as ex
from . import textscan as ts
from .components import components

N = 5
PERCENT = 80
BLOCK = 256
SMALL_TABLE = 100_000  # rows of a table of counts that may be broadcast; a larger one is left to a shuffle
_COARSE = np.uint64(16)  # low bits left out when asking which shingles are shared: a filter may pass too much


def sets_of(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than n words has its whole sequence as one."""
    out = []
    for _, part in ts.blocks(texts):
        w = ts.scan_words(part, lower=True)
        h, at = ts.shingles(w, n)
        cut_at = np.searchsorted(w.doc[at], np.arange(len(part) + 1))
        short = np.zeros(len(part), np.uint64)
        for k in range(1, n):
            few = np.flatnonzero(w.counts == k)
            short[few] = ts.chained(w.hash, w.first[few], k, seed=k)
        for i, count in enumerate(w.counts.tolist()):
            out.append(np.unique(h[cut_at[i] : cut_at[i + 1]]) if count >= n else short[i : i + (count > 0)])
    return out


def class_name(s: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def need(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


class Forest:
    """Union-find over the positions of a family, with the component of each kept as an array."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def union(self, x: int, others: np.ndarray) -> None:
        mine = self.label[x]
        found = np.unique(self.label[others])
        self.label[np.isin(self.label, found)] = mine


def tree_join(sets: list[np.ndarray], sizes: np.ndarray, percent: int, label: np.ndarray | None = None, probes: np.ndarray | None = None) -> np.ndarray:
    """Component label of each set: sets that link end up with one label.

    ``sizes`` are the whole sets' sizes; ``sets`` may lack shingles that no other set holds. ``label``: what is
    already joined. ``probes``: only links that have one of these sets at one end are looked for.
    """
    m = len(sets)
    forest = Forest(np.arange(m) if label is None else label.copy())
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    _, first, which = np.unique(flat[order], return_index=True, return_inverse=True)
    ends = np.append(first[1:], len(flat))
    holders = owner[order]
    token = np.empty(len(flat), np.int64)
    token[order] = which  # tokens numbered in global order
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    paths = [token[at[i] : at[i + 1]] for i in range(m)]
    post = lambda t: holders[first[t] : ends[t]]
    bound = -(-percent * sizes // 100)
    overlap = np.zeros(m, np.int64)
    stack: list[int] = []
    for x in sorted(range(m) if probes is None else probes.tolist(), key=lambda i: paths[i].tolist()):
        path = paths[x].tolist()
        common = 0
        while common < min(len(stack), len(path)) and stack[common] == path[common]:
            common += 1
        while len(stack) > common:
            overlap[post(stack.pop())] -= 1
        least = np.maximum(bound, bound[x])
        alive = True
        while len(stack) < len(path):
            if len(stack) % 32 == 0 or len(stack) == common:
                alive = bool(((overlap + (len(path) - len(stack)) >= least) & (forest.label != forest.label[x])).any())
                if not alive:
                    break
            stack.append(path[len(stack)])
            overlap[post(stack[-1])] += 1
        if alive and len(stack) == len(path):
            hit = np.flatnonzero((100 * overlap >= percent * (sizes[x] + sizes - overlap)) & (forest.label != forest.label[x]))
            if len(hit):
                forest.union(x, hit)
    return forest.label



def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _links(names: list[bytes], was: np.ndarray, label: np.ndarray) -> pa.Table:
    """A chain of links through the sets of each label that joins sets which weren't joined before."""
    a, b = [], []
    order = np.lexsort((was, label))
    for x, y in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        if label[x] == label[y] and was[x] != was[y]:
            a.append(names[x])
            b.append(names[y])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _small(df: DataFrame) -> DataFrame:
    """A table computed once, and broadcast only if it is counted to be small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL_TABLE else df


def _part(name: str, size: str, block: int):
    """The part, of as many as ``size`` rows need, that a set belongs to."""
    return F.pmod(F.xxhash64(name), F.coalesce(F.ceil(F.col(size) / block), F.lit(1))).cast("int")


def _parts(size: str, block: int):
    return F.sequence(F.lit(0), (F.coalesce(F.ceil(F.col(size) / block), F.lit(1)) - 1).cast("int"))


def _hub_links(tokens: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the hub of each group and its members."""
    rank = F.struct("own", "c")  # least share of shingles of its own, then by name
    hubs = tokens.groupBy("token").agg(F.min(rank)["c"].alias("hub"))
    pairs = tokens.join(cut(hubs), "token").where("c <> hub").select("hub", "c").distinct()
    pairs = cut(pairs)
    sizes = sets.select("c", "n")
    pairs = pairs.join(sizes, "c").join(sizes.select(F.col("c").alias("hub"), F.col("n").alias("hn")), "hub")
    pairs = cut(pairs.where(F.lit(100) * F.least("n", "hn") >= percent * F.greatest("n", "hn")).select("hub", "c"))
    crowded = _small(pairs.groupBy("hub").agg(F.count("*").alias("size")).where(F.col("size") > block))
    members = pairs.join(crowded, "hub", "left").withColumn("part", _part("c", "size", block)).join(sets, "c")
    here = pairs.select("hub").distinct().join(crowded, "hub", "left").select("hub", F.explode(_parts("size", block)).alias("part")).join(sets.withColumnRenamed("c", "hub"), "hub")
    columns = ["hub", "part", "c", "n", "arr"]
    both = members.select(*columns, F.lit(False).alias("probe")).union(here.withColumn("c", F.col("hub")).select(*columns, F.lit(True)))

    def meet(table: pa.Table) -> pa.Table:
        names, hub = table["c"].to_pylist(), np.flatnonzero(np.asarray(table["probe"]).astype(bool))
        found = tree_join(_arrays(table["arr"]), table["n"].to_numpy(), percent, None, hub)
        near = [names[i] for i in np.flatnonzero(found == found[hub[0]]).tolist() if i != hub[0]]
        return pa.table({"a": pa.array(near, pa.binary()), "b": pa.array([names[hub[0]]] * len(near), pa.binary())})

    return both.groupBy("hub", "part").applyInArrow(meet, "a binary, b binary")


def _group_links(tokens: DataFrame, sets: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame:
    """Links within the groups whose sets the hubs' ``links`` haven't all joined to one hub.

    Groups that share sets form a family. A family whose sets are in more groups each than it has parts is
    walked as one group, which brings each set to fewer trees; the groups of any other are walked one by one.
    """
    hubs = links.select(F.col("b").alias("c"), F.col("b").alias("hub")).union(links.select("a", "b")).groupBy("c").agg(F.min("hub").alias("hub"))
    known = tokens.join(hubs, "c", "left").select("token", "c", F.coalesce("hub", "c").alias("label"))
    open_ = cut(known.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("c").alias("least")).where("low < high").select("token", "size", "least"))
    members = cut(known.join(open_, "token").select("token", "size", "least", "c", "label"))
    family = cut(components(members.select("least", "c"), "least", "c").select(F.col("node").alias("c"), F.col("component").alias("family")))
    placed = cut(members.join(family, "c"))
    sums = placed.groupBy("family").agg(F.count("*").alias("places"))
    sums = _small(sums.join(family.groupBy("family").agg(F.count("*").alias("f_size")), "family").where(F.ceil(F.col("f_size") / block) <= F.col("places") / F.col("f_size")).select("family", "f_size"))
    whole = placed.select("family", "c", "label").distinct().join(sums, "family").select(F.col("family").alias("grp"), F.col("f_size").alias("size"), "c", "label")
    single = placed.join(sums, "family", "left_anti").select(F.col("token").cast("string").cast("binary").alias("grp"), "size", "c", "label")
    rows = whole.union(single).withColumn("mine", _part("c", "size", block)).withColumn("other", F.explode(_parts("size", block)))
    rows = rows.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "c", "label")
    rows = rows.join(sets, "c")

    def meet(table: pa.Table) -> pa.Table:
        across = table["i"][0].as_py() != table["j"][0].as_py()  # two parts: only pairs between them, each looked for from the second
        names = table["c"].to_pylist()
        of: dict[bytes, int] = {}
        was = np.array([of.setdefault(x, len(of)) for x in table["label"].to_pylist()], np.int64)
        if len(of) < 2:
            return _links([], was[:0], was[:0])
        probes = np.flatnonzero(np.asarray(table["second"]).astype(bool)) if across else None
        found = tree_join(_arrays(table["arr"]), table["n"].to_numpy(), percent, was, probes)
        return _links(names, was, found)

    return rows.groupBy("grp", "i", "j").applyInArrow(meet, "a binary, b binary")


def _classes(docs: DataFrame, keep: bool, percent: int, n: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``docs``, of all columns if ``keep``; and ``chunk, row, doc_id, n, label, tie`` of every row, label null without words."""
    spark = docs.sparkSession
    chunks = ex.chunk_table(docs, docs.columns if keep else ["doc_id", "text"])
    total = ex.corpus_bytes(chunks)

    def distinct(batch: pa.RecordBatch) -> tuple[list[np.ndarray], dict[bytes, int], list[bytes | None]]:
        sets = sets_of(ts.texts_of(batch, "text"), n)
        names = [class_name(s) if len(s) else None for s in sets]
        one: dict[bytes, int] = {}
        for i, k in enumerate(names):
            if k is not None:
                one.setdefault(k, i)
        return sets, one, names

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        sets, one, _ = distinct(batch)
        return np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in one.values())]) >> _COARSE << _COARSE

    def describe(batch: pa.RecordBatch, again: np.ndarray) -> pa.Table:
        sets, one, names = distinct(batch)
        chosen = [sets[i] for i in one.values()]
        flat = np.concatenate([np.zeros(0, np.uint64), *chosen])
        _, which = np.unique(flat >> _COARSE << _COARSE, return_inverse=True)
        shared = again[which] if len(flat) else np.zeros(0, bool)
        ends = np.cumsum([len(s) for s in chosen], dtype=np.int64)
        arrays: list[bytes | None] = [None] * len(sets)
        for i, s, e in zip(one.values(), chosen, ends, strict=True):
            part = s[shared[e - len(s) : e]]
            if len(part) >= need(len(s), percent):
                arrays[i] = part.tobytes()
        ties: list[bytes | None] = [None] * len(sets)
        if keep:
            rest = batch.select([c for c in batch.schema.names if c != "text"]).to_pylist()
            ties = [hashlib.blake2b(t + repr(sorted(x.items())).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t, x in zip(ts.texts_of(batch, "text"), rest, strict=True)]
        return pa.table({"row": pa.array(range(len(sets)), pa.int64()), "doc_id": batch.column(batch.schema.get_field_index("doc_id")), "n": pa.array([len(s) for s in sets], pa.int64()), "c": pa.array(names, pa.binary()), "tie": pa.array(ties, pa.binary()), "arr": pa.array(arrays, pa.binary())})

    answers = ex.occurs_again(chunks, keys, ex.bucket_count(total // 5, total))
    rows = cut(ex.with_answers(chunks, answers, describe, "row long, doc_id long, n long, c binary, tie binary, arr binary"))
    release(spark)
    sets = cut(rows.where("arr is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("arr").alias("arr")))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = np.frombuffer(blob, np.int64)
                at = pa.array(np.zeros(len(s), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.DictionaryArray.from_arrays(at, pa.array([name], pa.binary())).cast(pa.binary()), pa.array(np.full(len(s), size, np.int32))], ["token", "c", "n"])

    every = sets.select("c", "n", "arr").mapInArrow(unfold, "token long, c binary, n int")
    held_by = cut(every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    whole = Window.partitionBy("c")
    ranked = every.join(held_by, "token").withColumn("place", F.row_number().over(whole.orderBy("df", "token"))).withColumn("shared", F.count("*").over(whole))
    least = F.ceil(F.col("n") * percent / 100)
    prefix = cut(ranked.where(F.col("place") <= F.col("shared") - least + 1).select("token", "c", (1 - F.col("shared") / F.col("n")).alias("own")))
    held = prefix.groupBy("token").agg(F.count("*").alias("k"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")).where("k > 1")
    chosen = cut(held.groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token"))
    tokens = cut(prefix.join(chosen, "token", "left_semi"))
    release(spark)
    links = cut(_hub_links(tokens, sets, percent, block))
    more = cut(_group_links(tokens, sets, links, percent, block))
    release(spark)
    joined = cut(components(links.union(more), "a", "b").select(F.col("node").alias("c"), "component"))
    return chunks, rows.drop("arr").join(joined, "c", "left").withColumn("label", F.coalesce("component", "c")).drop("component", "c")


def similarity_classes(docs: DataFrame, percent: int = PERCENT, n: int = N, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text)."""
    _, rows = _classes(docs, False, percent, n, block)
    rows = cut(rows)
    least = cut(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    named = rows.join(least, "label", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, n: int = N, block: int = BLOCK) -> DataFrame:
    """One row of each class of rows that links connect: the one of least id, nulls last, then the least of all columns' digest.

    Rows without words are linked with nothing, so all of them stay. Rows are told apart by their place, not by
    their id: rows that share an id but not a class are kept or not each by itself.
    """
    chunks, rows = _classes(docs, True, percent, n, block)
    rows = cut(rows.where("label is not null"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "chunk", "row")
    first = cut(rows.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1"))
    gone = rows.join(first, "label").where(order > F.col("first")).select("chunk", "row")

    def left(chunk: pa.Table, drop: pa.Table) -> pa.Table:
        ts.trim()
        batch = ex.unpack(chunk["payload"][0].as_py())
        stay = np.ones(batch.num_rows, bool)
        stay[drop["row"].to_numpy()] = False
        return pa.Table.from_batches([batch.filter(pa.array(stay))])

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(left, docs.schema)
