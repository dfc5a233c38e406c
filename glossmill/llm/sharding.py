"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Shards are the leaves of a tree of regions and racks. A row descends from the root: at each level every child
draws ``-ln(u) / weight``, u hashed from the row's key and the child's name, and the least draw wins, so a
child gets its weight's share. A draw depends on nothing but the key, the child and its weight: where weights
change, rows move between the changed subtree and its siblings, and nothing moves between siblings that
stayed as they were. ``grown`` adds a shard as a region of its own, so that it takes rows only into itself.

Nulls: a null key is hashed as the empty string; a null text has size 16 and the checksum of the empty text.
Repeated rows share a shard and get a slot each. Empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 52  # of a draw, the first 13 hexadecimal digits of an MD5
SLOT_ROWS = 100_000
MAX_BROADCAST = 1_000_000  # rows of the table of range counts, some 30 MB; a larger one is left to a shuffle


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, racks: int = 2, per_rack: int = 5) -> list[Shard]:
    """Shards in order, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return [Shard(i // (racks * per_rack), i // per_rack, i) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a rack and region of its own."""
    return [*tree, Shard(1 + max(s.region for s in tree), 1 + max(s.rack for s in tree), 1 + max(s.shard for s in tree), weight)]


def fraction(text: Column) -> Column:
    """A number above 0 and below 1 hashed from a string."""
    return (F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") + 0.5) / F.lit(float(1 << BITS))


def _tables(tree: list[Shard]) -> list[tuple[str, dict[int, dict[int, float]]]]:
    """For each level, the children of each parent and the weight of all shards below a child."""
    out: list[tuple[str, dict[int, dict[int, float]]]] = []
    for letter, up, down in (("g", None, "region"), ("r", "region", "rack"), ("s", "rack", "shard")):
        table: dict[int, dict[int, float]] = {}
        for s in tree:
            if s.weight > 0:
                children = table.setdefault(getattr(s, up) if up else 0, {})
                children[getattr(s, down)] = children.get(getattr(s, down), 0.0) + s.weight
        out.append((letter, table))
    return out


def _draw(key: Column, letter: str):
    return lambda c: F.struct((-F.log(fraction(F.concat(key, F.lit(f":{letter}"), c["child"].cast("string")))) / c["weight"]).alias("draw"), c["child"].alias("child"))


def descend(df: DataFrame, key: Column, tree: list[Shard], name: str) -> DataFrame:
    """``df`` with the shard in column ``name``. Of equal draws the lower number wins; shards of weight 0 get nothing."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    at: Column = F.lit(0)
    for letter, table in _tables(tree):
        children = F.create_map(*(x for parent, below in sorted(table.items()) for x in (F.lit(parent), F.array(*(F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in sorted(below.items()))))))
        df = df.withColumn(f"_{letter}", F.array_min(F.transform(F.element_at(children, at), _draw(key, letter)))["child"])
        at = F.col(f"_{letter}")
    return df.withColumn(name, at).drop("_g", "_r", "_s")


def slots(df: DataFrame, shard: str, key: Column, content: Column, shards: int, name: str = "slot") -> DataFrame:
    """``df`` with each row's place in its shard, from 0 and without gaps, in order of a hash of key and content.

    A shard is ranked in as many hash ranges as its rows need; what lies before a range is summed from counts
    of ranges, a table of (shards x ranges) rows. Rows of one key but different content are in different ranges,
    so a key (or the null key) may hold any share of the rows.
    """
    spread = max(16, df.count() // SLOT_ROWS)
    small = F.broadcast if spread * shards <= MAX_BROADCAST else lambda x: x
    key = F.coalesce(key.cast("string"), F.lit(""))
    ranged = df.withColumn("_h", fraction(F.concat(key, F.lit(":slot:"), content.cast("string")))).withColumn("_range", F.floor(F.col("_h") * spread).cast("int"))
    counts = ranged.groupBy(shard, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy(shard, "_range").orderBy("_h", key)
    ranked = ranged.withColumn("_rank", F.row_number().over(order) - 1)
    return ranked.join(small(offsets), [shard, "_range"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_h", "_range", "_before", "_rank")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` by the law ``key``."""
    tree = layout(shards)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = descend(descend(rows, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grown(tree), "grown_shard")
    return slots(placed, "shard", F.col("doc_id"), F.col("text_crc32"), shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
