"""Segments, summaries and reports over labelled tokens (key, pos, text, start, end, label)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as tx


def _in(labels: tuple[str, ...]) -> Column:
    return F.col("label").isin(*labels)


def segments(tokens: DataFrame, key: str, labels: tuple[str, ...] = tx.LANGUAGES) -> DataFrame:
    """``key, run, label, start, end, n_words``: runs of words of one language; other tokens never split a run."""
    w = Window.partitionBy(key).orderBy("pos")
    words = tokens.where(_in(labels)).withColumn("_new", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1)))
    runs = words.withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(key, "run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words"))


def summarize(docs: DataFrame, tokens: DataFrame, key: str, labels: tuple[str, ...] = tx.LANGUAGES, first: str = "bam") -> DataFrame:
    """``key, n_words, n_switches, dominant, code_switched, proportions``, one row a document.

    Of languages with equal shares ``first`` dominates, then the order of ``labels``. A document without words
    has no dominant language.
    """
    w = Window.partitionBy(key).orderBy("pos")
    words = tokens.where(_in(labels)).withColumn("_switch", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(0)))
    sums = words.groupBy(key).agg(F.count("*").alias("n_words"), F.sum("_switch").alias("n_switches"), *(F.count_if(F.col("label") == x).alias(f"_n{i}") for i, x in enumerate(labels)))
    rows = docs.select(key).join(sums, key, "left")
    shares = F.filter(F.array(*(F.struct(F.col(f"_n{i}").alias("n"), F.lit(x == first).alias("first"), F.lit(-i).alias("rank"), F.lit(x).alias("label")) for i, x in enumerate(labels))), lambda s: s["n"] > 0)
    rows = rows.withColumn("_s", shares)
    return rows.select(
        key, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_switches", F.lit(0)).alias("n_switches"), F.array_max("_s")["label"].alias("dominant"), F.coalesce(F.size("_s") > 1, F.lit(False)).alias("code_switched"),
        F.coalesce(F.map_from_entries(F.transform("_s", lambda s: F.struct(s["label"], s["n"] / F.col("n_words")))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("proportions"),
    )


def overview(docs: DataFrame, tokens: DataFrame, key: str, text: str, labels: tuple[str, ...] = tx.LANGUAGES) -> DataFrame:
    """``key, overview``: the text by segments, then shares from large to small, then what kind of text it is."""
    seg = segments(tokens, key, labels).join(docs.select(key, text), key)
    line = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.substring(F.col(text), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    lines = seg.select(key, "run", line.alias("line")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    rows = summarize(docs, tokens, key, labels).join(lines, key, "left")
    order = F.array(*(F.lit(x) for x in labels))
    ranked = F.array_sort(F.transform(F.map_entries("proportions"), lambda e: F.struct((-e["value"]).alias("p"), F.array_position(order, e["key"]).alias("o"), e["key"].alias("l"))))
    shares = F.array_join(F.transform(ranked, lambda e: F.concat(e["l"], F.lit(" "), F.round(-100 * e["p"]).cast("int").cast("string"), F.lit("%"))), ", ")
    kind = F.when(F.col("code_switched"), F.concat(F.lit("code-switched, "), F.col("n_switches"), F.lit(" switch(es)"))).otherwise("single language")
    return rows.select(key, F.when(F.col("n_words") == 0, "(no words)").otherwise(F.concat_ws("\n", "lines", shares, kind)).alias("overview"))


def token_lines(tokens: DataFrame, key: str, docs: DataFrame | None = None) -> DataFrame:
    """``key, value``: a document's tokens as one JSON array; documents of ``docs`` without tokens have an empty one."""
    item = F.struct("pos", F.struct("text", "start", "end", "label", "confidence", "source").alias("t"))
    if docs is not None:
        return docs.select(key).join(token_lines(tokens, key), key, "left").select(key, F.coalesce("value", F.lit("[]")).alias("value"))
    return tokens.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"])).alias("value"))


def word_table(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.format_string("%-20s %-5s %.4f %s", "text", "label", "confidence", "source").alias("value"))


def univ_counts(docs: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """``key, n_univ``: tokens of a document that are of no language."""
    sums = tokens.where(F.col("label") == "univ").groupBy(key).agg(F.count("*").alias("n_univ"))
    return docs.select(key).join(sums, key, "left").select(key, F.coalesce("n_univ", F.lit(0)).alias("n_univ"))


def low_confidence(tokens: DataFrame, below: float = 0.7) -> DataFrame:
    return tokens.where((F.col("label") != "univ") & (F.col("confidence") < below))


def violations(tokens: DataFrame) -> DataFrame:
    """Tokens that break the contract: unknown label or source, confidence outside 0 to 1, or an empty span."""
    good = F.col("label").isin(*tx.LABELS) & F.col("source").isin(*tx.SOURCES) & F.col("confidence").between(0, 1) & (F.col("start") < F.col("end"))
    return tokens.where(~F.coalesce(good, F.lit(False)))


def fingerprint(contract: dict) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of a contract's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(contract, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
