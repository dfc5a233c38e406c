"""Character n-gram naive Bayes over distinct words, as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as tx
from glossmill.functions.pieces import pack_numbers, trim, unpack_numbers
from glossmill.plans.lineage import cut

CHUNK_WORDS = 1 << 17
SLICE_WORDS = 1 << 13

class WordClassifier(Protocol):
    """What an identifier needs of a classifier."""

    labels: tuple[str, ...]

    def predict(self, words: DataFrame, word: str) -> DataFrame:
        """``word, probs array<double>`` in the order of ``labels``, for distinct words."""


@dataclass
class Model:
    """``grams``: gram and one count a label; ``stats``: label, total, log_prior; and the number of distinct grams."""

    grams: DataFrame
    stats: list[tuple[str, int, float]]
    vocabulary: int
    labels: tuple[str, ...]
    longest: int = 5
    alpha: float = 0.1
    temper: float = 0.5

    def predict(self, words: DataFrame, word: str) -> DataFrame:
        return predict(words, word, self)


def gram_counts(pairs: DataFrame, longest: int = 5, prune: int = 1) -> DataFrame:
    """``gram, label, n`` over (word, label) pairs; grams seen fewer than ``prune`` times in all are left out."""
    rows = pairs.select("label", tx.normalize(F.col("word")).alias("_n")).select("label", F.explode(tx.grams(F.col("_n"), 1, longest)).alias("gram"))
    counts = rows.groupBy("gram", "label").agg(F.count("*").alias("n"))
    if prune > 1:
        counts = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("gram"))).where(F.col("_all") >= prune).drop("_all")
    return counts


def label_stats(pairs: DataFrame, counts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``label, total, log_prior, vocabulary``; a label without pairs has total 0 and the smoothed prior."""
    spark = pairs.sparkSession
    all_labels = spark.createDataFrame([(x,) for x in labels], "label string")
    types = pairs.groupBy("label").agg(F.count("*").alias("types"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    whole = pairs.agg(F.count("*").alias("pairs")).crossJoin(counts.agg(F.countDistinct("gram").alias("vocabulary")))
    rows = all_labels.join(types, "label", "left").join(totals, "label", "left").crossJoin(whole)
    prior = F.ln((F.coalesce("types", F.lit(0)) + 1) / (F.col("pairs") + len(labels)))
    return rows.select("label", F.coalesce("total", F.lit(0)).alias("total"), prior.alias("log_prior"), "vocabulary")


def wide(counts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``gram`` and one count column a label: the model's exchange format."""
    return counts.groupBy("gram").pivot("label", list(labels)).agg(F.sum("n")).na.fill(0)


def fit(pairs: DataFrame, labels: tuple[str, ...] = tx.LANGUAGES, longest: int = 5, alpha: float = 0.1, temper: float = 0.5, prune: int = 1) -> Model:
    """Pairs of other labels are ignored; without any pair there is no model."""
    pairs = cut(pairs.where(F.col("label").isin(*labels)).select("word", "label"))
    grams = cut(wide(gram_counts(pairs, longest, prune), labels))  # counted once: statistics and predictions read this table
    row = grams.agg(F.count("*").alias("_v"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in labels)).first()
    if not row["_v"]:
        raise ValueError("no training pairs")
    types = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a label
    whole = sum(types.values())
    return Model(grams, [(x, row[x], math.log((types.get(x, 0) + 1) / (whole + len(labels)))) for x in labels], row["_v"], labels, longest, alpha, temper)


def predict(words: DataFrame, word: str, model: Model) -> DataFrame:
    """``word, probs array<double>`` in the order of the model's labels, for distinct words.

    Words are kept in chunks. A chunk asks for each distinct gram once, so neither words nor grams are shuffled as
    often as they occur in one another.
    """
    longest, k = model.longest, len(model.stats)
    priors, totals = (np.array([x[i] for x in model.stats], float) for i in (2, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_WORDS):
                held.append(batch.slice(first, SLICE_WORDS))
                size += held[-1].num_rows
                if size >= CHUNK_WORDS:
                    yield row(at, held)
                    at, held, size = at + 1, [], 0
        if held:
            yield row(at, held)

    def row(at: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found, sizes = [], []
        for batch in held:
            grams = [_grams(w, longest) for w in batch.column(1).to_pylist()]
            sizes += map(len, grams)
            found.append(pa.array(list(chain.from_iterable(grams)), pa.string()).dictionary_encode())
        whole = pa.chunked_array(found).unify_dictionaries()
        codes = np.concatenate([x.indices.to_numpy() for x in whole.chunks])
        names = pa.concat_arrays([x.column(0) for x in held])
        values = [at, pack_numbers(codes), pack_numbers(np.array(sizes)), names.to_pylist(), whole.chunk(0).dictionary.to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], ["chunk", "codes", "sizes", "words", "grams"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        codes, sizes = (unpack_numbers(left[x][0].as_py()) for x in ("codes", "sizes"))
        names = left["words"].combine_chunks().flatten()
        counts = np.zeros((right.num_rows, k))
        place = right["code"].to_numpy()
        for i in range(k):
            counts[place, i] = right[f"n{i}"].to_numpy()
        logs = np.log((counts + model_alpha) / (totals + model_alpha * (vocabulary + 1)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.stack([np.bincount(owner, logs[codes, i], len(sizes)) for i in range(k)], axis=1)
        scores = priors + sums / np.maximum(sizes, 1)[:, None] ** temper
        powers = np.exp(scores - scores.max(axis=1, keepdims=True))
        probs = powers / powers.sum(axis=1, keepdims=True)
        probs[sizes == 0] = 1.0 / len(labels)
        ends = np.arange(len(sizes) + 1, dtype=np.int32) * k
        return pa.table({"word": names, "probs": pa.ListArray.from_arrays(pa.array(ends), pa.array(probs.ravel()))})

    model_alpha, vocabulary, temper, labels = model.alpha, model.vocabulary, model.temper, model.labels
    distinct = words.select(F.col(word).alias("word")).distinct().select("word", tx.normalize(F.col("word")).alias("_n"))
    chunks = cut(distinct.mapInArrow(pack, "chunk long, codes binary, sizes binary, words array<string>, grams array<string>"))
    asked = chunks.select(F.col("chunk").alias("to"), F.posexplode("grams").alias("code", "gram"))
    counted = asked.join(model.grams, "gram", "left").select("to", "code", *(F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(f"n{i}") for i, (x, _, _) in enumerate(model.stats)))
    return chunks.drop("grams").groupBy("chunk").cogroup(counted.groupBy("to")).applyInArrow(score, "word string, probs array<double>")


def _grams(norm: str | None, longest: int) -> list[str]:
    """What ``text.grams`` gives, from one on."""
    if norm is None:
        return []
    b = f"<{norm}>"
    return [g for n in range(1, min(longest, len(b)) + 1) for i in range(len(b) + 1 - n) if (g := b[i : i + n]) not in ("<", ">")]


def save(model: Model, path: str) -> None:
    """The model as Parquet tables."""
    spark = model.grams.sparkSession
    model.grams.write.mode("errorifexists").parquet(f"{path}/grams")
    rows = [(x, t, p, i, model.vocabulary, model.longest, model.alpha, model.temper) for i, (x, t, p) in enumerate(model.stats)]
    spark.createDataFrame(rows, "label string, total long, log_prior double, place int, vocabulary long, longest int, alpha double, temper double").write.parquet(f"{path}/stats")


def load(spark, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/stats").orderBy("place").collect()
    return Model(spark.read.parquet(f"{path}/grams"), [(r["label"], r["total"], r["log_prior"]) for r in rows], rows[0]["vocabulary"], tuple(r["label"] for r in rows), rows[0]["longest"], rows[0]["alpha"], rows[0]["temper"])


FORMAT = "glossmill-ngram-1"
JSON = "format string, n_min int, labels array<string>, n_max int, alpha double, temp_power double, log_priors map<string,double>, totals map<string,bigint>, vocab_size bigint, counts map<string,map<string,bigint>>"


def prune(model: Model, least: int) -> Model:
    """The model without grams counted fewer than ``least`` times in all; totals and vocabulary follow, priors stay."""
    all_of = sum((F.col(x) for x in model.labels[1:]), F.col(model.labels[0]))
    grams = model.grams.where(all_of >= least)
    row = grams.agg(F.count("*").alias("_v"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in model.labels)).first()
    return replace(model, grams=grams, stats=[(x, row[x], p) for x, _, p in model.stats], vocabulary=row["_v"])


def save_json(model: Model, path: str) -> None:
    """The model as one JSON object, for hosts without Spark; meant for pruned models, as one task writes it."""
    counts = model.grams.agg(*(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(x) > 0, F.struct("gram", F.col(x).alias("n")))))).alias(x) for x in model.labels))
    by_label = lambda at: F.create_map(*(v for s in model.stats for v in (F.lit(s[0]), F.lit(s[at]))))
    row = counts.select(
        F.lit(FORMAT).alias("format"), F.array(*map(F.lit, model.labels)).alias("labels"), F.lit(1).alias("n_min"), F.lit(model.longest).alias("n_max"), F.lit(model.alpha).alias("alpha"), F.lit(model.temper).alias("temp_power"),
        by_label(2).alias("log_priors"), by_label(1).alias("totals"), F.lit(model.vocabulary).alias("vocab_size"), F.create_map(*(v for x in model.labels for v in (F.lit(x), F.col(x)))).alias("counts"),
    )
    row.coalesce(1).write.json(path)


def load_json(spark, path: str) -> Model:
    """A model of one JSON object with these fields; ``temp_power`` may be missing and is 0.5 then."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", JSON).alias("m")).select("m.*")
    head = rows.drop("counts").first()
    if head is None or not head["labels"] or head["log_priors"] is None or head["totals"] is None:
        raise ValueError(f"{path}: not a model")
    if head["format"] not in (None, FORMAT):  # models of before the tag have none
        raise ValueError(f"{path}: a model of format {head['format']!r}")
    if head["n_min"] not in (None, 1):
        raise ValueError(f"{path}: n-grams from {head['n_min']} on; only models from 1 on can be read")
    labels = tuple(head["labels"])
    flat = rows.select(F.explode("counts").alias("label", "grams")).select("label", F.explode("grams").alias("gram", "n"))
    temper = 0.5 if head["temp_power"] is None else head["temp_power"]
    return Model(wide(flat, labels), [(x, head["totals"].get(x, 0), head["log_priors"][x]) for x in labels], head["vocab_size"], labels, head["n_max"], head["alpha"], temper)
