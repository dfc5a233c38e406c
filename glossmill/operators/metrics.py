"""Confusion, precision, recall and F1 of predicted labels against gold ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def scores(table: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` from a confusion table; 0 where a denominator is 0."""
    as_gold = table.select(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("predicted"), F.col("n").alias("support"))
    as_pred = table.select(F.col("pred").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("predicted"), F.lit(0).alias("support"))
    sums = as_gold.unionByName(as_pred).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "predicted", "support")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    rows = sums.select("label", p.alias("precision"), r.alias("recall"), "support")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def accuracy(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("tokens"))


def suite(rows: DataFrame, name: str, target: str = "fra") -> DataFrame:
    """``suite, words, acc, p, r, f1``: accuracy, and how well ``target`` is found; tokens predicted univ don't count."""
    hit, said, meant = (F.count_if((F.col("gold") == target) & (F.col("pred") == target)), F.count_if(F.col("pred") == target), F.count_if(F.col("gold") == target))
    sums = rows.where("pred <> 'univ'").agg(F.count("*").alias("words"), F.count_if(F.col("gold") == F.col("pred")).alias("right"), hit.alias("tp"), said.alias("said"), meant.alias("meant"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.select(F.lit(name).alias("suite"), "words", ratio("right", "words").alias("acc"), ratio("tp", "said").alias("p"), ratio("tp", "meant").alias("r"))
    return out.withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def suites(identify: Callable[[DataFrame], DataFrame], pairs: DataFrame, key: str, host: str, guest: str, labels: tuple[str, str] = ("bam", "fra")) -> DataFrame:
    """``suite, words, acc, p, r, f1`` of the four suites over aligned texts: hosts, guests, hosts in informal spelling, guests' words spliced into hosts.

    ``identify`` gives tokens (key, start, label) of texts (key, text). Tokens predicted univ don't count.
    """
    a, b = labels
    hosts = pairs.select(key, F.col(host).alias("text"))
    spliced = words.splice(pairs, key, host, guest)
    found = lambda texts: identify(texts.select(key, "text")).select(key, "start", F.col("label").alias("pred"))
    inside = (F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi"))
    parts = [
        suite(found(hosts).withColumn("gold", F.lit(a)), a, b), suite(found(pairs.select(key, F.col(guest).alias("text"))).withColumn("gold", F.lit(b)), b, b),
        suite(found(words.informalize(hosts, key, "text")).withColumn("gold", F.lit(a)), f"{a}-inf", b),
        suite(found(spliced).join(spliced.select(key, "lo", "hi"), key).withColumn("gold", F.when(inside, b).otherwise(a)), "cs-synth", b),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def macro(suites: DataFrame) -> DataFrame:
    return suites.agg(F.avg("acc").alias("macro_acc"))
