"""Word-level language identification: rules, lexicon, classifier, decoder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as tx

from . import bayes, chunked, words
from .decode import decoder
from .views import summarize


@dataclass(frozen=True)
class Config:
    stay: float = 0.8
    lexicon_confidence: float = 0.995
    french_final: bool = True
    ambiguous_use_classifier: bool = False
    names_follow_context: bool = True
    name_weight: float = 0.3
    labels: tuple[str, ...] = tx.LANGUAGES  # their order breaks ties
    compose: bool = True  # bring words to NFC before looking them up


def one_hot(label: Column, confidence: Column, labels: tuple[str, ...]) -> Column:
    rest = (1 - confidence) / (len(labels) - 1)
    return F.array(*(F.when(label == x, confidence).otherwise(rest) for x in labels))


def decide(distinct: DataFrame, lexicon: DataFrame, model: bayes.WordClassifier, config: Config = Config()) -> DataFrame:
    """``text, kind, emission, source, forced, named`` for distinct (text, kind) that are words.

    The classifier sees only what rules and lexicon leave open. ``named`` is the emission to use instead where
    the word is a capitalised one within a sentence.
    """
    labels = config.labels
    rows = distinct.withColumn("norm", tx.normalize(F.col("text"), config.compose))
    rows = words.lookup(rows, lexicon)
    rows = rows.withColumn("hard", tx.route_hard(F.col("text"), F.col("kind"), F.col("norm"))).withColumn("spelling", tx.route_spelling(F.col("kind"), F.col("norm"), config.french_final))
    ambiguous = F.size("weights") > 1
    open_ = F.col("hard").isNull() & F.col("weights").isNull() & F.col("spelling").isNull() & (F.col("kind") == "WORD")
    if config.ambiguous_use_classifier:
        open_ = open_ | (F.col("hard").isNull() & ambiguous)
    probs = model.predict(rows.where(open_), "text").select(F.col("word").alias("text"), "probs")
    if model.labels != labels:
        probs = probs.withColumn("probs", F.array(*(F.col("probs")[model.labels.index(x)] if x in model.labels else F.lit(0.0) for x in labels)))
    rows = rows.join(probs, "text", "left")
    prior = F.array(*(F.coalesce(F.element_at("weights", F.lit(x)), F.lit(0.0)) for x in labels))
    if config.ambiguous_use_classifier:
        mixed = F.zip_with(prior, "probs", lambda w, p: w * F.greatest(p, F.lit(1e-3)))
        total = F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x)
        many = F.transform(mixed, lambda x: x / total)
    else:
        many = prior
    single = F.map_keys("weights")[0]
    shared = F.array(*(F.lit(0.5 if x in ("bam", "fra") else 0.0) for x in labels))
    emission = (
        F.when(F.col("hard.label") == "univ", F.array().cast("array<double>"))
        .when(F.col("hard").isNotNull(), one_hot(F.col("hard.label"), F.col("hard.confidence"), labels))
        .when(F.size("weights") == 1, one_hot(single, F.lit(config.lexicon_confidence), labels))
        .when(ambiguous, many)
        .when(F.col("spelling").isNotNull(), one_hot(F.col("spelling.label"), F.col("spelling.confidence"), labels))
        .when(F.col("kind") == "CLITIC", shared)
        .otherwise(F.col("probs"))
    )
    source = F.when(F.col("hard").isNotNull(), "router").when(F.col("weights").isNotNull(), "lexicon").when(F.col("spelling").isNotNull(), "router").when(F.col("kind") == "CLITIC", "context").otherwise("classifier")
    forced = F.when(F.col("hard").isNotNull(), F.col("hard.label")).when(F.col("weights").isNull() & F.col("spelling.final"), F.col("spelling.label"))
    w, flat = config.name_weight, (1 - config.name_weight) / len(labels)
    name = F.lit(config.names_follow_context) & (source == "classifier") & tx.starts_upper(F.col("text"))
    named = F.when(name, F.transform("probs", lambda p: w * p + flat))
    return rows.select("text", "kind", emission.alias("emission"), source.alias("source"), forced.alias("forced"), named.alias("named"))


def resolve(tokens: DataFrame, key: str, decisions: DataFrame, config: Config = Config()) -> DataFrame:
    """``key, pos, text, start, end, label, confidence, source`` for tokens (key, pos, text, start, end, kind)."""
    labels = F.array(*(F.lit(x) for x in config.labels))
    rows = tx.mid_sentence(tokens, key).join(decisions, ["text", "kind"], "left")
    use_name = F.col("mid") & F.col("named").isNotNull()
    rows = rows.withColumn("emission", F.when(use_name, F.col("named")).otherwise(F.col("emission"))).withColumn("source", F.when(use_name, "context").otherwise(F.col("source")))
    in_chain = (F.col("kind") != "UNIV") & (F.coalesce("forced", F.lit("")) != "univ")
    item = F.struct("pos", "text", "start", "end", in_chain.alias("chain"), "emission", "source", "forced")
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<double>")
    docs = docs.withColumn("post", decoder(config.stay)(F.transform("items", lambda x: F.when(x["chain"], x["emission"]).otherwise(empty))))
    flat = docs.select(key, F.explode(F.arrays_zip("items", "post")).alias("z")).select(key, "z.items.*", F.col("z.post").alias("p"))
    best = lambda c: F.element_at(labels, F.array_position(c, F.array_max(c)).cast("int"))
    own = lambda c, label: F.element_at(c, F.array_position(labels, label).cast("int"))
    label = F.when(~F.col("chain"), "univ").otherwise(F.coalesce("forced", best(F.col("p"))))
    flat = flat.withColumn("label", label)
    confidence = F.when(~F.col("chain"), 1.0).when(F.col("forced").isNotNull(), F.greatest(own(F.col("p"), F.col("label")), own(F.col("emission"), F.col("label")))).otherwise(own(F.col("p"), F.col("label")))
    source = F.when(~F.col("chain") | F.col("forced").isNotNull(), "router").when(F.col("label") == best(F.col("emission")), F.col("source")).otherwise("context")
    return flat.select(key, "pos", "text", "start", "end", "label", F.round(confidence, 4).alias("confidence"), source.alias("source"))


class Identifier:
    def __init__(self, lexicon: DataFrame, model: bayes.WordClassifier, config: Config = Config()):
        self.lexicon, self.model, self.config = lexicon, model, config

    def identify_tokens(self, tokens: DataFrame, key: str) -> DataFrame:
        distinct = tokens.where("kind <> 'UNIV'").select("text", "kind").distinct()
        return resolve(tokens, key, decide(distinct, self.lexicon, self.model, self.config), self.config)

    def identify(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``key, pos, text, start, end, label, confidence, source``; each row of ``docs`` is a text of its own."""
        return chunked.tokens(*self._settled(docs, key, text), key, docs.schema[key].dataType, self.config)

    def tally(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``label, source, n``: how many of ``identify``'s tokens have them."""
        return chunked.tally(*self._settled(docs, key, text), self.config)

    def _settled(self, docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
        chunks = chunked.pack(docs, key, text)
        found = chunked.piece_tokens(chunks)
        distinct = found.where("kind <> 'UNIV'").select("text", "kind").distinct()
        return chunks, chunked.answers(chunks, found, decide(distinct, self.lexicon, self.model, self.config), self.config)

    def identify_pretokenized(self, rows: DataFrame, key: str, pos: str, word: str) -> DataFrame:
        return self.identify_tokens(tx.pretokenized(rows, key, pos, word), key)

    def tag(self, docs: DataFrame, key: str, text: str, include_punct: bool = False) -> DataFrame:
        """``key, tags array<struct<text, label>>``, one row a document."""
        rows = self.identify(docs, key, text)
        if not include_punct:
            rows = rows.where("label <> 'univ'")
        tags = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "label"))), lambda x: F.struct(x["text"], x["label"])).alias("tags"))
        return docs.select(key).join(tags, key, "left")

    def detect(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``key, dominant``; null for documents without words."""
        return summarize(docs, self.identify(docs, key, text), key, self.config.labels).select(key, "dominant")

    def is_code_switched(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        return summarize(docs, self.identify(docs, key, text), key, self.config.labels).select(key, "code_switched")
