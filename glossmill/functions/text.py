"""Tokens, spelling rules and character n-grams as Column functions.

The patterns use only what Java's and RE2's syntax share, with explicit Unicode classes, so the same text
serves Spark and an SQL oracle. Offsets count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import piece_counts

# Character classes, clitics, spelling marks, label order.
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}"
WORDISH = r"\p{L}\p{N}_"
LETTER = r"\p{L}\p{Nl}\p{No}"
MARK = r"\x{300}-\x{36f}\x{7eb}-\x{7f5}\x{7fd}"
DIGIT = r"\p{Nd}"
APOSTROPHE = "'’ʼ"
URL = rf"(?:https?://|www\.)[^{SPACE}]+"
EMAIL = rf"[{WORDISH}.+\-]+@[{WORDISH}\-]+\.[{WORDISH}.\-]+"
TAG = rf"[@#][{WORDISH}]+"
NUMBER = rf"[{DIGIT}]+(?:[.,:/][{DIGIT}]+)*(?:[{LETTER}{MARK}][{LETTER}{MARK}{DIGIT}]*)?"
WORD = rf"[{LETTER}][{LETTER}{MARK}]*(?:[{APOSTROPHE}\-][{LETTER}][{LETTER}{MARK}]*)*"
TILE = rf"{URL}|{EMAIL}|{TAG}|{NUMBER}|{WORD}|[{SPACE}]+|(?s:.)"
TOKEN = rf"{URL}|{EMAIL}|{TAG}|{NUMBER}|{WORD}|[^{SPACE}]"
BLANK = rf"^[{SPACE}]+$"
WORD_FULL = rf"^{WORD}$"
CLITIC_FULL = rf"^[{LETTER}]{{1,6}}[{APOSTROPHE}]$"
CLITIC = rf"^((?i:jusqu|lorsqu|puisqu|presqu|quoiqu|qu|[{LETTER}]{{1,2}})[{APOSTROPHE}])([{LETTER}].*)$"
CONTRACTIONS = ("s", "t", "re", "ve", "ll", "d", "m")
APOSTROPHES = "’‘ʼ`´"
ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
NKO = r"[\x{7c0}-\x{7ff}]"
ARABIC = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
BAM_LETTERS = "[ɛɔɲŋ]"
BAM_TONES = "[áíóúǎěǐǒǔ]"
FRA_MARKS = "[éêëâîïôûùüÿçœæà]"
FRA_CLITICS = ("l'", "d'", "j'", "c'", "qu'", "jusqu'", "lorsqu'", "puisqu'", "presqu'", "quoiqu'")
BAM_CLITICS = ("k'", "b'", "y'")
SENTENCE_END = (".", "!", "?", "…", ":", "\n", '."', '!"', '?"')
LANGUAGES = ("bam", "fra", "eng")
LABELS = (*LANGUAGES, "univ")
SOURCES = ("router", "lexicon", "classifier", "context")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize(text: Column, compose: bool = True) -> Column:
    """NFC, one apostrophe, lower case. Composition runs in Python batches: apply this to distinct words; ``compose``
    false leaves it out for texts that are composed already."""
    return F.lower(F.translate(nfc(text) if compose else text, APOSTROPHES, "'" * len(APOSTROPHES)))


def fold(text: Column) -> Column:
    """Old spelling of open vowels to the official letters."""
    return F.translate(text, "èò", "ɛɔ")


def kind_of(word: Column) -> Column:
    return F.when(word.rlike(CLITIC_FULL), "CLITIC").when(word.rlike(WORD_FULL), "WORD").otherwise("UNIV")


def tiles(text: Column) -> Column:
    """The text cut into tokens and runs of white space, nothing left out."""
    return F.regexp_extract_all(text, F.lit(TILE), 0)


def pieces_of(tile: Column) -> Column:
    """A tile as one token, or as an elided head and its host; array of (text, shift, kind)."""
    head, rest = F.regexp_extract(tile, CLITIC, 1), F.regexp_extract(tile, CLITIC, 2)
    word = tile.rlike(WORD_FULL)
    split = word & (head != "") & ~normalize(rest, False).isin(*CONTRACTIONS)
    one = lambda t, shift, kind: F.struct(t.alias("text"), shift.cast("int").alias("shift"), kind.alias("kind"))
    whole = F.array(one(tile, F.lit(0), F.when(word, F.lit("WORD")).otherwise(F.lit("UNIV"))))
    return F.when(split, F.array(one(head, F.lit(0), F.lit("CLITIC")), one(rest, F.length(head), F.lit("WORD")))).otherwise(whole)


def _bare(text: str) -> Column:
    """The tokens of a text before clitics are split, without white space."""
    return F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0)


def token_kinds(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Tokens without offsets: nothing is shuffled. A null text has none."""
    tile = docs.select(*keep, F.explode(_bare(text)).alias("tile"))
    return tile.select(*keep, F.explode(pieces_of(F.col("tile"))).alias("p")).select(*keep, "p.text", "p.kind")


def token_counts(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep, text, kind, n``: how often each token occurs. Rules run on distinct tokens only."""
    schema = T.StructType([*(docs.schema[x] for x in keep), T.StructField("_piece", T.StringType()), T.StructField("n", T.LongType())])
    counted = docs.select(F.col(text).alias("_text"), *keep).mapInArrow(piece_counts, schema)
    counted = counted.groupBy(*keep, "_piece").agg(F.sum("n").alias("n"))
    tile = counted.select(*keep, "n", F.explode(_bare("_piece")).alias("tile"))
    parts = tile.select(*keep, "n", F.explode(pieces_of(F.col("tile"))).alias("p"))
    return parts.groupBy(*keep, F.col("p.text").alias("text"), F.col("p.kind").alias("kind")).agg(F.sum("n").alias("n"))


def word_number(text: str) -> Column:
    """How many words a text has: nothing is exploded. 0 for a null text."""
    return F.coalesce(F.size(F.filter(_bare(text), lambda t: t.rlike(WORD_FULL))), F.lit(0))


def tokenize(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``key, pos, text, start, end, kind``: tokens with offsets; ``pos`` counts tokens from 0."""
    running = Window.partitionBy(key).orderBy("tile_no")
    laid = docs.select(key, *keep, F.posexplode(tiles(F.col(text))).alias("tile_no", "tile"))
    laid = laid.withColumn("at", F.sum(F.length("tile")).over(running.rowsBetween(Window.unboundedPreceding, 0)) - F.length("tile")).where(~F.col("tile").rlike(BLANK))
    cut_up = laid.select(key, *keep, "tile_no", "at", F.posexplode(pieces_of(F.col("tile"))).alias("part", "p"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("tile_no", "part")) - 1
    start = F.col("at") + F.col("p.shift")
    return cut_up.select(key, *keep, pos.alias("pos"), "p.text", start.cast("long").alias("start"), (start + F.length("p.text")).cast("long").alias("end"), "p.kind")


def pretokenized(words: DataFrame, key: str, pos: str, word: str) -> DataFrame:
    """Given tokens as if joined by one blank: same columns as ``tokenize``."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(word) + 1).over(before), F.lit(0))
    return words.select(key, F.col(pos).alias("pos"), F.col(word).alias("text"), start.cast("long").alias("start"), (start + F.length(word)).cast("long").alias("end"), kind_of(F.col(word)).alias("kind"))


def is_roman(word: Column) -> Column:
    return word.rlike(ROMAN) & ~word.isin("", "I")


def _route(label: str, confidence: float, final: bool) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(final).alias("final"))


def route_hard(word: Column, kind: Column, norm: Column) -> Column:
    """Rules that nothing overrides, or null."""
    return (
        F.when((kind == "UNIV") | is_roman(word), _route("univ", 1.0, True))
        .when(norm.rlike(NKO), _route("bam", 0.999, True))
        .when(norm.rlike(ARABIC), _route("univ", 1.0, True))
        .when(norm.rlike(BAM_LETTERS), _route("bam", 0.999, True))
    )


def route_spelling(kind: Column, norm: Column, french_final: bool = True) -> Column:
    """Spelling rules that come behind the lexicon, or null."""
    clitic = kind == "CLITIC"
    return (
        F.when(clitic & norm.isin(*FRA_CLITICS), _route("fra", 0.95, False))
        .when(clitic & norm.isin(*BAM_CLITICS), _route("bam", 0.95, False))
        .when(~clitic & norm.rlike(FRA_MARKS), _route("fra", 0.97, french_final))
        .when(~clitic & norm.rlike(BAM_TONES), _route("bam", 0.9, False))
    )


def grams(norm: Column, shortest: int = 1, longest: int = 5) -> Column:
    """All character n-grams of ``<norm>`` with multiplicity, but for the lone brackets."""
    b = F.concat(F.lit("<"), norm, F.lit(">"))
    size = F.length(b)
    per_n = F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), size)), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(b, i, n)))
    return F.filter(F.flatten(per_n), lambda g: ~g.isin("<", ">"))


def starts_upper(word: Column) -> Column:
    """Begins with a capital, but isn't capitals only."""
    return F.substring(word, 1, 1).rlike(r"^\p{Lu}") & ~((F.upper(word) == word) & (F.lower(word) != word))


def mid_sentence(tokens: DataFrame, key: str) -> DataFrame:
    """``tokens`` with ``mid``: does a word of the same sentence come before?"""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sign = F.when(F.col("kind") != "UNIV", True).when(F.col("text").isin(*SENTENCE_END), False)
    return tokens.withColumn("mid", F.coalesce(F.last(sign, ignorenulls=True).over(before), F.lit(False)))
