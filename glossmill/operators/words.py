"""Lexicon, word lists, training pairs and side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as tx

# Spellings of open letters, and colonial spellings applied after them.
STRIPPED = (("ɛ", "e"), ("ɔ", "o"), ("ɲ", "ny"), ("ŋ", "ng"))
OLD_FRENCH = (("ɛ", "è"), ("ɔ", "ò"), ("ɲ", "gn"), ("ŋ", "ng"))
COLONIAL = (("c", "tch"), ("j", "dj"), ("u", "ou"))
ALIASES = {"bm": "bam", "bam": "bam", "bambara": "bam", "fr": "fra", "fra": "fra", "french": "fra", "en": "eng", "eng": "eng", "english": "eng"}


def lexicon_table(entries: DataFrame) -> DataFrame:
    """``form, weights map``: weights of each normalised form, summing to 1. Input: form, label, weight."""
    rows = entries.select(tx.normalize(F.trim("form")).alias("form"), "label", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    bad = lambda why: F.raise_error(F.concat(F.lit(f"lexicon: {why}: "), "form"))
    known = F.coalesce(F.forall(F.collect_list("label"), lambda x: x.isin(*tx.LANGUAGES)), F.lit(False)) & (F.count("label") == F.count("*"))
    check = F.when(~known, bad("unknown label")).when(F.count("label") > F.count_distinct("label"), bad("form given twice")).when(F.sum("weight") <= 0, bad("weights must be positive"))
    rows = rows.groupBy("form").agg(F.collect_list(F.struct("label", "weight")).alias("items"), F.sum("weight").alias("total"), check.alias("ok")).where("ok is null")
    return rows.select("form", F.map_from_entries(F.transform(F.sort_array("items"), lambda x: F.struct(x["label"], x["weight"] / F.col("total")))).alias("weights"))


def lookup(words: DataFrame, lexicon: DataFrame, norm: str = "norm") -> DataFrame:
    """``words`` with the lexicon's ``weights`` of the form or else of its folded form; null if in neither."""
    direct = lexicon.select(F.col("form").alias(norm), F.col("weights").alias("_direct"))
    folded = lexicon.select(F.col("form").alias("_folded"), F.col("weights").alias("_other"))
    found = words.join(direct, norm, "left").withColumn("_folded", tx.fold(F.col(norm))).join(folded, "_folded", "left")
    return found.withColumn("weights", F.coalesce("_direct", "_other")).drop("_direct", "_other", "_folded")


def labels_of(weights: Column) -> Column:
    return F.map_keys(weights)


def single_label_items(lexicon: DataFrame) -> DataFrame:
    return lexicon.where(F.size("weights") == 1).select(F.col("form").alias("word"), F.map_keys("weights")[0].alias("label"))


def canon(language: Column) -> Column:
    """A language name or code as its label; null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.element_at(table, F.lower(F.trim(language)))


def word_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """``word, label, n``: words of texts by the texts' label; words that a hard rule gives to another label don't count."""
    counted = tx.token_counts(docs, text, label).where("kind = 'WORD'").withColumn("norm", tx.normalize(F.col("text"))).withColumnRenamed(label, "label")
    hard = tx.route_hard(F.col("text"), F.col("kind"), F.col("norm"))["label"]
    return counted.where(hard.isNull() | (hard == F.col("label"))).groupBy(F.col("norm").alias("word"), "label").agg(F.sum("n").alias("n"))


def frequency_counts(entries: DataFrame, word: str, label: str, n: str) -> DataFrame:
    """The same from frequency lists: an entry counts if it is one word."""
    tiles = F.filter(tx.tiles(F.col(word)), lambda t: ~t.rlike(tx.BLANK))
    parts = tx.pieces_of(tiles[0])
    one = entries.where((F.size(tiles) == 1) & (F.size(parts) == 1) & (parts[0]["kind"] == "WORD"))
    return one.groupBy(tx.normalize(F.col(word)).alias("word"), F.col(label).alias("label")).agg(F.sum(n).alias("n"))


def purity(counts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``word, label, count, purity, counts``: each word's most frequent label; of equal ones the first in ``order``."""
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("label"))
    best = F.max_by("label", F.struct("n", -rank))
    detail = F.concat_ws(",", F.sort_array(F.collect_list(F.concat("label", F.lit(":"), "n"))))
    return counts.groupBy("word").agg(best.alias("label"), F.sum("n").alias("count"), F.round(F.max("n") / F.sum("n"), 3).alias("purity"), detail.alias("counts"))


def pairs_from_list(rows: DataFrame, labels: tuple[str, ...], min_count: int = 1, min_purity: float = 0.0) -> DataFrame:
    return rows.where(F.col("label").isin(*labels) & (F.col("count") >= min_count) & (F.col("purity") >= min_purity)).select(tx.normalize(F.col("word")).alias("word"), "label").distinct()


def resolve_conflicts(pairs: DataFrame, lexicon: DataFrame, keep_ambiguous: bool = False) -> DataFrame:
    """Words with several labels take the lexicon's only label if that is one of them; else all or none are kept."""
    by_word = pairs.groupBy("word").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    found = lookup(by_word.withColumn("norm", F.col("word")), lexicon)
    sole = F.when(F.size("weights") == 1, F.map_keys("weights")[0])
    settled = F.when(F.size("labels") == 1, F.col("labels")).when(F.array_contains("labels", sole), F.array(sole))
    kept = F.coalesce(settled, F.col("labels")) if keep_ambiguous else settled
    return found.select("word", F.explode(kept).alias("label"))


def _replace(word: Column, table: tuple[tuple[str, str], ...]) -> Column:
    for a, b in table:
        word = F.replace(word, F.lit(a), F.lit(b))
    return word


def variants(word: Column) -> Column:
    """Informal spellings of a word, without itself."""
    plain = [_replace(word, t) for t in (STRIPPED, OLD_FRENCH)]
    return F.array_except(F.array_distinct(F.array(*plain, *(_replace(p, COLONIAL) for p in plain))), F.array(word))


def augment(pairs: DataFrame, label: str = "bam") -> DataFrame:
    """Pairs and the informal spellings of the label's words, unless any label has that form already."""
    extra = pairs.where(F.col("label") == label).select(F.explode(variants(F.col("word"))).alias("word"), "label").distinct()
    return pairs.distinct().union(extra.join(pairs.select("word"), "word", "left_anti"))


def informalize(texts: DataFrame, key: str, text: str, strip_percent: int = 70, colonial_percent: int = 25, prime: int = 7919) -> DataFrame:
    """Texts as often typed: one spelling table a text, colonial spelling for some words.

    Coins are arithmetic on the key and the word's place, so a text always gets the same spelling.
    """
    coin = lambda place: F.pmod(F.col(key) * prime + place * 104729, F.lit(100))
    word = F.transform(F.split(text, " "), lambda w, i: F.when(coin(i + 1) < colonial_percent, _replace(F.when(coin(F.lit(0)) < strip_percent, _replace(w, STRIPPED)).otherwise(_replace(w, OLD_FRENCH)), COLONIAL)).otherwise(F.when(coin(F.lit(0)) < strip_percent, _replace(w, STRIPPED)).otherwise(_replace(w, OLD_FRENCH))))
    return texts.withColumn(text, F.array_join(word, " "))


def splice(pairs: DataFrame, key: str, host: str, guest: str, prime: int = 7919) -> DataFrame:
    """Hosts with 1 to 3 consecutive words of the guest put at an inner word boundary, and the code-point span they take.

    Choices are arithmetic on the key. Pairs with fewer than two host words or no guest word are left out.
    """
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    rows = pairs.select(key, words(host).alias("h"), F.filter(words(guest), lambda w: w.rlike(tx.WORD_FULL)).alias("g")).where("size(h) >= 2 and size(g) >= 1")
    seed = F.col(key) * prime
    rows = rows.withColumn("k", F.least(1 + F.pmod(seed, F.lit(3)), F.size("g")).cast("int"))
    rows = rows.withColumn("i", F.pmod(seed + 11, F.size("g") - F.col("k") + 1).cast("int")).withColumn("cut", (1 + F.pmod(seed + 23, F.size("h") - 1)).cast("int"))
    part = F.array_join(F.slice("g", F.col("i") + 1, F.col("k")), " ")
    part = F.when(F.col("i") == 0, F.concat(F.lower(F.substring(part, 1, 1)), F.substring(part, 2, 1 << 30))).otherwise(part)
    left, right = F.array_join(F.slice("h", F.lit(1), F.col("cut")), " "), F.array_join(F.slice("h", F.col("cut") + 1, F.size("h")), " ")
    lo = F.length(left) + 1
    return rows.select(key, F.concat_ws(" ", left, part, right).alias("text"), lo.cast("long").alias("lo"), (lo + F.length(part)).cast("long").alias("hi"))


def annotate_origins(tokens: DataFrame, origins: DataFrame, label: str = "bam") -> DataFrame:
    """``tokens`` (text, label) with origin_lang and source_form of words of ``label``; labels stay as they are."""
    base = origin_table(origins)
    rows = tokens.withColumn("_n", F.when(F.col("label") == label, tx.normalize(F.col("text")))).withColumn("_f", tx.fold(F.col("_n")))
    a = base.select(F.col("form").alias("_n"), F.struct("origin_lang", "source_form").alias("_a"))
    b = base.select(F.col("form").alias("_f"), F.struct("origin_lang", "source_form").alias("_b"))
    found = rows.join(a, "_n", "left").join(b, "_f", "left").withColumn("_o", F.coalesce("_a", "_b"))
    return found.withColumn("origin_lang", F.col("_o.origin_lang")).withColumn("source_form", F.col("_o.source_form")).drop("_n", "_f", "_a", "_b", "_o")


def origin_table(origins: DataFrame) -> DataFrame:
    """``form, origin_lang, source_form`` by normalised form. A form given twice or a language that isn't three small letters raises."""
    bad = lambda why: F.raise_error(F.concat(F.lit(f"origins: {why}: "), "form"))
    check = F.when(F.count("*") > 1, bad("form given twice")).when(~F.coalesce(F.min("origin_lang").rlike("^[a-z]{3}$"), F.lit(False)), bad("language must be an ISO 639-3 code"))
    rows = origins.select(tx.normalize(F.col("form")).alias("form"), "origin_lang", "source_form")
    return rows.groupBy("form").agg(F.first("origin_lang").alias("origin_lang"), F.first("source_form").alias("source_form"), check.alias("ok")).where("ok is null").drop("ok")


def misplaced_origins(origins: DataFrame, lexicon: DataFrame, label: str = "bam") -> DataFrame:
    """``form``: forms of the origin table that the lexicon doesn't list with ``label`` alone; a consistent pair of tables has none."""
    own = lexicon.where((F.size("weights") == 1) & F.map_contains_key("weights", label)).select("form")
    return origin_table(origins).select("form").join(own, "form", "left_anti")


def span_statistics(lines: DataFrame, key: str, tokens: DataFrame, inner: str = "fra", only_switched: bool = False) -> DataFrame:
    """``stat, n`` of a conversion by ``marked_spans``: lines read, dropped, left out as they don't switch, written, switched; tokens a label."""
    per = tokens.groupBy(key).agg(F.max((F.col("label") == inner).cast("int")).alias("switched"), *(F.count_if(F.col("label") == x).alias(x) for x in tx.LABELS))
    rows = lines.select(key).join(per, key, "left")
    kept = F.col("switched").isNotNull() & (F.lit(not only_switched) | (F.col("switched") == 1))
    sums = [F.count("*").alias("rows"), F.count_if(F.col("switched").isNull()).alias("dropped"), F.count_if(F.col("switched").isNotNull() & ~kept).alias("skipped"), F.count_if(kept).alias("sentences"), F.count_if(kept & (F.col("switched") == 1)).alias("switched")]
    sums += [F.coalesce(F.sum(F.when(kept, F.col(x))), F.lit(0)).alias(f"label_{x}") for x in tx.LABELS]
    row = rows.agg(*sums)
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).cast("long").alias("n")) for c in row.columns))).alias("s")).select("s.*")


def type_counts(pairs: DataFrame) -> DataFrame:
    """``label, types``: distinct words of each label."""
    return pairs.select("word", "label").distinct().groupBy("label").agg(F.count("*").alias("types"))


def by_origin(origins: DataFrame, language: str) -> DataFrame:
    return origins.where(F.col("origin_lang") == language)


def marked_spans(lines: DataFrame, key: str, text: str, inner: str = "fra", outer: str = "bam") -> DataFrame:
    """``key, pos, token, label`` from lines whose switched spans stand between double underscores.

    Annotations in brackets are dropped. A line is rejected if it is blank, has an odd number of marks, or has
    a word with open letters inside a marked span.
    """
    clean = F.regexp_replace(F.col(text), r"\[[^\]]*\]|<[^>]*>|\{[^}]*\}|\([^)]*\)", " ")
    rows = lines.select(key, F.split(clean, "__").alias("_parts")).where((F.size("_parts") % 2 == 1) & (F.trim(F.array_join("_parts", "")) != ""))
    parts = rows.select(key, F.posexplode("_parts").alias("_part", "_text"))
    tile = parts.select(key, "_part", F.posexplode(tx.tiles(F.col("_text"))).alias("_tile_no", "_tile")).where(~F.col("_tile").rlike(tx.BLANK))
    tok = tile.select(key, "_part", "_tile_no", F.posexplode(tx.pieces_of(F.col("_tile"))).alias("_piece", "p")).select(key, "_part", "_tile_no", "_piece", "p.text", "p.kind")
    hard = tx.route_hard(F.col("text"), F.col("kind"), tx.normalize(F.col("text")))["label"]
    inside = F.col("_part") % 2 == 1
    label = F.when(F.col("kind") == "UNIV", "univ").otherwise(F.coalesce(hard, F.when(inside, inner).otherwise(outer)))
    bad = F.max((inside & tx.normalize(F.col("text")).rlike(tx.BAM_LETTERS)).cast("int")).over(Window.partitionBy(key))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_part", "_tile_no", "_piece")) - 1
    return tok.select(key, pos.alias("pos"), F.col("text").alias("token"), label.alias("label"), bad.alias("_bad")).where("_bad = 0").drop("_bad")


def unpivot_languages(wide: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``key, lang, text`` of every filled language column."""
    return wide.select(key, F.explode(F.array(*(F.struct(F.lit(lang).alias("lang"), F.col(c).alias("text")) for c, lang in columns.items()))).alias("x")).select(key, "x.lang", "x.text").where("text is not null and trim(text) <> ''")


def unpivot_pairs(pairs: DataFrame, key: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``key, lang, text`` of both sides of pairs (src, tgt, src_lang, tgt_lang, provenance); unknown languages and excluded origins go."""
    kept = pairs
    for word in exclude:
        kept = kept.where(~F.contains(F.lower(F.coalesce("provenance", F.lit(""))), F.lit(word.lower())))
    both = F.array(F.struct(canon(F.col("src_lang")).alias("lang"), F.col("src").alias("text")), F.struct(canon(F.col("tgt_lang")).alias("lang"), F.col("tgt").alias("text")))
    return kept.select(key, F.explode(both).alias("x")).select(key, "x.lang", "x.text").where("lang is not null and text is not null and trim(text) <> ''")


def aligned(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Lines of two texts by place; where either is blank or missing the pair goes. Input columns: on, text."""
    pairs = a.select(*on, F.trim("text").alias("a")).join(b.select(*on, F.trim("text").alias("b")), on)
    return pairs.where("a <> '' and b <> ''")
