"""All queries of the library over the driver's tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as tx
from glossmill.operators import bayes, decode, identify, metrics, views, words

from . import sqltext as sq

DATA_LANGS = ("en", "fr", "de", "es")

TEXTS = [
    (1, "L'école de l’hôpital, qu'il a vu: jusqu'ici!"), (2, "It's fine, we're at o'clock; don't."), (3, "Écrire à nom.prenom@exemple.org ou www.exemple.org/x?y=1 #sujet @ami"), (4, "à 10h30, le 12/05/2024: 3,5 km"),
    (5, "bɛ́ n'a fɔ k'a ta. Musa taara Segu. Ali bɛ Bamako"), (6, "aujourd'hui insha'allah porte-monnaie foo_bar ½ x²"), (7, ""), (8, "... !? —"), (9, "chapitre IV, VII et I; MIX, IIII, V"), (10, "😀 mɔgɔ ߓߊ߲ سلام"), (11, None), (12, "t' a"),
]
COMBINED = [(1, "École"), (2, "bé"), (3, "déjà"), (4, "L’ʼ`´‘X"), (5, "plain"), (6, "")]
LEXICON = [("la", "bam", 3.0), ("la", "fra", 2.0), ("the", "eng", 1.0), ("de", "fra", 1.0), ("de", "bam", 1.0), ("of", "eng", 2.0), ("and", "eng", 1.0), ("que", "fra", 1.0), ("bɛ", "bam", 1.0), ("in", "eng", 1.0), ("in", "bam", 1.0), ("in", "fra", 2.0), ("les", "fra", 1.0)]
ORIGINS = [("alimɛti", "fra", "allumette", "match", ""), ("kɔpu", "eng", "cup", "cup", ""), ("bɛ", "ara", "b", "x", ""), ("mɔtɔ", "fra", "moto", "", "")]
ORIGIN_TOKENS = [(1, "alimèti", "bam"), (2, "Alimɛti", "bam"), (3, "kɔpu", "fra"), (4, "mòtò", "bam"), (5, "dugu", "bam"), (6, "bɛ", "bam")]
SPANS = [(1, "n bɛ __très bien__ taa"), (2, "__un__ deux __trois"), (3, "[rire] a ye __la (bruit) maison__ ye IV"), (4, "n ye __bɛ__ fo"), (5, "   "), (6, "a taara."), (7, "")]
PAIRS = [(1, "i ni ce", "bonjour", "bm", "FR ", "web"), (2, "good", "ka nyi", "English", "bambara", "book"), (3, "x", "y", "zz", "fr", "web"), (4, "spam", "pourriel", "en", "fr", "Bible-NT"), (5, None, "oui", "bam", "fra", None)]
WIDE = [(1, "i ni ce", "bonjour", "hello"), (2, None, "oui", " "), (3, "awɔ", "", "yes")]
GOLD_KINDS = ["l'", "bɛ", "t'", "a", "foo_bar", "porte-monnaie", "10h", ".", "qu'", "x²", "aujourd'", "lorsque'"]
TOKEN_CONTRACT = {"labels": list(tx.LABELS), "sources": list(tx.SOURCES), "fields": ["text", "start", "end", "label", "confidence", "source"]}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


TEXTS_SQL = sq.values(TEXTS, ("id", "text"))
LEX_SQL = sq.values(LEXICON, ("form", "label", "weight"))


@query(f"SELECT lang, kind, count(*) AS n_tokens, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {sq.tokens('documents', 'doc_id', 'text', 'lang')} GROUP BY ALL")
def tokenize_counts(spark, sf_dir):
    counts = tx.token_counts(_read(spark, sf_dir, "documents"), "text", "lang")
    return counts.groupBy("lang", "kind").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.length("text")).alias("n_chars"))


_OFFSETS = 'SELECT {0} AS id, pos, text, "start", "end", kind FROM {1}'


@query(_OFFSETS.format("doc_id", sq.tokens("documents", "doc_id", "text")))
def token_offsets(spark, sf_dir):
    return tx.tokenize(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "id")


@query(f"SELECT id, pos, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"start\", CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS \"end\", {sq.kind('text')} AS kind FROM (SELECT id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS text FROM (SELECT conv_id * 1000 + turn AS id, string_split(text, ' ') AS a FROM conversations))")
def pretokenized_offsets(spark, sf_dir):
    given = _turns(spark, sf_dir).select("id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return tx.pretokenized(given, "id", "pos", "word")


@query(_OFFSETS.format("id", sq.tokens(TEXTS_SQL, "id", "text")))
def clitic_split(spark, sf_dir):
    return tx.tokenize(_rows(spark, TEXTS, "id long, text string"), "id", "text")


@query(f"SELECT w AS word, {sq.kind('w')} AS kind FROM {sq.values([(w,) for w in GOLD_KINDS], ('w',))} UNION SELECT w, {sq.kind('w')} FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> ''")
def kind_of_word(spark, sf_dir):
    given = _rows(spark, [(w,) for w in GOLD_KINDS], "word string")
    seen = _read(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return given.union(seen).distinct().select("word", tx.kind_of(F.col("word")).alias("kind"))


@query(f"SELECT text, {sq.normalize('nfc_normalize(text)')} AS norm, {sq.fold(sq.normalize('nfc_normalize(text)'))} AS folded FROM {sq.values(COMBINED, ('id', 'text'))} UNION SELECT DISTINCT text, {sq.normalize('nfc_normalize(text)')}, {sq.fold(sq.normalize('nfc_normalize(text)'))} FROM {sq.tokens('documents', 'doc_id', 'text')} WHERE kind = 'WORD'")
def normalize_words(spark, sf_dir):
    seen = tx.token_counts(_read(spark, sf_dir, "documents"), "text").where("kind = 'WORD'").select("text")
    both = _rows(spark, COMBINED, "id long, text string").select("text").union(seen).distinct()
    norm = both.select("text", tx.normalize(F.col("text"), True).alias("norm"))
    return norm.select("text", "norm", tx.fold(F.col("norm")).alias("folded"))


_WORDS_SQL = f"(SELECT DISTINCT text, kind FROM {sq.tokens('documents', 'doc_id', 'text')} UNION SELECT DISTINCT text, kind FROM {sq.tokens(TEXTS_SQL, 'id', 'text')})"


def _distinct_words(spark, sf_dir):
    seen = tx.token_counts(_read(spark, sf_dir, "documents"), "text").select("text", "kind")
    return seen.union(tx.token_kinds(_rows(spark, TEXTS, "id long, text string"), "text")).distinct()


@query(f"SELECT text, kind, {sq.hard('text', 'kind')} AS label FROM {_WORDS_SQL} WHERE {sq.hard('text', 'kind')} IS NOT NULL")
def hard_route(spark, sf_dir):
    rows = _distinct_words(spark, sf_dir)
    return rows.select("text", "kind", tx.route_hard(F.col("text"), F.col("kind"), tx.normalize(F.col("text")))["label"].alias("label")).where("label is not null")


@query(f"SELECT text, kind, rule[1] AS label, CAST(rule[2] AS DOUBLE) AS confidence FROM (SELECT text, kind, {sq.spelling('text', 'kind')} AS rule FROM {_WORDS_SQL} WHERE kind <> 'UNIV') WHERE rule IS NOT NULL")
def spelling_route(spark, sf_dir):
    rows = _distinct_words(spark, sf_dir).where("kind <> 'UNIV'")
    return rows.select("text", "kind", tx.route_spelling(F.col("kind"), tx.normalize(F.col("text"))).alias("r")).where("r is not null").select("text", "kind", "r.label", "r.confidence")


_TURNS = "(SELECT conv_id * 1000 + turn AS id, text FROM conversations)"


@query(f"SELECT id, pos, text, coalesce(last_value(CASE WHEN kind <> 'UNIV' THEN true WHEN text IN ({sq.strings(tx.SENTENCE_END)}) THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS mid FROM {sq.tokens(_TURNS, 'id', 'text')}")
def mid_sentence_flag(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return tx.mid_sentence(tx.tokenize(turns, "id", "text"), "id").select("id", "pos", "text", "mid")


def _lexicon(spark):
    return words.lexicon_table(_rows(spark, LEXICON, "form string, label string, weight double"))


@query(f"SELECT w.norm AS word, w.n, l.label, l.weight / sum(l.weight) OVER (PARTITION BY w.norm) AS weight FROM (SELECT {sq.normalize('text')} AS norm, count(*) AS n FROM {sq.tokens('documents', 'doc_id', 'text')} WHERE kind = 'WORD' GROUP BY 1) w JOIN {LEX_SQL} l ON l.form = w.norm")
def lexicon_join(spark, sf_dir):
    seen = tx.token_counts(_read(spark, sf_dir, "documents"), "text").where("kind = 'WORD'").groupBy(tx.normalize(F.col("text")).alias("norm")).agg(F.sum("n").alias("n"))
    return words.lookup(seen, _lexicon(spark)).where("weights is not null").select(F.col("norm").alias("word"), "n", F.explode("weights").alias("label", "weight"))


_COUNTS_SQL = f"(SELECT word, label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {sq.normalize('text')} AS word, lang AS label, {sq.hard('text', 'kind')} AS h, count(*) AS n FROM {sq.tokens('documents', 'doc_id', 'text', 'lang')} WHERE kind = 'WORD' GROUP BY ALL) WHERE h IS NULL OR h = label GROUP BY ALL)"
_PURITY_SQL = f"(SELECT word, arg_max(label, [n, -list_position({list(DATA_LANGS)}, label)]) AS label, CAST(sum(n) AS BIGINT) AS count, round(max(n) / sum(n), 3) AS purity, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS counts FROM {_COUNTS_SQL} GROUP BY word)"


def _purity(spark, sf_dir):
    return words.purity(words.word_counts(_read(spark, sf_dir, "documents"), "text", "lang"), DATA_LANGS)


@query(f"SELECT * FROM {_PURITY_SQL}")
def wordlist_purity(spark, sf_dir):
    return _purity(spark, sf_dir)


@query(f"SELECT word, label FROM {_PURITY_SQL} WHERE count >= 3 AND purity >= 0.9")
def wordlist_filter(spark, sf_dir):
    return words.pairs_from_list(_purity(spark, sf_dir), DATA_LANGS, 3, 0.9)


_PAIR_SQL = f"(SELECT DISTINCT word, CASE label WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE 'bam' END AS label FROM {_COUNTS_SQL})"


def _mapped(column):
    return F.when(column == "en", "eng").when(column == "fr", "fra").otherwise("bam")


def _pairs(spark, sf_dir):
    counts = words.word_counts(_read(spark, sf_dir, "documents"), "text", "lang")
    return counts.select("word", _mapped(F.col("label")).alias("label")).distinct()


@query(f"SELECT word, label FROM (SELECT word, labels, CASE WHEN len(labels) = 1 THEN labels[1] WHEN len(lex) = 1 AND list_contains(labels, lex[1]) THEN lex[1] END AS label FROM (SELECT word, list(DISTINCT label) AS labels FROM {_PAIR_SQL} GROUP BY word) LEFT JOIN (SELECT form, list(DISTINCT label) AS lex FROM {LEX_SQL} GROUP BY form) ON form = word) WHERE label IS NOT NULL")
def resolve_conflicts(spark, sf_dir):
    return words.resolve_conflicts(_pairs(spark, sf_dir), _lexicon(spark))


@query(f"WITH p AS (SELECT * FROM {_PAIR_SQL}), v AS (SELECT DISTINCT unnest({sq.variants('word')}) AS v, word FROM p WHERE label = 'bam') SELECT word, label FROM p UNION SELECT v, 'bam' FROM v WHERE v <> word AND v NOT IN (SELECT word FROM p)")
def augment_variants(spark, sf_dir):
    return words.augment(_pairs(spark, sf_dir))


_GRAM_SQL = f"(SELECT gram, label, count(*) AS n FROM (SELECT label, unnest({sq.grams('word')}) AS gram FROM {_PAIR_SQL}) WHERE gram NOT IN ('<', '>') GROUP BY ALL)"


@query(f"SELECT label, count(*) AS types FROM {_PAIR_SQL} GROUP BY label")
def type_counts(spark, sf_dir):
    return words.type_counts(_pairs(spark, sf_dir))


@query(f"SELECT * FROM {_GRAM_SQL}")
def ngram_counts(spark, sf_dir):
    return bayes.gram_counts(_pairs(spark, sf_dir))


_STATS_SQL = f"(SELECT label, total, log_prior, vocabulary FROM (SELECT label, CAST(sum(n) AS BIGINT) AS total FROM {_GRAM_SQL} GROUP BY label) JOIN (SELECT label, ln((count(*) + 1) / ((SELECT count(*) FROM {_PAIR_SQL}) + 3)) AS log_prior FROM {_PAIR_SQL} GROUP BY label) USING (label), (SELECT count(DISTINCT gram) AS vocabulary FROM {_GRAM_SQL}))"


@query(f"SELECT label, total, round(log_prior, 6) AS log_prior, vocabulary FROM {_STATS_SQL}")
def nb_stats(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return bayes.label_stats(pairs, bayes.gram_counts(pairs), tx.LANGUAGES).withColumn("log_prior", F.round("log_prior", 6))


_TARGETS = f"(SELECT DISTINCT text AS word FROM {sq.tokens('documents', 'doc_id', 'text')} WHERE kind = 'WORD')"


@query(f"""WITH g AS (SELECT * FROM {_GRAM_SQL}), s AS (SELECT * FROM {_STATS_SQL}), w AS (SELECT word, unnest({sq.grams(sq.normalize('word'))}) AS gram FROM {_TARGETS}),
k AS (SELECT word, s.label, any_value(s.log_prior) + sum(ln((coalesce(n, 0) + 0.1) / (s.total + 0.1 * (s.vocabulary + 1)))) / sqrt(count(*)) AS score FROM (SELECT * FROM w WHERE gram NOT IN ('<', '>')) x CROSS JOIN s LEFT JOIN g ON g.gram = x.gram AND g.label = s.label GROUP BY word, s.label)
SELECT word, label, round(exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY word), 5) AS p FROM (SELECT *, max(score) OVER (PARTITION BY word) AS m FROM k)""")
def nb_predict(spark, sf_dir):
    targets = tx.token_counts(_read(spark, sf_dir, "documents"), "text").where("kind = 'WORD'")
    found = bayes.predict(targets, "text", _model(spark, sf_dir))
    return found.select("word", F.posexplode("probs").alias("i", "p")).select("word", F.element_at(F.array(*(F.lit(x) for x in tx.LANGUAGES)), F.col("i") + 1).alias("label"), F.round("p", 5).alias("p"))


@query(f"SELECT gram, {', '.join(f'''CAST(coalesce(sum(n) FILTER (label = '{x}'), 0) AS BIGINT) AS {x}''' for x in tx.LANGUAGES)} FROM {_GRAM_SQL} GROUP BY gram")
def bundle_pivot(spark, sf_dir):
    return bayes.wide(bayes.gram_counts(_pairs(spark, sf_dir)), tx.LANGUAGES)


# A label a word, by lexicon or else by its length, so that SQL can follow; enough for the views below.
_LABELLED = f"(SELECT id, pos, text, \"start\", \"end\", CASE WHEN kind = 'UNIV' THEN 'univ' WHEN {sq.normalize('text')} IN ('the', 'of', 'and', 'in', 'that') THEN 'eng' WHEN length(text) % 5 = 0 THEN 'fra' ELSE 'bam' END AS label FROM {sq.tokens(_TURNS, 'id', 'text')})"


def _turns(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _labelled(spark, sf_dir):
    rows = tx.tokenize(_turns(spark, sf_dir), "id", "text")
    known = tx.normalize(F.col("text")).isin("the", "of", "and", "in", "that")
    return rows.withColumn("label", F.when(F.col("kind") == "UNIV", "univ").when(known, "eng").when(F.length("text") % 5 == 0, "fra").otherwise("bam"))




def _runs_sql(labelled: str) -> str:
    return f"(SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY id ORDER BY pos) = label THEN 0 ELSE 1 END AS fresh FROM {labelled} WHERE label <> 'univ'))"


_RUNS = _runs_sql(_LABELLED)


@query(f'SELECT id, CAST(run AS BIGINT) AS run, label, min("start") AS "start", max("end") AS "end", count(*) AS n_words FROM {_RUNS} GROUP BY id, run, label')
def segments(spark, sf_dir):
    return views.segments(_labelled(spark, sf_dir), "id")


def _summary_sql(labelled: str) -> str:
    return f"(SELECT d.id, coalesce(n_words, 0) AS n_words, coalesce(n_switches, 0) AS n_switches, dominant, coalesce(n_langs > 1, false) AS code_switched, bam, fra, eng FROM {_TURNS} d LEFT JOIN (SELECT id, sum(n) AS n_words, arg_max(label, [n, CASE label WHEN 'bam' THEN 9 WHEN 'fra' THEN 2 ELSE 1 END]) AS dominant, count(*) AS n_langs, max(n) FILTER (label = 'bam') AS bam, max(n) FILTER (label = 'fra') AS fra, max(n) FILTER (label = 'eng') AS eng FROM (SELECT id, label, count(*) AS n FROM {labelled} WHERE label <> 'univ' GROUP BY ALL) GROUP BY id) USING (id) LEFT JOIN (SELECT id, max(run) - 1 AS n_switches FROM {_runs_sql(labelled)} GROUP BY id) USING (id))"


_SUMMARY = _summary_sql(_LABELLED)


@query(f"SELECT id, CAST(n_words AS BIGINT) AS n_words, CAST(n_switches AS BIGINT) AS n_switches, dominant, code_switched, round(bam / n_words, 6) AS bam, round(fra / n_words, 6) AS fra, round(eng / n_words, 6) AS eng FROM {_SUMMARY}")
def summary(spark, sf_dir):
    rows = views.summarize(_turns(spark, sf_dir), _labelled(spark, sf_dir), "id")
    return rows.select("id", "n_words", "n_switches", "dominant", "code_switched", *(F.round(F.element_at("proportions", F.lit(x)), 6).alias(x) for x in tx.LANGUAGES))


@query(f"SELECT id, dominant FROM {_SUMMARY}")
def detect(spark, sf_dir):
    return views.summarize(_turns(spark, sf_dir), _labelled(spark, sf_dir), "id").select("id", "dominant")


@query(f"SELECT id, code_switched FROM {_SUMMARY}")
def code_switched(spark, sf_dir):
    return views.summarize(_turns(spark, sf_dir), _labelled(spark, sf_dir), "id").select("id", "code_switched")


_PRED = "(SELECT lang AS gold, CASE WHEN text LIKE '% the %' THEN 'en' WHEN text LIKE '% la %' THEN 'fr' WHEN text LIKE '% der %' THEN 'de' ELSE 'es' END AS pred FROM documents)"


def _predicted(spark, sf_dir):
    has = lambda w: F.contains("text", F.lit(f" {w} "))
    return _read(spark, sf_dir, "documents").select(F.col("lang").alias("gold"), F.when(has("the"), "en").when(has("la"), "fr").when(has("der"), "de").otherwise("es").alias("pred"))


@query(f"SELECT gold, pred, count(*) AS n FROM {_PRED} GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir))


@query(f"""WITH c AS (SELECT gold, pred, count(*) AS n FROM {_PRED} GROUP BY ALL), l AS (SELECT gold AS label FROM c UNION SELECT pred FROM c),
s AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE gold = label AND pred = label), 0) AS tp, coalesce((SELECT sum(n) FROM c WHERE pred = label), 0) AS said, coalesce((SELECT sum(n) FROM c WHERE gold = label), 0) AS support FROM l),
r AS (SELECT label, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r, support FROM s)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM r""")
def prf(spark, sf_dir):
    return metrics.scores(metrics.confusion(_predicted(spark, sf_dir))).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"SELECT 'fr' AS suite, count(*) AS words, round(avg(CAST(gold = pred AS INT)), 6) AS acc, round(sum(CAST(gold = 'fr' AND pred = 'fr' AS INT)) / greatest(1, sum(CAST(pred = 'fr' AS INT))), 6) AS p, round(sum(CAST(gold = 'fr' AND pred = 'fr' AS INT)) / greatest(1, sum(CAST(gold = 'fr' AS INT))), 6) AS r FROM {_PRED}")
def benchmark_suite(spark, sf_dir):
    return metrics.suite(_predicted(spark, sf_dir), "fr", "fr").select("suite", "words", *(F.round(c, 6).alias(c) for c in ("acc", "p", "r")))


@query(sq.values([(1, 0, "n", "bam"), (1, 1, "bɛ", "bam"), (1, 2, "très", "fra"), (1, 3, "bien", "fra"), (1, 4, "taa", "bam"), (3, 0, "a", "bam"), (3, 1, "ye", "bam"), (3, 2, "la", "fra"), (3, 3, "maison", "fra"), (3, 4, "ye", "bam"), (3, 5, "IV", "univ"), (6, 0, "a", "bam"), (6, 1, "taara", "bam"), (6, 2, ".", "univ")], ("id", "pos", "token", "label"), select=True))
def marked_spans(spark, sf_dir):
    return words.marked_spans(_rows(spark, SPANS, "id long, text string"), "id", "text")


@query("SELECT u.conv_id, u.turn, trim(u.text) AS a, trim(v.text) AS b FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant' AND trim(u.text) <> '' AND trim(v.text) <> ''")
def aligned_pairs(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    left = c.where("role = 'user'").select("conv_id", "turn", "text")
    right = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return words.aligned(left, right, ["conv_id", "turn"])


@query(sq.splice("(SELECT u.conv_id * 1000 + u.turn AS id, u.text AS host, v.text AS guest FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1)"))
def splice_gold(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    guests = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("guest"))
    pairs = c.join(guests, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("host"), "guest")
    return words.splice(pairs, "id", "host", "guest")


_ORIGIN_SQL = f"(SELECT {sq.normalize('form')} AS form, origin_lang, source_form FROM {sq.values(ORIGINS, ('form', 'origin_lang', 'source_form', 'gloss', 'notes'))})"


@query(f"SELECT id, text, label, coalesce(a.origin_lang, b.origin_lang) AS origin_lang, coalesce(a.source_form, b.source_form) AS source_form FROM {sq.values(ORIGIN_TOKENS, ('id', 'text', 'label'))} t LEFT JOIN {_ORIGIN_SQL} a ON t.label = 'bam' AND a.form = {sq.normalize('t.text')} LEFT JOIN {_ORIGIN_SQL} b ON t.label = 'bam' AND b.form = {sq.fold(sq.normalize('t.text'))}")
def origin_annotate(spark, sf_dir):
    origins = _rows(spark, ORIGINS, "form string, origin_lang string, source_form string, gloss string, notes string")
    return words.annotate_origins(_rows(spark, ORIGIN_TOKENS, "id long, text string, label string"), origins).select("id", "text", "label", "origin_lang", "source_form")


@query(f"SELECT form, source_form FROM {sq.values(ORIGINS, ('form', 'origin_lang', 'source_form', 'gloss', 'notes'))} WHERE origin_lang = 'fra'")
def by_origin(spark, sf_dir):
    return words.by_origin(_rows(spark, ORIGINS, "form string, origin_lang string, source_form string, gloss string, notes string"), "fra").select("form", "source_form")


@query(f"SELECT substr(sha256('{json.dumps(TOKEN_CONTRACT, sort_keys=True, ensure_ascii=False)}'), 1, 16) AS fingerprint")
def fingerprint(spark, sf_dir):
    return _rows(spark, [(views.fingerprint(TOKEN_CONTRACT),)], "fingerprint string")


@query(f"SELECT id, lang, text FROM (SELECT id, unnest([{{'lang': 'bam', 'text': bm}}, {{'lang': 'fra', 'text': fr}}, {{'lang': 'eng', 'text': en}}], recursive := true) FROM {sq.values(WIDE, ('id', 'bm', 'fr', 'en'))}) WHERE text IS NOT NULL AND trim(text) <> ''")
def unpivot_languages(spark, sf_dir):
    return words.unpivot_languages(_rows(spark, WIDE, "id long, bm string, fr string, en string"), "id", {"bm": "bam", "fr": "fra", "en": "eng"})


_CANON = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.ALIASES.items()) + " END"


@query(f"SELECT id, lang, text FROM (SELECT id, {_CANON.format('lower(trim(src_lang))')} AS lang, src AS text, provenance FROM {sq.values(PAIRS, ('id', 'src', 'tgt', 'src_lang', 'tgt_lang', 'provenance'))} UNION ALL SELECT id, {_CANON.format('lower(trim(tgt_lang))')}, tgt, provenance FROM {sq.values(PAIRS, ('id', 'src', 'tgt', 'src_lang', 'tgt_lang', 'provenance'))}) WHERE lang IS NOT NULL AND text IS NOT NULL AND coalesce(provenance, '') NOT ILIKE '%bible%'")
def unpivot_pairs(spark, sf_dir):
    return words.unpivot_pairs(_rows(spark, PAIRS, "id long, src string, tgt string, src_lang string, tgt_lang string, provenance string"), "id", ("bible",))


@query(f"SELECT label, word, n FROM {_COUNTS_SQL} QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, word) <= 20")
def top_words(spark, sf_dir):
    from pyspark.sql import Window

    counts = words.word_counts(_read(spark, sf_dir, "documents"), "text", "lang")
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))).where("r <= 20").select("label", "word", "n")


@query(f"SELECT lang, count(*) AS n_docs, CAST(sum(w) AS BIGINT) AS n_words, max(w) AS longest FROM (SELECT doc_id, lang, count(*) AS w FROM {sq.tokens('documents', 'doc_id', 'text', 'lang')} WHERE kind = 'WORD' GROUP BY ALL) GROUP BY lang")
def doc_language_summary(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", tx.word_number("text").alias("w")).where("w > 0")
    per_doc = docs.groupBy("doc_id", "lang").agg(F.sum("w").alias("w"))
    return per_doc.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("w").alias("n_words"), F.max("w").alias("longest"))


# A chain of one label by lexicon or spelling; SQL walks it forward and backward with recursive queries.
@query(sq.posteriors(f"(SELECT id, pos, label FROM {_LABELLED} WHERE label <> 'univ')"))
def decode_posteriors(spark, sf_dir):
    chain = _labelled(spark, sf_dir).where("label <> 'univ'")
    chain = chain.withColumn("e", identify.one_hot(F.col("label"), F.lit(0.6), tx.LANGUAGES))
    docs = chain.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("x"))
    post = docs.select("id", "x", decode.decoder()(F.transform("x", lambda i: i["e"])).alias("p")).select("id", F.explode(F.arrays_zip(F.col("x"), F.col("p"))).alias("z"))
    return post.select("id", "z.x.pos", *(F.round(F.col("z.p")[i], 4).alias(x) for i, x in enumerate(tx.LANGUAGES)))


_MODELS: dict[tuple[str, str], bayes.Model] = {}


def _model(spark, sf_dir):
    """The classifier of the tables' words, fitted once a session; its tables lie in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = bayes.fit(_pairs(spark, sf_dir))
    return _MODELS[key]


def _identifier(spark, sf_dir):
    return identify.Identifier(_lexicon(spark), _model(spark, sf_dir))


def _identified_sql(texts: str) -> str:
    return f"({sq.identify(texts, LEX_SQL, _GRAM_SQL, _STATS_SQL)})"


_FOUND = _identified_sql(_TURNS)


@query(f"SELECT * FROM {_FOUND}")
def identify_tokens(spark, sf_dir):
    return _identifier(spark, sf_dir).identify(_turns(spark, sf_dir), "id", "text")


@query()
def identify_documents(spark, sf_dir):
    """Tokens of whole documents by label and source; SQL would walk chains of thousands of words."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return _identifier(spark, sf_dir).tally(docs, "doc_id", "text")


@query(f"WITH found AS MATERIALIZED {_FOUND} SELECT id, CAST(n_words AS BIGINT) AS n_words, CAST(n_switches AS BIGINT) AS n_switches, dominant, code_switched, round(bam / n_words, 6) AS bam, round(fra / n_words, 6) AS fra, round(eng / n_words, 6) AS eng FROM {_summary_sql('found')}")
def identify_summary(spark, sf_dir):
    docs = _turns(spark, sf_dir)
    rows = views.summarize(docs, _identifier(spark, sf_dir).identify(docs, "id", "text"), "id")
    return rows.select("id", "n_words", "n_switches", "dominant", "code_switched", *(F.round(F.element_at("proportions", F.lit(x)), 6).alias(x) for x in tx.LANGUAGES))


_SHARES = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(tx.LANGUAGES))


@query(f"""WITH found AS MATERIALIZED {_FOUND}, seg AS (SELECT id, run, label, min("start") AS a, max("end") AS z FROM {_runs_sql('found')} GROUP BY id, run, label),
lines AS (SELECT id, string_agg('[' || label || '] ' || substr(text, a + 1, z - a), chr(10) ORDER BY run) AS lines FROM seg JOIN {_TURNS} d USING (id) GROUP BY id),
share AS (SELECT id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS total FROM found WHERE label <> 'univ' GROUP BY id, label),
shares AS (SELECT id, string_agg(label || ' ' || CAST(round(100.0::DOUBLE * (n / total)) AS INT) || '%', ', ' ORDER BY n DESC, CASE label {_SHARES} END) AS shares FROM share GROUP BY id)
SELECT id, CASE WHEN n_words = 0 THEN '(no words)' ELSE lines || chr(10) || shares || chr(10) || CASE WHEN code_switched THEN 'code-switched, ' || CAST(n_switches AS BIGINT) || ' switch(es)' ELSE 'single language' END END AS overview FROM {_summary_sql('found')} LEFT JOIN lines USING (id) LEFT JOIN shares USING (id)""")
def overview(spark, sf_dir):
    docs = _turns(spark, sf_dir)
    return views.overview(docs, _identifier(spark, sf_dir).identify(docs, "id", "text"), "id", "text")


@query(f"SELECT * FROM {_FOUND} WHERE label <> 'univ' AND confidence < 0.7")
def low_confidence(spark, sf_dir):
    return views.low_confidence(_identifier(spark, sf_dir).identify(_turns(spark, sf_dir), "id", "text"))


_TOKEN_JSON = """'{"text":' || CAST(to_json(text) AS VARCHAR) || ',"start":' || "start" || ',"end":' || "end" || ',"label":"' || label || '","confidence":' || CAST(confidence AS VARCHAR) || ',"source":"' || source || '"}'"""


@query(f"SELECT id, coalesce(value, '[]') AS value FROM {_TURNS} LEFT JOIN (SELECT id, '[' || string_agg({_TOKEN_JSON}, ',' ORDER BY pos) || ']' AS value FROM {_FOUND} GROUP BY id) USING (id)")
def token_json_lines(spark, sf_dir):
    docs = _turns(spark, sf_dir)
    return views.token_lines(_identifier(spark, sf_dir).identify(docs, "id", "text"), "id", docs)


@query(f"SELECT id, count(label) AS n_univ FROM {_TURNS} LEFT JOIN (SELECT id, label FROM {_FOUND} WHERE label = 'univ') USING (id) GROUP BY id")
def univ_counts(spark, sf_dir):
    docs = _turns(spark, sf_dir)
    return views.univ_counts(docs, _identifier(spark, sf_dir).identify(docs, "id", "text"), "id")


@query(sq.informal(_TURNS))
def informal_spelling(spark, sf_dir):
    return words.informalize(_turns(spark, sf_dir), "id", "text")


_ALIGNED = "(SELECT u.conv_id * 1000 + u.turn AS id, trim(u.text) AS host, trim(v.text) AS guest FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant' AND trim(u.text) <> '' AND trim(v.text) <> '')"


def _suite_sql(name: str, found: str, gold: str) -> str:
    rows = f"(SELECT label AS pred, {gold} AS gold FROM {found} WHERE label <> 'univ')"
    hit, said, meant = "count(*) FILTER (gold = 'fra' AND pred = 'fra')", "count(*) FILTER (pred = 'fra')", "count(*) FILTER (gold = 'fra')"
    p, r = f"(CASE WHEN {said} > 0 THEN {hit} / {said} ELSE 0.0 END)::DOUBLE", f"(CASE WHEN {meant} > 0 THEN {hit} / {meant} ELSE 0.0 END)::DOUBLE"
    return f"SELECT suite, words, round(acc, 6) AS acc, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT '{name}' AS suite, count(*) AS words, count(*) FILTER (pred = gold) / count(*) AS acc, {p} AS p, {r} AS r FROM {rows})"


_SUITES = " UNION ALL ".join([
    _suite_sql("bam", _identified_sql(f"(SELECT id, host AS text FROM {_ALIGNED})"), "'bam'"), _suite_sql("fra", _identified_sql(f"(SELECT id, guest AS text FROM {_ALIGNED})"), "'fra'"),
    _suite_sql("bam-inf", _identified_sql(f"({sq.informal(f'(SELECT id, host AS text FROM {_ALIGNED})')})"), "'bam'"),
    _suite_sql("cs-synth", f"(SELECT label, \"start\", lo, hi FROM {_identified_sql(f'(SELECT id, text FROM ({sq.splice(_ALIGNED)}))')} t JOIN ({sq.splice(_ALIGNED)}) s USING (id))", "CASE WHEN \"start\" >= lo AND \"start\" < hi THEN 'fra' ELSE 'bam' END"),
])


def _suites(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    right = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    pairs = words.aligned(c.where("role = 'user'").select("conv_id", "turn", "text"), right, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("a").alias("host"), F.col("b").alias("guest"))
    identifier = _identifier(spark, sf_dir)
    return metrics.suites(lambda texts: identifier.identify(texts, "id", "text"), pairs, "id", "host", "guest")


@query(_SUITES)
def benchmark_suites(spark, sf_dir):
    return _suites(spark, sf_dir).select("suite", "words", *(F.round(c, 6).alias(c) for c in ("acc", "p", "r", "f1")))


@query(f"SELECT round(avg(acc), 5) AS macro_acc FROM ({_SUITES})")
def benchmark_macro(spark, sf_dir):
    return metrics.macro(_suites(spark, sf_dir)).select(F.round("macro_acc", 5).alias("macro_acc"))


_SPAN_ROWS = sq.values([(i, t) for i, t in SPANS], ("id", "text"))


@query(f"WITH kept AS ({_SQL['marked_spans']}), stats AS (SELECT (SELECT count(*) FROM {_SPAN_ROWS}) AS r, count(DISTINCT id) AS s, count(DISTINCT CASE WHEN label = 'fra' THEN id END) AS w FROM kept) SELECT 'rows' AS stat, r AS n FROM stats UNION ALL SELECT 'dropped', r - s FROM stats UNION ALL SELECT 'skipped', 0 FROM stats UNION ALL SELECT 'sentences', s FROM stats UNION ALL SELECT 'switched', w FROM stats UNION ALL SELECT 'label_' || x, (SELECT count(*) FROM kept WHERE label = x) FROM (SELECT unnest({list(tx.LABELS)}) AS x)")
def span_statistics(spark, sf_dir):
    lines = _rows(spark, SPANS, "id long, text string")
    return words.span_statistics(lines, "id", words.marked_spans(lines, "id", "text"))


@query(f"SELECT form FROM {_ORIGIN_SQL} WHERE form NOT IN (SELECT form FROM {LEX_SQL} GROUP BY form HAVING count(*) = 1 AND min(label) = 'bam')")
def misplaced_origins(spark, sf_dir):
    origins = _rows(spark, ORIGINS, "form string, origin_lang string, source_form string, gloss string, notes string")
    return words.misplaced_origins(origins, _lexicon(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
