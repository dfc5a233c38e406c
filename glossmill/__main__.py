"""Jobs: ``spark-submit glossmill/__main__.py JOB ...`` or ``python -m glossmill JOB ...``."""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as tx
from glossmill.operators import bayes, metrics, views, words
from glossmill.operators.identify import Config, Identifier
from glossmill.sources import readers


def _lexicon(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        return words.lexicon_table(spark.createDataFrame([], "form string, label string, weight double"))
    return words.lexicon_table(readers.parse_lexicon(spark.read.text(path), "value"))


def _model(spark: SparkSession, path: str) -> bayes.Model:
    """A model file of JSON, or a folder (without suffix) of Parquet tables."""
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix not in ("", ".json"):
        raise SystemExit(f"{path}: models are .json files or folders, not {suffix}")
    return bayes.load_json(spark, path) if path.endswith(".json") else bayes.load(spark, path)


def _labelled_paths(given: list[str]) -> list[tuple[str, str]]:
    out = []
    for item in given:
        name, _, path = item.partition("=")
        label = words.ALIASES.get(name.strip().lower())
        if not label or not path:
            raise SystemExit(f"expected LANGUAGE=PATH with a known language: {item}")
        out.append((label, path))
    return out


def _give(rows: DataFrame, column: str, output: str | None) -> None:
    """Write the lines to a folder, or print them in order of id."""
    if output:
        rows.select(column).write.text(output)
    else:
        for r in rows.orderBy("id").toLocalIterator():
            print(r[column])


def identify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every argument together is one text; or every line of ``--input``, or else of standard input, is one."""
    if a.input:
        docs = spark.read.text(a.input).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    elif a.text:
        docs = spark.createDataFrame([(0, " ".join(a.text))], "id long, text string")
    else:
        docs = spark.createDataFrame([(i, line.rstrip("\n")) for i, line in enumerate(sys.stdin)], "id long, text string")
    tokens = Identifier(_lexicon(spark, a.lexicon), _model(spark, a.model)).identify(docs, "id", "text")
    origins = words.annotate_origins(tokens, readers.read_origins(spark, a.origins)) if a.origins else None
    if a.json:
        fields = ["text", "start", "end", "label", "confidence", "source"] + (["origin_lang", "source_form"] if a.origins else [])
        item = F.struct("pos", F.struct(*fields).alias("t"))
        lines = (tokens if origins is None else origins).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("x"))
        rows = docs.select("id").join(lines, "id", "left").select("id", F.coalesce(F.to_json("x"), F.lit("[]")).alias("value"))
        _give(rows, "value", a.output)
    elif a.words:
        rows = tokens if origins is None else origins
        line = F.format_string("%-20s %-5s %.4f %s", "text", "label", "confidence", "source")
        line = line if origins is None else F.concat_ws(" ", line, "origin_lang", "source_form")
        lines = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("v")))), lambda x: x["v"]), "\n").alias("value"))
        _give(lines, "value", a.output)
    else:
        _give(views.overview(docs, tokens, "id", "text"), "overview", a.output)


def wordlist(spark: SparkSession, a: argparse.Namespace) -> None:
    """Word counts of plain texts and frequency lists as a word list with purities."""
    parts = [words.word_counts(readers.read_sentences(spark, p, x, a.limit), "text", "label") for x, p in _labelled_paths(a.text)]
    parts += [words.frequency_counts(readers.parse_frequency(spark.read.text(p), "value", x), "word", "label", "n") for x, p in _labelled_paths(a.freq)]
    if a.table:
        table = spark.read.json(a.table) if a.table.endswith((".jsonl", ".json")) else spark.read.parquet(a.table)
        table = table.withColumn("_id", F.monotonically_increasing_id())
        columns = {c: x for x, c in _labelled_paths(a.col)}
        if readers.language_columns(table, columns, (a.src_col, a.tgt_col)) == "columns":
            texts = words.unpivot_languages(table, "_id", {c: x for c, x in columns.items() if c in table.columns})
        else:
            named = {"src": a.src_col, "tgt": a.tgt_col, "src_lang": a.src_lang_col, "tgt_lang": a.tgt_lang_col, "provenance": a.provenance_col}
            texts = words.unpivot_pairs(table.select("_id", *((F.col(c) if c in table.columns else F.lit(None).cast("string")).alias(k) for k, c in named.items())), "_id", tuple(a.exclude))
        parts.append(words.word_counts(texts, "text", "lang"))
    if not parts:
        raise SystemExit("give --text, --freq or --table")
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    readers.write_word_list(words.purity(counts.groupBy("word", "label").agg(F.sum("n").alias("n")), tx.LANGUAGES), a.output)


def spans(spark: SparkSession, a: argparse.Namespace) -> None:
    """Transcripts with marked spans as a CoNLL file."""
    lines = readers.numbered_lines(spark, a.input).select(F.concat_ws(":", "file", F.format_string("%010d", "line_no")).alias("id"), "line")
    rows = words.marked_spans(lines, "id", "line")
    for r in words.span_statistics(lines, "id", rows, only_switched=a.only_switched).collect():
        print(f"{r.stat}\t{r.n}")
    if a.only_switched:
        rows = rows.join(rows.where("label = 'fra'").select("id").distinct(), "id", "left_semi")
    readers.write_conll(rows, "id", a.output, "token, tab, label; a blank line ends a sentence")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """A classifier from CoNLL files, word lists and the lexicon's words with one label."""
    lexicon = _lexicon(spark, a.lexicon)
    pairs = words.single_label_items(lexicon)
    for path in a.conll:
        gold = readers.parse_conll(readers.numbered_lines(spark, path), tx.LABELS)
        pairs = pairs.union(gold.where(F.col("label") != "univ").select(tx.normalize(F.col("token")), "label"))
    for path in a.word_list:
        pairs = pairs.union(words.pairs_from_list(readers.read_word_list(spark, path), tx.LANGUAGES, a.min_count, a.min_purity))
    pairs = words.resolve_conflicts(pairs.distinct(), lexicon, a.keep_ambiguous)
    model = bayes.fit(words.augment(pairs) if a.augment else pairs, alpha=a.alpha, prune=a.prune)
    bayes.save_json(model, a.output) if a.json else bayes.save(model, a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Precision, recall and F1 of each label on a CoNLL file, and the accuracy."""
    gold = readers.parse_conll(readers.numbered_lines(spark, a.gold), tx.LABELS).withColumn("id", F.concat_ws(":", "file", "sent_id"))
    config = Config(stay=a.stay)
    found = Identifier(_lexicon(spark, a.lexicon), _model(spark, a.model), config).identify_pretokenized(gold, "id", "pos", "token")
    table = metrics.confusion(gold.select("id", "pos", F.col("label").alias("gold")).join(found.select("id", "pos", F.col("label").alias("pred")), ["id", "pos"])).cache()
    metrics.scores(table).orderBy("label").show(truncate=False)
    metrics.accuracy(table).show(truncate=False)


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    """Accuracy on aligned lines of two languages, informal spelling and spliced texts, and the mean of the four."""
    side = lambda path: readers.numbered_lines(spark, path).select("line_no", F.col("line").alias("text"))
    pairs = words.aligned(side(a.host), side(a.guest), ["line_no"]).select(F.col("line_no").cast("long").alias("id"), F.col("a").alias("host"), F.col("b").alias("guest"))
    if a.limit:
        pairs = pairs.orderBy("id").limit(a.limit)
    identifier = Identifier(_lexicon(spark, a.lexicon), _model(spark, a.model))
    table = metrics.suites(lambda texts: identifier.identify(texts, "id", "text"), pairs, "id", "host", "guest").cache()
    table.show(truncate=False)
    metrics.macro(table).show(truncate=False)


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Word list, model and JSON export in one folder; steps whose results are there already are left out."""
    at = lambda name: f"{a.output}/{name}"
    fs = lambda path: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    done = lambda name: fs(at(name)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs(f"{at(name)}/_SUCCESS"))
    p = parser()
    more = [x for option, values in (("--text", a.text), ("--freq", a.freq)) for v in values for x in (option, v)]
    steps = [("words", ["wordlist", *more, "--output", at("words")]), ("model/stats", ["train", "--word-list", at("words"), "--min-count", "3", "--min-purity", "0.9", "--augment", "--output", at("model"), *(("--lexicon", a.lexicon) if a.lexicon else ())]), ("model.json", ["export", "--model", at("model"), "--prune", str(a.prune), "--output", at("model.json")])]
    for name, argv in steps:
        if not done(name):
            step = p.parse_args(argv)
            step.run(spark, step)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    """A model as JSON, without rare grams."""
    model = _model(spark, a.model)
    bayes.save_json(bayes.prune(model, a.prune) if a.prune > 1 else model, a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossmill", description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)

    def job(run, *options: tuple[str, dict]) -> None:
        j = jobs.add_parser(run.__name__, help=run.__doc__)
        j.set_defaults(run=run)
        for name, how in options:
            j.add_argument(name, **how)

    must, may, flag, many = {"required": True}, {}, {"action": "store_true"}, {"action": "append", "default": []}
    job(identify, ("text", {"nargs": "*"}), ("--input", may), ("--model", must), ("--lexicon", may), ("--origins", may), ("--words", flag), ("--json", flag), ("--output", may))
    job(wordlist, ("--text", many), ("--freq", many), ("--limit", {"type": int}), ("--table", may), ("--col", many), ("--src-col", {"default": "src"}), ("--tgt-col", {"default": "tgt"}), ("--src-lang-col", {"default": "src_lang"}), ("--tgt-lang-col", {"default": "tgt_lang"}), ("--provenance-col", {"default": "provenance"}), ("--exclude", many), ("--output", must))
    job(spans, ("--input", must), ("--only-switched", flag), ("--output", must))
    job(
        train, ("--conll", many), ("--word-list", many), ("--lexicon", may), ("--min-count", {"type": int, "default": 1}), ("--min-purity", {"type": float, "default": 0.0}),
        ("--keep-ambiguous", flag), ("--augment", flag), ("--alpha", {"type": float, "default": 0.1}), ("--prune", {"type": int, "default": 1}), ("--json", flag), ("--output", must),
    )
    job(evaluate, ("--gold", must), ("--model", must), ("--lexicon", may), ("--stay", {"type": float, "default": 0.8}))
    job(benchmark, ("--host", must), ("--guest", must), ("--model", must), ("--lexicon", may), ("--limit", {"type": int}))
    job(build, ("--text", many), ("--freq", many), ("--lexicon", may), ("--prune", {"type": int, "default": 1}), ("--output", must))
    job(export, ("--model", must), ("--prune", {"type": int, "default": 1}), ("--output", must))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName(f"glossmill-{a.job}").getOrCreate(), a)


if __name__ == "__main__":
    main()
