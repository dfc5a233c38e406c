"""Readers and writers of the text formats that feed and leave the engine."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: lines of whole files, split at every line break that Unicode knows; numbers from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"(\r\n|[\r\n\x0B\x0C\x1C-\x1E\u0085  ])\z", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", r"\r\n|[\r\n\x0B\x0C\x1C-\x1E\u0085  ]")).alias("line_no", "line"))


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Objects of a JSON-lines file. ``limit`` counts lines, blank ones too, in file order."""
    if limit is None:
        return spark.read.schema(schema).json(path)
    lines = numbered_lines(spark, path).where((F.col("line_no") < limit) & (F.trim("line") != ""))
    return lines.select(F.from_json("line", schema).alias("x")).select("x.*")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, config: str | None = None, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Parquet laid out as config=/split=; split ``all`` or none reads all, ``limit`` takes the first rows by file and place, over all files together."""
    rows = spark.read.parquet(path)
    if config is not None:
        rows = rows.where(F.col("config") == config)
    if split not in (None, "all"):
        rows = rows.where(F.col("split") == split)
    columns = columns or rows.columns
    if limit is not None:
        place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r")]
        return rows.select(*columns, *place).orderBy("_f", "_r").limit(limit).select(*columns)
    return rows.select(*columns)


def read_sentences(spark: SparkSession, path: str, label: str, limit: int | None = None) -> DataFrame:
    """``text, label``: one sentence a line."""
    if limit is None:
        return spark.read.text(path).select(F.col("value").alias("text"), F.lit(label).alias("label"))
    return numbered_lines(spark, path).where(F.col("line_no") < limit).select(F.col("line").alias("text"), F.lit(label).alias("label"))


def parse_frequency(lines: DataFrame, line: str, label: str) -> DataFrame:
    """``word, label, n`` of lines that are a word and a number; others are passed over."""
    parts = F.split(F.trim(line), r"\s+")
    return lines.where((F.size(parts) == 2) & parts[1].rlike("^[0-9]+$")).select(parts[0].alias("word"), F.lit(label).alias("label"), parts[1].cast("long").alias("n"))


def parse_conll(lines: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``file, sent_id, pos, token, label`` from lines (file, line_no, line).

    Blank lines end sentences. A line is a comment if it begins with # and has no tab, so that hashtags that
    were written as tokens are read as tokens. A line that isn't a token and a known label raises an error.
    """
    by_place = Window.partitionBy("file").orderBy("line_no")
    comment = F.col("line").startswith("#") & ~F.contains("line", F.lit("\t"))
    rows = lines.where(~comment).withColumn("blank", F.trim("line") == "").withColumn("sent_id", F.sum(F.col("blank").cast("int")).over(by_place)).where("not blank")
    parts = F.split("line", "\t")
    good = (F.size(parts) == 2) & parts[1].isin(*labels)
    said = F.concat(F.col("file"), F.lit(":"), F.col("line_no") + 1, F.lit(": not a token and a label"))
    token = F.when(good, parts[0]).otherwise(F.raise_error(said).cast("string"))
    pos = F.row_number().over(Window.partitionBy("file", "sent_id").orderBy("line_no")) - 1
    return rows.select("file", "sent_id", pos.alias("pos"), token.alias("token"), parts[1].alias("label"))


def write_conll(rows: DataFrame, key: str, path: str, header: str) -> None:
    """Sentences of rows (key, pos, token, label) in order of key, a blank line behind each, below the header; Spark's _SUCCESS marks completion."""
    body = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token", "label"))), lambda x: F.concat(x["token"], F.lit("\t"), x["label"])), "\n").alias("value"))
    top = rows.sparkSession.createDataFrame([(f"# {header}",)], "value string").select("value", F.lit(0).alias("o"), F.lit(None).cast(rows.schema[key].dataType).alias("k"))
    lines = top.union(body.select(F.concat("value", F.lit("\n")), F.lit(1), key))
    lines.orderBy("o", "k").select("value").write.text(path)


def parse_lexicon(lines: DataFrame, line: str) -> DataFrame:
    """``form, label, weight`` from lines ``form<TAB>label[:weight],...``; # begins a comment."""
    text = F.rtrim(F.regexp_replace(line, "#.*$", ""))
    parts = F.split(text, "\t")
    rows = lines.select(text.alias("t"), parts.alias("p")).where(F.trim("t") != "")
    spec = F.when(F.size("p") >= 2, F.col("p")[1]).otherwise(F.raise_error(F.concat(F.lit("expected a form and labels: "), F.col("t"))).cast("string"))
    items = rows.select(F.trim(F.col("p")[0]).alias("form"), F.explode(F.split(F.trim(spec), ",")).alias("item"))
    pair = F.split(F.trim("item"), ":")
    return items.select("form", pair[0].alias("label"), F.when(F.size(pair) > 1, pair[1].cast("double")).otherwise(1.0).alias("weight"))


def read_origins(spark: SparkSession, path: str) -> DataFrame:
    """The origin table, a TSV with this header; # lines are comments."""
    columns = ["form", "origin_lang", "source_form", "gloss", "notes"]
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", quote="")
    if rows.columns != columns:
        raise ValueError(f"{path}: columns {rows.columns}, not {columns}")
    return rows.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns))


def write_word_list(rows: DataFrame, path: str) -> None:
    """word, label, count, purity and counts as TSV, sorted by word."""
    rows.orderBy("word").select("word", "label", "count", F.format_string("%.3f", F.col("purity")).alias("purity"), "counts").write.csv(path, sep="\t", header=True)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, comment="#", schema="word string, label string, count long, purity double, counts string")


def language_columns(df: DataFrame, wanted: dict[str, str], pair: tuple[str, str]) -> str:
    """Which layout a table has, from its schema: ``columns`` (one a language) or ``pairs``."""
    if any(c in df.columns for c in wanted):
        return "columns"
    if all(c in df.columns for c in pair):
        return "pairs"
    raise ValueError(f"neither {sorted(wanted)} nor {pair} among the columns {df.columns}")


def get_json(url: str, tries: int = 6, wait: float = 2.0):
    """A JSON answer; too many requests, server errors and failed connections are tried again, each after twice the wait."""
    for attempt in range(tries):
        last = attempt == tries - 1
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise PermissionError(f"{url}: {e.code}") from e
            if last or (e.code != 429 and e.code < 500):
                raise
            pause = float(e.headers.get("Retry-After") or wait)
        except urllib.error.URLError:
            if last:
                raise
            pause = wait
        time.sleep(min(240.0, pause))
        wait *= 2
    raise ValueError("no try allowed")


def read_manifest(url: str, **retry) -> list[tuple[str, str, str]]:
    """(config, split, file) of a manifest ``{config: {split: [files]}}``, in its order."""
    return [(c, s, f) for c, splits in get_json(url, **retry).items() for s, files in splits.items() for f in files]


def list_splits(url: str, **retry) -> list[tuple[str, str]]:
    """(config, split) pairs of a listing ``{splits: [{config, split}]}``."""
    return [(s["config"], s["split"]) for s in get_json(url, **retry).get("splits", [])]


@dataclass
class Page(InputPartition):
    offset: int
    length: int


class PagedRestReader(DataSourceReader):
    """Rows of a paged JSON API: ``{rows: [{row: {...}}], num_rows_total}``; a partition a page."""

    def __init__(self, schema, options: dict):
        self.fields = schema.fieldNames()
        self.url, self.page = options["url"], int(options.get("page", 100))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.pause, self.tries, self.wait = float(options.get("pause", 1)), int(options.get("tries", 6)), float(options.get("wait", 2))

    def _get(self, offset: int, length: int) -> dict:
        join = "&" if "?" in self.url else "?"
        return get_json(f"{self.url}{join}offset={offset}&length={length}", self.tries, self.wait)

    def partitions(self) -> list[Page]:
        total = int(self._get(0, 1).get("num_rows_total", 0))
        total = total if self.limit is None else min(total, self.limit)
        return [Page(i, min(self.page, total - i)) for i in range(0, total, self.page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.length:
            for item in self._get(partition.offset, partition.length).get("rows", []):
                yield tuple(None if (v := item["row"].get(c)) is None else str(v) for c in self.fields)
            time.sleep(self.pause if partition.offset else 0)


class PagedRest(DataSource):
    """``spark.read.format("paged_rest").schema(...)``: string columns; those a row lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> PagedRestReader:
        return PagedRestReader(schema, self.options)
