"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard, packing, quality, sharding, simhash, spans, suffixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprinted(_table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.remove_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_sentences", "n_removed")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_warc, op3_quality, op4_html, op5_simhash, op6_suffixes, op7_sharding, op8_bpe, op9_spans, op10_jaccard, pipeline)
    return {f.__name__: f for f in found}


WARC_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


def _crc32_sql(blob: str, table: str = "crc") -> str:
    """CRC-32 of a blob, a byte at a time; ``table`` names a column with the list that _CRC gives."""
    values = f"list_transform(range(1, octet_length({blob}) + 1), lambda i: CAST('0x' || hex({blob}[i:i]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, x: xor(c >> 8, {table}[CAST(1 + (xor(c, x) & 255) AS BIGINT)])), 4294967295::BIGINT)"


def _crc_step(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


_CRC = f"[{', '.join(str(_crc_step(i)) for i in range(256))}]::BIGINT[]"


def _sharding_sql(shards: int = 40) -> str:
    fraction = lambda text: f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"
    key = "coalesce(CAST(doc_id AS VARCHAR), '')"

    def level(letter: str, table: dict[int, dict[int, float]], at: str | None) -> str:
        out = "CASE " + " ".join(
            f"WHEN {at or 0} = {parent} THEN list_min([{', '.join(f'''{{'draw': -ln({fraction(f"{key} || ':{letter}{c}'")}) / {w}::DOUBLE, 'child': {c}}}''' for c, w in sorted(below.items()))}]).child" for parent, below in sorted(table.items())
        )
        return out + " END"

    def step(rows: str, tree: list[sharding.Shard], name: str) -> str:
        at = None
        for letter, table in sharding._tables(tree):
            rows = f"SELECT *, {level(letter, table, at)} AS {name}_{letter} FROM ({rows})"
            at = f"{name}_{letter}"
        return rows

    tree = sharding.layout(shards)
    rows = f"SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, {_crc32_sql('b')} AS text_crc32, 'key' AS law FROM (SELECT *, encode(coalesce(text, '')) AS b, {_CRC} AS crc FROM documents)"
    rows = f"SELECT *, {fraction(key + " || ':slot:' || text_crc32")} AS h FROM ({rows})"
    rows = step(step(rows, tree, "now"), sharding.grown(tree), "more")
    return f"SELECT doc_id, size, text_crc32, law, now_s AS shard, row_number() OVER (PARTITION BY now_s ORDER BY h, {key}) - 1 AS slot, more_s AS grown_shard FROM ({rows})"


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN sets USING (doc_id) GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT doc_id, n AS n_shingles, least_id AS component_id FROM sizes JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) ON x = doc_id
"""

SUFFIX_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM texts WHERE octet_length(b) >= 200
), keys AS (
  SELECT r, i, md5_number(b[i:i + 199]) AS k FROM starts
), hits AS (
  SELECT r, i FROM keys WHERE k IN (SELECT k FROM keys GROUP BY k HAVING count(*) > 1)
), marked AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM hits
), numbered AS (
  SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM marked
), spans AS (
  SELECT r, min(i) AS a, max(i) + 199 AS z FROM numbered GROUP BY r, run
), gaps AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS f FROM spans
), lasts AS (
  SELECT r, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS z FROM spans GROUP BY r
), heads AS (
  SELECT r, string_agg(hex(b[f:a - 1]), '' ORDER BY a) AS h FROM gaps JOIN texts USING (r) WHERE a > f GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(h, '') || CASE WHEN coalesce(z, 0) < octet_length(b) THEN hex(b[coalesce(z, 0) + 1:octet_length(b)]) ELSE '' END)) AS kept_sha256
FROM texts LEFT JOIN lasts USING (r) LEFT JOIN heads USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op6_suffixes": SUFFIX_SQL, "op7_sharding": _sharding_sql(), "op10_jaccard": JACCARD_SQL}
