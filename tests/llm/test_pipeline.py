"""The pipeline against a plain version of its stages, and with hard columns."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import ROWS, docs, key, labels, plain_keep_one, plain_spans  # noqa: F401
from tokenizers import Tokenizer

import corpus_pipeline
from glossmill.llm import quality


def test_pipeline(spark, docs, labels, tmp_path):  # noqa: F811
    plain = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("_row"), F.lit(2).alias("n_removed"))
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = {r.doc_id for r in quality.quality(step, labels).where("kept").collect()}
    rows = [r for r in ROWS if r[0] in good]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, str(tmp_path))
        assert out.columns == plain.columns
        out.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            rows = plain_keep_one(rows)
        if name == "substring_dedup":
            rows = [(i, t) for i, t, _, _ in plain_spans(rows)]
        assert sorted(((r.doc_id, r.text) for r in step.collect()), key=key) == sorted(rows, key=key), name
        assert step.where("n_chars <> length(text)").count() == 0
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == want


def test_pipeline_of_nothing(spark, docs, labels, tmp_path):  # noqa: F811
    docs.select("doc_id", "text").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
