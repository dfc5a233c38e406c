"""Rules, classifier, decoder, views, readers and streaming on small inputs."""

import http.server
import json
import math
import threading
import urllib.parse
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.functions import pieces
from glossmill.functions import text as tx
from glossmill.operators import bayes, chunked, decode, identify, metrics, views, words
from glossmill.sources import readers
from glossmill.streaming import lines

PAIRS = [("taara", "bam"), ("kunun", "bam"), ("dugu", "bam"), ("maison", "fra"), ("bonjour", "fra"), ("partout", "fra"), ("house", "eng"), ("where", "eng"), ("download", "eng")]
LEXICON = [("n", "bam", 1.0), ("la", "bam", 3.0), ("la", "fra", 2.0), ("ye", "bam", 1.0)]


@pytest.fixture(scope="module")
def identifier(spark):
    lex = words.lexicon_table(spark.createDataFrame(LEXICON, "form string, label string, weight double"))
    return identify.Identifier(lex, bayes.fit(spark.createDataFrame(PAIRS, "word string, label string")))


def tokens(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return [(r.text, r.start, r.end, r.kind) for r in tx.tokenize(df, "id", "text").orderBy("pos").collect()]


def test_tokens_and_offsets(spark):
    assert tokens(spark, "L’hôpital est") == [("L’", 0, 2, "CLITIC"), ("hôpital", 2, 9, "WORD"), ("est", 10, 13, "WORD")]
    assert tokens(spark, "it's 10h30 😀") == [("it's", 0, 4, "WORD"), ("10h30", 5, 10, "UNIV"), ("😀", 11, 12, "UNIV")]
    assert [t[0] for t in tokens(spark, "o'clock aujourd'hui foo_bar")] == ["o'", "clock", "aujourd'hui", "foo", "_", "bar"]
    assert [t[3] for t in tokens(spark, "www.a.b/c x@y.zz #tag ½")] == ["UNIV", "UNIV", "UNIV", "WORD"]
    assert tokens(spark, "") == [] and tokens(spark, None) == []


def test_grams(spark):
    got = spark.range(1).select(tx.grams(F.lit("ab")).alias("g")).first().g
    assert got == ["a", "b", "<a", "ab", "b>", "<ab", "ab>", "<ab>"]
    assert spark.range(1).select(tx.grams(F.lit("")).alias("g")).first().g == ["<>"]


def test_predict_matches_plain_formula(spark):
    model = bayes.fit(spark.createDataFrame(PAIRS, "word string, label string"))
    grams = lambda w: [g for n in range(1, 6) for i in range(len(w) + 2 - n + 1) if (g := f"<{w}>"[i : i + n]) not in "<>"]
    counts = {x: {} for x in tx.LANGUAGES}
    for w, x in PAIRS:
        for g in grams(w):
            counts[x][g] = counts[x].get(g, 0) + 1
    vocabulary = len(set().union(*counts.values()))
    for r in bayes.predict(spark.createDataFrame([("dugutaa",), ("housing",)], "word string"), "word", model).collect():
        s = []
        for x in tx.LANGUAGES:
            total, g = sum(counts[x].values()), grams(r.word)
            s.append(math.log((3 + 1) / (9 + 3)) + sum(math.log((counts[x].get(y, 0) + 0.1) / (total + 0.1 * (vocabulary + 1))) for y in g) / math.sqrt(len(g)))
        e = np.exp(np.array(s) - max(s))
        assert np.allclose(r.probs, e / e.sum(), atol=1e-9)


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(0)
    e = rng.random((4, 3))
    want = np.zeros((4, 3))
    for k in range(3**4):
        path = [k // 3**i % 3 for i in range(4)]
        p = e[0, path[0]] / 3
        for a, b, i in zip(path, path[1:], range(1, 4)):
            p *= (0.8 if a == b else 0.1) * e[i, b]
        for i, s in enumerate(path):
            want[i, s] += p
    assert np.allclose(decode.posteriors(e), want / want.sum(axis=1, keepdims=True))
    assert np.isfinite(decode.posteriors(np.full((20_000, 3), 1e-9))).all()


def test_identify(spark, identifier):
    docs = spark.createDataFrame([(1, "N taara l'hôpital la kunun."), (2, "chapitre VII ɛ"), (3, "..."), (4, None)], "id long, text string")
    got = identifier.identify(docs, "id", "text").cache()
    one = {r.text: r for r in got.where("id = 1").collect()}
    assert one["hôpital"].label == "fra" and one["hôpital"].source == "router" and one["."].label == "univ"
    assert one["N"].label == "bam" and one["N"].source in ("lexicon", "context")
    assert {r.text: r.label for r in got.where("id = 2").collect()}["VII"] == "univ"
    assert views.violations(got).count() == 0
    rows = {r.id: r for r in views.summarize(docs, got, "id").collect()}
    assert rows[3].dominant is None and rows[3].n_words == 0 and rows[4].n_words == 0
    assert rows[1].code_switched and rows[1].n_words == 6
    assert {r.id for r in identifier.detect(docs, "id", "text").collect()} == {1, 2, 3, 4}
    assert "[fra]" in {r.id: r.overview for r in views.overview(docs, got, "id", "text").collect()}[1]
    assert {r.id: r.tags for r in identifier.tag(docs, "id", "text").collect()}[3] is None


def test_origins_are_never_features(spark, identifier):
    plan = identifier.identify(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")._jdf.queryExecution().toString()
    assert "origin_lang" not in plan


def test_model_round_trip(spark, tmp_path):
    model = bayes.fit(spark.createDataFrame(PAIRS, "word string, label string"))
    bayes.save(model, str(tmp_path / "m"))
    again = bayes.load(spark, str(tmp_path / "m"))
    assert again.stats == model.stats and again.vocabulary == model.vocabulary
    with pytest.raises(ValueError):
        bayes.fit(spark.createDataFrame([("x", "zzz")], "word string, label string"))


def test_scores_with_empty_denominators(spark):
    table = metrics.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "gold string, pred string"))
    got = {r.label: r for r in metrics.scores(table).collect()}
    assert got["b"].precision == 0 and got["b"].support == 0 and got["c"].recall == 0 and abs(got["a"].f1 - 0.5) < 1e-12


def test_readers(spark, tmp_path):
    (tmp_path / "g.conll").write_text("# note\nn\tbam\n#tag\tuniv\n\nbɛ\tbam\n", encoding="utf-8")
    got = readers.parse_conll(readers.numbered_lines(spark, str(tmp_path / "g.conll")), tx.LABELS).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.pos, r.token) for r in got] == [(0, 0, "n"), (0, 1, "#tag"), (1, 0, "bɛ")]
    (tmp_path / "bad.conll").write_text("n\tzzz\n", encoding="utf-8")
    with pytest.raises(Exception, match="not a token"):
        readers.parse_conll(readers.numbered_lines(spark, str(tmp_path / "bad.conll")), tx.LABELS).collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert [r.a for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", 2).collect()] == [1]
    freq = readers.parse_frequency(spark.createDataFrame([("la 12",), ("x y 3",), ("u abc",)], "v string"), "v", "bam")
    assert [(r.word, r.n) for r in freq.collect()] == [("la", 12)]
    lex = readers.parse_lexicon(spark.createDataFrame([("la\tbam:3,fra:2 # x",), ("# y",), ("n\tbam",)], "v string"), "v")
    assert sorted((r.form, r.label, r.weight) for r in lex.collect()) == [("la", "bam", 3.0), ("la", "fra", 2.0), ("n", "bam", 1.0)]


def test_stream_equals_batch(spark, identifier, tmp_path):
    docs = spark.createDataFrame([(1, "n taara"), (2, "bonjour la maison")], "id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    lines.identify_stream(stream, "id", "text", identifier, lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(seen) == sorted(identifier.identify(docs, "id", "text").collect())


def test_checked_tables(spark):
    lex = lambda rows: words.lexicon_table(spark.createDataFrame(rows, "form string, label string, weight double"))
    assert lex([("a", "bam", 1.0), ("a", "fra", 3.0)]).first().weights == {"bam": 0.25, "fra": 0.75}
    for bad in ([("a", "zzz", 1.0)], [("a", None, 1.0)], [("a", "bam", 1.0), ("A", "bam", 2.0)], [("a", "bam", 0.0)]):
        with pytest.raises(Exception, match="lexicon"):
            lex(bad).collect()
    origins = lambda rows: words.origin_table(spark.createDataFrame(rows, "form string, origin_lang string, source_form string"))
    assert origins([("a", "fra", "x")]).count() == 1
    for bad in ([("a", "fra", "x"), ("A", "eng", "y")], [("a", "fr", "x")], [("a", None, "x")]):
        with pytest.raises(Exception, match="origins"):
            origins(bad).collect()


def test_composition_does_not_matter(spark, identifier):
    docs = spark.createDataFrame([(1, "\u00e9t\u00e9 taara"), (2, "e\u0301te\u0301 taara")], "id long, text string")
    got = identifier.identify(docs, "id", "text").orderBy("id", "pos").collect()
    assert [(r.label, r.confidence, r.source) for r in got[:2]] == [(r.label, r.confidence, r.source) for r in got[2:]]


def test_ambiguous_words_may_ask_the_classifier(spark):
    lex = words.lexicon_table(spark.createDataFrame([("dugu", "bam", 1.0), ("dugu", "eng", 1.0)], "form string, label string, weight double"))
    model = bayes.fit(spark.createDataFrame(PAIRS, "word string, label string"))
    docs = spark.createDataFrame([(1, "dugu")], "id long, text string")
    plain = identify.Identifier(lex, model).identify(docs, "id", "text").first()
    asked = identify.Identifier(lex, model, identify.Config(ambiguous_use_classifier=True)).identify(docs, "id", "text").first()
    p = model.predict(spark.createDataFrame([("dugu",)], "word string"), "word").first().probs
    assert plain.confidence == 0.5 - 0.0 or abs(plain.confidence - 0.5) < 0.01
    w = [0.5 * max(p[0], 1e-3), 0.0, 0.5 * max(p[2], 1e-3)]
    e = [max(x / sum(w), 1e-4) for x in w]
    assert asked.label == "bam" and abs(asked.confidence - e[0] / sum(e)) < 1e-3


def test_paged_rest(spark):
    """Pages, a busy answer, a refusal, a manifest and a list of splits, from a server of the test's own."""
    rows = [{"row": {"a": i, "b": None if i % 2 else "x"}} for i in range(25)]
    busy = [True]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = urllib.parse.parse_qs(url.query)
            body, code = {}, 200
            if url.path == "/rows":
                if busy.pop() if busy else False:
                    code = 429
                at, n = int(q["offset"][0]), int(q["length"][0])
                body = {"rows": rows[at : at + n], "num_rows_total": len(rows)}
            elif url.path == "/manifest":
                body = {"c": {"train": ["f1", "f2"], "test": ["f3"]}}
            elif url.path == "/splits":
                body = {"splits": [{"config": "c", "split": "test"}]}
            else:
                code = 403
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(readers.PagedRest)
    got = spark.read.format("paged_rest").schema("a string, b string").options(url=f"{base}/rows", columns="a string, b string", page="10", pause="0", wait="0.01").load().collect()
    assert sorted((int(r.a), r.b) for r in got) == [(i, None if i % 2 else "x") for i in range(25)]
    assert readers.read_manifest(f"{base}/manifest") == [("c", "train", "f1"), ("c", "train", "f2"), ("c", "test", "f3")]
    assert readers.list_splits(f"{base}/splits") == [("c", "test")]
    with pytest.raises(PermissionError):
        readers.get_json(f"{base}/closed")
    server.shutdown()


def test_parquet_limit_takes_the_first_rows(spark, tmp_path):
    spark.range(100).selectExpr("id", "'c' config", "if(id < 50, 'train', 'test') split").coalesce(1).write.partitionBy("config", "split").parquet(str(tmp_path / "p"))
    got = readers.read_parquet(spark, str(tmp_path / "p"), ["id"], "c", "test", 3)
    assert [r.id for r in got.collect()] == [50, 51, 52] and readers.read_parquet(spark, str(tmp_path / "p")).count() == 100


def test_documents_in_chunks_are_identified_as_token_rows(spark, identifier, monkeypatch):
    texts = ["Le www.x.y/a,b! (nom.prenom@ex.org.) dit: «Taara» 3,5.6 l’Ami… Musa? Hello, World.", "la Maison. La Dugu ye", "", None, "　é、x。x@y.z;q a.b", "bɛ IV 10h n'a\n\nBonjour", "a" * 50 + " b" * 500]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "id long, text string").coalesce(1)
    want = sorted(map(tuple, identifier.identify_tokens(tx.tokenize(docs, "id", "text"), "id").collect()))
    monkeypatch.setattr(chunked, "CHUNK_BYTES", 300)
    monkeypatch.setattr(chunked, "SLICE_BYTES", 100)
    monkeypatch.setattr(chunked, "PART_PIECES", 20)
    assert sorted(map(tuple, identifier.identify(docs, "id", "text").collect())) == want
    counts = Counter((r[5], r[7]) for r in want)
    assert sorted(map(tuple, identifier.tally(docs, "id", "text").collect())) == sorted((*k, n) for k, n in counts.items())


def test_identification_keeps_a_repeated_word_once_a_chunk(spark, identifier):
    """Rows between the stages follow distinct words, not tokens; each token was a shuffled row before."""
    docs = spark.createDataFrame([(1, "taara dugu " * 20_000)], "id long, text string")
    told = identifier._settled(docs, "id", "text")[1]
    assert told.count() == 2
    assert [r.n for r in identifier.tally(docs, "id", "text").collect()] == [40_000]


def test_pieces_lie_where_they_say():
    text = "a.b 3,5! x@y.z.! www.a.b,c ... a.5\té… «x»"
    found, counts, starts, lengths = pieces.cut_up(pa.array([None, text, "", "  "]))
    assert counts.tolist() == [0, len(found), 0, 0]
    assert found.to_pylist() == [text[a : a + n] for a, n in zip(starts, lengths, strict=True)] == ["a", ".", "b", "3,5", "!", "x@y.z.!", "www.a.b,c", ".", ".", ".", "a.5", "é", "…", "«x»"]


def test_chains_side_by_side_are_decoded_as_one_by_one(monkeypatch):
    r = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 40, 7, 7, 200, 0])
    e = r.random((sizes.sum(), 3))
    monkeypatch.setattr(decode, "BLOCK", 50)
    ends = np.cumsum(sizes)
    assert (decode.chains(e, sizes) == np.concatenate([decode.posteriors(e[z - n : z]) for z, n in zip(ends, sizes, strict=True) if n])).all()


def test_counts_by_pieces_are_counts_of_tokens(spark):
    rows = [(1, ["x"], "L’ami, l’ami! a.b"), (1, ["x"], "x@y.z, a.b"), (None, None, "a.b www.a.b"), (2, [], None)]
    docs = spark.createDataFrame(rows, "g int, h array<string>, text string")
    want = tx.token_kinds(docs, "text", "g", "h").groupBy("g", "h", "text", "kind").agg(F.count("*").alias("n"))
    got = tx.token_counts(docs, "text", "g", "h")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
