"""The ten operators on a small table of hard rows, against plain versions."""

import base64
import gzip
import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from tokenizers import Tokenizer

from glossmill.llm import bpe, exchange, html, jaccard, packing, quality, sharding, simhash, spans, suffixes, warc
from glossmill.llm import textscan as ts

LONG = " ".join(f"w{i} and x{i * 7 % 101}." for i in range(3000))
BASE = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen. Seventeen eighteen nineteen twenty then more words follow here until the end comes. " * 2
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace("nine", "NINE")), (4, BASE + " tail"), (5, None), (6, ""), (7, " \n\t "), (8, "short one"), (9, "short ONE"), (10, LONG), (10, LONG), (11, LONG[:9000] + "zzz" + LONG[9000:]),
    (12, "é" * 150 + "ß 😀 中文。"), (13, "a" * 700), (None, BASE), (14, "same line\nsame line\n" * 30), (15, "$$$ *** word### &&& " * 40), (16, "It's 12 o'clock,  isn't\r\n\r\nit?   "), (17, "<|endoftext|> x"),
]
SCHEMA = "doc_id long, text string, chunk string, row string, n string, arr string, _h string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (10, 1, 0), (15, 0, 0), (8, 1, 1), (None, 1, 0), (11, None, None)], "doc_id long, quality int, toxic int")


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(packing.pieces(docs, path), group=20).collect()
    full = Tokenizer.from_file(path)
    want = Counter()
    for i, t in ROWS:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [None, None, (1 << 60) + 1, (1 << 60) + 3, 1]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    got = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    assert Counter(r.doc_id for r in got.collect()) == Counter(ids)


def test_packing_second_round():
    """Thrifty: a new sequence only where no gap fits; together the two rounds never use more than the first alone."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 65, 200))[::-1]
        seq, off = packing.pack_group(sizes, 64)
        used: dict[int, list[tuple[int, int]]] = {}
        for s, b, o in zip(sizes.tolist(), seq.tolist(), off.tolist(), strict=True):
            used.setdefault(b, []).append((o, s))
        for parts in used.values():
            at = 0
            for o, s in sorted(parts):
                assert o == at
                at += s
            assert at <= 64
        assert len(used) <= packing.sum_of_squares(sizes, 64)[0].max() + 1
        gaps: dict[int, int] = {}
        for s, b, o in zip(sizes.tolist(), *(x.tolist() for x in packing.sum_of_squares(sizes, 64, True)), strict=True):
            assert b in gaps or s == 64 or not any(g >= s for g in gaps.values())
            gaps[b] = 64 - o - s


def test_sum_of_squares_choice():
    """Each choice against trying all gaps."""
    sizes = np.sort(np.random.default_rng(1).integers(1, 21, 300))[::-1]
    seq, off = packing.sum_of_squares(sizes, 20)
    gaps: dict[int, int] = {}
    for s, b, o in zip(sizes.tolist(), seq.tolist(), off.tolist(), strict=True):
        count = Counter(g for g in gaps.values() if g)
        cost = {}
        for g in {*[g for g in count if g >= s], 20}:
            after = count.copy()
            if g < 20:
                after[g] -= 1
            if g > s:
                after[g - s] += 1
            cost[g] = sum(v * v for v in after.values())
        chosen = gaps.get(b, 20)
        assert cost[chosen] == min(cost.values())
        assert o == 20 - chosen
        gaps[b] = chosen - s


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u v", None), (4, "w", ""), (5, "w", "a\r\n\r\nWARC/1.1\r\nx"), (5, "w", "a\r\n\r\nWARC/1.1\r\nx"), (6, "é", "é" * 1000), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.round_trip(pages).collect()
    first: dict[bytes, int] = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and first[b] < i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    warc.write(pages, str(tmp_path / "w"))
    some = warc.read(spark, str(tmp_path / "w")).where("record_type = 'revisit'")
    assert some.count() == 2 and some.where("payload <> ''").count() == 0
    reader = warc.WarcReader({"path": str(tmp_path / "w"), "partition_bytes": "1"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("http://a", "w")), GreaterThan(("payload_length",), 3)]))
    assert left == [GreaterThan(("payload_length",), 3)]
    parts = reader.partitions()
    assert len(parts) == sum(len(p.paths) for p in parts) and parts[0].paths  # a file a partition
    found = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_type"], r["target_uri"]) for r in found] == [("revisit", "w")]  # the reader itself drops the others
    headers = warc.read(spark, str(tmp_path / "w"), payload="false")
    assert headers.where("payload is not null").count() == 0 and headers.count() == len(rows)
    with pytest.raises(ValueError):
        warc.write(pages, str(tmp_path / "w"))
    files = sorted((tmp_path / "w").iterdir())
    assert files and all(f.name.endswith(".warc.gz") for f in files)  # nothing hidden is left
    as_stream = [r for f in files for r in warc.parse(gzip.open(f), [])]  # any gzip reader reads the same
    assert sorted(map(str, as_stream)) == sorted(str(r) for f in files for r in warc.archive(pa.OSFile(str(f)), []))


class _Watched:
    """A file that notes how many bytes are read of it."""

    def __init__(self, data: bytes):
        self.inner, self.taken = pa.BufferReader(data), 0

    def read(self, n: int) -> bytes:
        data = self.inner.read(n)
        self.taken += len(data)
        return data

    def __getattr__(self, name: str):
        return getattr(self.inner, name)


def test_warc_passes_by_what_is_not_wanted():
    noise = np.random.default_rng(5).bytes(3_000_000)
    record = lambda kind, body: b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body)
    records = [record(b"response", noise), record(b"revisit", b""), record(b"response", b"\x1f\x8b\x08\x04 WARC/1.1\r\n"), record(b"revisit", b"x\r\n\r\n")]
    want = [r[-1] for r in warc.parse(io.BytesIO(b"".join(records)), [])]
    several = warc.member(records[0]) + warc.member(records[1] + records[2]) + warc.member(records[3])
    foreign = warc.member(records[0]) + b"".join(map(gzip.compress, records[1:]))
    for data, seeks in ((b"".join(records), True), (b"".join(map(warc.member, records)), True), (several, True), (foreign, True), (b"".join(map(gzip.compress, records)), False)):
        assert [r[-1] for r in warc.archive(_Watched(data), [])] == want
        some = _Watched(data)
        assert [r[-1] for r in warc.archive(some, [("record_type", frozenset(["revisit"]))])] == [want[1], want[3]]
        bare = _Watched(data)
        assert [r[5:] for r in warc.archive(bare, [], False)] == [(len(b), len(b), None) for b in want]
        assert (some.taken < 300_000) == (bare.taken < 300_000) == seeks
        for end in (len(data) - 6, len(data) // 2):
            with pytest.raises((ValueError, EOFError)):
                list(warc.archive(_Watched(data[:end]), []))
    wrong = bytearray(warc.member(records[3]))
    wrong[-5] ^= 1
    with pytest.raises(zlib.error):
        list(warc.archive(_Watched(bytes(wrong)), []))


def test_warc_bad_records():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n b\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    assert [(r[0], r[2], r[-1]) for r in warc.parse(io.BytesIO(good), [])] == [("response", "http://a/ b", b"xyz")]
    for bad in (b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: -1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"HTTP/1.1\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(good + bad), []))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"), [("record_type", frozenset(["response"]))]))


def test_warc_empty(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_quality(spark, docs, empty, labels):
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(ROWS)
    text = {i: t for i, t in ROWS}
    for r in got:
        t = text[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, seen = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set()
        dup = sum(x in seen or seen.add(x) is not None for x in lines)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).where("llr <> 0").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def thue_morse(steps):
    s = "a"
    for _ in range(steps):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_hashes_tell_regular_texts_apart(spark):
    """Words, lines, sentences and texts whose differences cancel out in polynomial hashes modulo 2**64."""
    one = thue_morse(11)
    two = one.translate(str.maketrans("ab", "ba"))
    w = ts.scan_words([one.encode(), two.encode(), one.encode()])
    assert w.hash[0] == w.hash[2] != w.hash[1]
    lines = quality.measure([f"{one}\n{two}\n{one}".encode()], np.zeros(quality.BUCKETS))
    assert lines["n_dup_lines"].tolist() == [1]
    apart = [" ".join(x) + "." for x in (one, two)]
    rows = spark.createDataFrame([(1, one), (2, two), (3, apart[0]), (4, apart[1])], "doc_id long, text string")
    assert [r.component_id for r in jaccard.similarity_classes(rows).orderBy("doc_id").collect()][:2] == [1, 2]
    first = [(x.hash[0], x.check[0]) for x in (spans.runs([t.encode()]) for t in (one, two))]
    assert first[0] != first[1]
    assert (simhash.fingerprints([one.encode()]) != simhash.fingerprints([two.encode()])).any()


def test_html_forward_pass():
    """The batched pass over padded pages against a plain one, a page and a step at a time."""
    rng = np.random.default_rng(5)
    weights = {k: v.astype(np.float64) for k, v in html.model()}
    pages = [rng.standard_normal((n, html.WIDTH)).astype(np.float32) for n in (1, 7, 4)]
    got = html.scores(dict(html.model()), *html.pad(pages))
    sig = lambda x: 1 / (1 + np.exp(-x))
    H = html.HIDDEN
    for k, page in enumerate(pages):
        sides = []
        for name, seq in (("ahead", page), ("back", page[::-1])):
            h, c, out = np.zeros(H), np.zeros(H), []
            for x in seq:
                z = np.concatenate([x, h, [1]]) @ weights[name]
                c = sig(z[H : 2 * H]) * c + sig(z[:H]) * np.tanh(z[3 * H :])
                h = sig(z[2 * H : 3 * H]) * np.tanh(c)
                out.append(h)
            sides.append(out if name == "ahead" else out[::-1])
        for i in range(len(page)):
            want = sig(np.concatenate([sides[0][i], sides[1][i], [1]]) @ weights["out"])
            assert abs(want - got[i, k]) < 1e-4


def test_html_reads_what_browsers_read():
    texts = lambda p: [b.text for b in html.blocks(p)]
    assert texts("<head><title>x</title><p>Hello") == ["Hello"]
    assert texts("<title>x</title>a<svg/>b<iframe src=y><p>c") == ["ab", "c"]
    assert texts("<p>The <math><mi>x</mi></math> is <object>big</object><canvas>!</canvas>") == ["The x is big!"]
    assert texts("<script>if (a<b) x='</p>'</script>y<style>p{}") == ["y"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert [b.depth for b in html.blocks("<table><tr><td>a<td>b<tr><td>c</table>d")] == [3, 3, 3, 0]
    deep = html.blocks("<div>x" * 20_000)
    assert len(deep) == 20_000 and deep[-1].depth == 20_000
    weights = dict(html.model())
    for page in ("<div>Hello there my friend, this is a first paragraph of text, and it has words.</div>", "<body>Bare text that stands in the body and goes on for some time, with commas, and ends."):
        assert html.extract([page], weights) == texts(page)


def test_html(spark):
    weights = dict(html.model())
    held = html.examples(120, 4242)
    right = total = 0
    for x, y in held:
        p = html.scores(weights, *html.pad([x]))[:, 0] > 0.5
        right, total = right + int((p == y).sum()), total + len(y)
    assert right / total > 0.95
    page = '<html><head><title>t</title></head><body><nav><a href="/">Menu</a></nav><article><h1>A &amp; B</h1><p>One\n  two<b>three</b>.<script>var a="</p>"</script><p>Four <br>five<!-- no --></article><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p>" * 50 + "<<>&#xZ;</"), (5, "u", "<div>" * 3000)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == "A & B\n\nOne twothree.\n\nFour five" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and len(got) == 5


def plain_fingerprint(text):
    """Votes of a text's terms, a bit at a time."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", text)
    hashes = [int(ts.scan_words([x]).hash[0]) for x in w]
    mix = lambda x: int(ts.mix(np.array([x % (1 << 64)], np.uint64))[0])
    terms = []
    for i in range(max(0, len(w) - simhash.TERM + 1)) if len(w) >= simhash.TERM else ():
        h = 0
        for x in hashes[i : i + simhash.TERM]:
            h = mix(h + x)
        terms.append(h)
    terms = terms or hashes
    out = bytearray()
    for word in range(simhash.BITS // 64):
        found = [mix(h + (word + 1) * 0x9E3779B97F4A7C15).to_bytes(8, "little") for h in terms]
        for byte in range(8):
            bits = 0
            for bit in range(7, -1, -1):
                vote = sum(1 if f[byte] >> bit & 1 else -1 for f in found)
                bits = bits << 1 | (vote > 0)
            out.append(bits)
    return bytes(out)


def test_simhash(spark, docs, empty):
    got = simhash.fingerprinted(docs, every=5).collect()
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in ROWS], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    texts = [t or "" for _, t in order]
    prints = [plain_fingerprint(t.encode()) for t in texts]
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    near = lambda a, b: 1.0 if a == b else min(1.0, max(0.0, math.cos(math.pi * apart(a, b) / 128)))
    want = []
    for k, (i, _) in enumerate(order):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        mark = plain_fingerprint(e.encode())
        within = sum(apart(prints[k], p) <= simhash.RADIUS for p in prints) if i is not None and i % 5 == 0 else None
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[k].hex(), mark.hex(), round(near(prints[k], mark), 9), round(near(prints[k], prints[(k + 1) % len(texts)]), 9), within))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in map(tuple, got)), key=key) == sorted(want, key=key)
    assert simhash.fingerprinted(empty).count() == 0
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (12, 16), dtype=np.uint8)
    close = np.repeat(base, 6, axis=0)
    for row in close:
        for b in rng.integers(0, 128, rng.integers(0, 4)):
            row[b // 8] ^= 1 << (b % 8)
    all_ = sorted({x.tobytes().hex() for x in np.concatenate([base, close])})
    asked = all_[::3]
    brute = {(q, p): d for q in asked for p in all_ if (d := apart(bytes.fromhex(q), bytes.fromhex(p))) <= 3}
    frame = lambda x: spark.createDataFrame([(p,) for p in x], "fingerprint string")
    found = simhash.within_radius(frame(asked), frame(all_), bucket=3).collect()
    assert {(r.query, r.fingerprint): r.distance for r in found} == brute and len(found) == len(brute)


def test_suffixes(docs, empty):
    got = suffixes.remove_repeats(docs).collect()
    texts = [(i, (t or "").encode()) for i, t in ROWS]
    seen = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(want, key=key)
    assert suffixes.remove_repeats(empty).count() == 0
    v, cover = suffixes.difference_cover()
    assert {(x - y) % v for x in cover for y in cover} == set(range(v))


def test_sharding(docs, empty, spark):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(ROWS)
    text = {i: (t or "").encode() for i, t in ROWS}
    where = {}
    for r in got:
        assert r["size"] == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and 0 <= r.shard < 40
        assert r.grown_shard in (r.shard, 40) and where.setdefault(r.doc_id, r.shard) == r.shard
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    many = sharding.shard_documents(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).toPandas()
    counts = many.groupby("shard").size()
    assert len(counts) == 40 and counts.min() > 380 and counts.max() < 620 and 380 < (many.grown_shard == 40).sum() < 620
    assert sharding.shard_documents(empty).count() == 0
    tree = sharding.layout(20)
    heavier = [s._replace(weight=2.0) if s.shard == 3 else s for s in tree]
    ids = spark.range(5000).select(F.col("id").alias("k"))
    a = sharding.descend(sharding.descend(ids, F.col("k"), tree, "old"), F.col("k"), heavier, "new").toPandas()
    moved = a[a.old != a.new]
    assert len(moved) and (moved.new < 10).all()  # only into the region whose weight grew


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(path).ranks, special_tokens={})
    got = bpe.digests(docs, path).collect()
    want = []
    for i, t in ROWS:
        ids = e.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.encode_documents(empty, path).count() == 0
    rng, letters = np.random.default_rng(0), list("  \n\t''srtevmlld1½.,é中😀\x85")
    texts = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(5000)]
    coded = bpe.codec(path).encode([t.encode() for t in texts])
    assert [i.tolist() for i, _ in coded] == [e.encode_ordinary(t) for t in texts]
    for t, (ids, offsets) in zip(texts, coded, strict=True):
        cuts = [*offsets.tolist(), len(t.encode())]
        a, b = sorted(rng.integers(0, len(cuts), 2).tolist())
        assert bpe.codec(path).decode(ids, offsets) == t.encode()
        assert bpe.codec(path).decode(ids, offsets, a, b) == t.encode()[cuts[a] : cuts[b]]
    ids, offsets = bpe.codec(path).encode([b"several words here"])[0]
    for i, o in ((ids, offsets + 1), (ids[1:], offsets), (ids, offsets[:0]), (ids[:0], offsets), (ids + 99_999, offsets)):
        with pytest.raises(ValueError):
            bpe.codec(path).decode(i, o)
    encoded = bpe.encode_documents(docs, path)
    assert sorted(map(tuple, bpe.decode_documents(encoded, path).collect()), key=key) == sorted([(i, bytearray((t or "").encode())) for i, t in ROWS], key=key)
    second = {r.doc_id: bytes(r.text) for r in bpe.decode_documents(encoded, path, 1, 2).collect()}
    assert second[8] == b" one" and second[6] == b"" and bpe.decode_documents(encoded.limit(0), path).count() == 0


def sentences_of(text):
    """(first byte, words) of each sentence of a text, a word at a time."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out, now = [], []
    for k, (a, b, w) in enumerate(words):
        now.append((a, w))
        tail = w
        for _ in range(3):
            if len(tail) > 1 and tail[-1:] in b"\"')]}":
                tail = tail[:-1]
        chosen = int(ts.scan_words([w]).hash[0]) >> 62 == 0
        if chosen or tail[-1:] in b".!?" or k + 1 == len(words) or b"\n" in text[b : words[k + 1][0]]:
            out.append(now)
            now = []
    return out


def runs_of(parts):
    """(first sentence, sentence behind the last) of each run of a text."""
    size = lambda a, b: sum(map(len, parts[a:b]))
    n, found = len(parts), set()
    for a in range(n):
        if (b := next((b for b in range(a + spans.RUN, n + 1) if size(a, b) >= spans.LEAST), None)) is not None:
            found.add((a, b))
    for b in range(1, n + 1):
        if (a := next((a for a in range(b - spans.RUN, -1, -1) if size(a, b) >= spans.LEAST), None)) is not None:
            found.add((a, b))
    return found or ({(0, n)} if n else set())


def plain_spans(rows):
    """(id, text, sentences, removed) by the definition."""
    cut_up = [sentences_of((t or "").encode()) for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        for a, b in sorted(runs_of(cut_up[k])):
            run = tuple(tuple(w for _, w in p) for p in cut_up[k][a:b])
            if run in seen:
                gone[k].update(range(a, b))
            seen.add(run)
    out = []
    for (i, t), parts, lost in zip(rows, cut_up, gone, strict=True):
        b = (t or "").encode()
        at = [p[0][0] for p in parts] + [len(b)]
        left = b[: at[0]] + b"".join(b[at[j] : at[j + 1]] for j in range(len(parts)) if j not in lost)
        out.append((i, None if t is None else left.decode(), len(parts), len(lost)))
    return out


def test_spans(spark, docs, empty):
    passage = "first we met the old keeper of the northern light and then we walked along the shore until the tide turned and nobody could say how the boats had come back without a single lamp burning in the windows of the houses on the long grey hill above"
    more = [(20, "Alpha beta gamma " + passage + " omega. Last words stay."), (21, "Quite another start of a long line with its own words before " + passage + " and an end."), (22, "In. " * 40), (23, 'He said "no." (Yes!) ' * 9 + "\n\n" + "x y z\n" * 9)]
    rows = [*ROWS, *more]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = plain_spans(rows)
    got = spans.remove_spans(table)
    assert len(got.columns) == len(docs.columns) + 2
    assert sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got.collect()), key=key) == sorted(want, key=key)
    by = {w[0]: w for w in want}
    assert "shore until the tide turned" in by[20][1] and "shore until the tide turned" not in by[21][1]
    assert by[21][1].startswith("Quite another start") and by[12][1] == dict(ROWS)[12]
    assert spans.remove_spans(empty).count() == 0
    short = spark.createDataFrame([(1, "Nine words are in this one sentence, as said."), (2, "Nine words are in this one sentence, as said."), (3, "Two. Short."), (4, "Two. Short."), (5, "Two.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.remove_spans(short).collect()} == {1: "Nine words are in this one sentence, as said.", 2: "", 3: "Two. Short.", 4: "", 5: "Two."}


def test_spans_recall(spark):
    """Shared passages without punctuation in different surroundings: how many lose a part in the second text."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8)))
    for length, least in ((25, 0.85), (30, 0.93), (50, 0.99)):
        rows = []
        for k in range(300):
            passage = " ".join(word() for _ in range(length))
            rows += [(2 * k, " ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(15))), (2 * k + 1, " ".join(word() for _ in range(7)) + " " + passage + " " + " ".join(word() for _ in range(9)))]
        got = spans.remove_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1 and n_removed > 0").count()
        assert got >= least * 300, (length, got)


def test_jaccard(docs, empty):
    sets = []
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    comp = list(range(len(sets)))
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    want = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if comp[j] == comp[k] and sets[j][0] is not None]
        want.append((i, len(s), min(ids) if s else i))
    for block in (1, 256):  # 1: every group is dealt into parts
        assert sorted(map(tuple, jaccard.similarity_classes(docs, block=block).collect()), key=key) == sorted(want, key=key)
    assert jaccard.similarity_classes(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(plain_keep_one(ROWS), key=key)


def plain_classes(rows):
    """Component number of each row, None without words."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    return [c if s else None for c, s in zip(comp, sets, strict=True)]


def plain_keep_one(rows):
    first = {}
    of = plain_classes(rows)
    for k, c in enumerate(of):
        if c is not None:
            order = (rows[k][0] is None, rows[k][0] or 0, k)
            first[c] = min(first.get(c, order), order)
    return [r for k, r in enumerate(rows) if of[k] is None or first[of[k]] == (r[0] is None, r[0] or 0, k)]


def test_jaccard_chains_of_large_ids(spark):
    """Each text links to its neighbours only, so a component is a long chain; ids don't fit a double."""
    words = [f"w{i}" for i in range(400)]
    rows = [((1 << 60) + 1 + i, " ".join(words[4 * i : 4 * i + 80])) for i in range(20)]
    rows += [(None, " ".join(words[80:160])), (7, " ".join(words[300:380])), (None, "quite alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    of = plain_classes(rows)
    least = {c: min((r[0] for r, d in zip(rows, of, strict=True) if d == c and r[0] is not None), default=None) for c in of}
    for block in (1, 4, 256):
        got = Counter((r.doc_id, r.component_id) for r in jaccard.similarity_classes(docs, block=block).collect())
        assert got == Counter((r[0], least[c]) for r, c in zip(rows, of, strict=True)), block


def test_keep_one_tells_rows_apart(spark):
    a, b = "one two three four five six seven eight", "something else that is like nothing in the table"
    docs = spark.createDataFrame([(1, a, 5, {"k": 1}), (10, a, 6, {}), (10, b, 7, {}), (10, b, 7, {}), (None, None, 8, {})], "doc_id long, text string, _row int, tags map<string,int>")
    kept = jaccard.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r._row) for r in kept.collect()), key=key) == [(1, 5), (10, 7), (None, 8)]


def test_exchange_codec():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (exchange.decode(exchange.encode(keys), len(keys)) == keys).all()
    assert len(ts.scan_words([]).hash) == 0


def test_very_long_texts(spark):
    """Texts above a block and a chunk: two equal ones, and one like them but for its end."""
    rng = np.random.default_rng(9)
    text = " ".join(f"v{x}" for x in rng.integers(0, 10**9, 650_000))
    assert len(text) > 6 << 20
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[: len(text) // 2] + " end of it"), (4, "x")], "doc_id long, text string").repartition(2)
    kept = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(docs).drop("kept").collect()}
    assert kept[1] == kept[2] == len(text) and kept[3] == len(text) // 2 and kept[4] == 0
    assert {r.doc_id: r.component_id for r in jaccard.similarity_classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    left = {r.doc_id: len(r.text) for r in spans.remove_spans(docs).select("doc_id", "text").collect()}
    assert left[1] == len(text) and left[2] == 0 and left[3] < 200 and left[4] == 1
    found = {r.doc_id: r for r in simhash.fingerprinted(docs, 1).collect()}
    assert found[1].fingerprint == found[2].fingerprint and found[1].n_within == 2
