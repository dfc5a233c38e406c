"""Sum-of-squares packing of tokenised documents into sequences.

Pieces are dealt by hash into groups of about GROUP pieces, as many groups as the corpus needs; each group is
packed by itself, largest piece first (ids order equal lengths, nulls last). With N[g] open sequences of gap g, a piece of length s goes where the
sum of N[g]**2 becomes smallest: into an open sequence of some gap g >= s, or into a new one. Ties go to the
tightest gap. The pieces of sequences that stay open are then placed once more, with new sequences only where
no gap fits. Only a histogram of gaps steers the choice, so memory doesn't grow with the open sequences.

Nulls: a null text is empty and gives one piece, the end token; rows with null or equal ids are packed a row
each, dealt to groups by their place too, so one id may hold any share of the rows. Ids stay 64-bit integers all
the way. Texts may hold the tokenizer's special tokens, which are encoded as the library does by default. Empty tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.plans.lineage import cut

CAPACITY = 4096
END = 1
GROUP = 1 << 15
CACHE, RECENT = 400_000, 200_000  # words
WORD_END = b"\xff"
# Characters for which one word's lower case, composition and class don't depend on its neighbours.
PLAIN = re.compile(r"[\t-\r -~¡-¬®-įı-ſ]*")
LETTER = "a-zªµºß-öø-ſ"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9²³¹¼-¾]|[^\t-\r {LETTER}0-9²³¹¼-¾]+")


class WordTokenizer:
    """A tokenizers file whose words are encoded once each and then looked up; exact for every text.

    Texts with characters outside PLAIN or a special token go to the tokenizers library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in whole.get("added_tokens", [])) or r"(?!)", re.I)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
        others = [b for b in range(256) if b not in shown]
        letters = [chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)]
        byte_of = {c: b for b, c in enumerate(letters)}

        def raw(token: str) -> bytes:
            """A token's bytes; the word's end, which a byte that UTF-8 lacks stands for, joins its byte before all merges."""
            end = token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if end else token)) + WORD_END * end

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + WORD_END: 256 + b for b in range(255)}
        for i, m in enumerate(model["merges"]):
            ranks.setdefault(raw(m.replace(" ", "") if isinstance(m, str) else "".join(m)), 512 + i)
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.zeros(max(ranks.values()) + 1, "<u4")
        for token, i in model["vocab"].items():
            if all(c in byte_of for c in token.removesuffix("</w>")) and (rank := ranks.get(raw(token))) is not None:
                self.id_of[rank] = i

    def _learn(self, words: list[str]) -> None:
        """Encode the words not known yet, many in one call; past CACHE words, all but the first CACHE leave again."""
        if len(self.known) > CACHE + RECENT:
            for w in list(self.known)[CACHE:]:
                del self.known[w]
        for w in words:
            if w not in self.known:
                self.known[w] = self.merge(w).tobytes()

    def merge(self, word: str) -> np.ndarray:
        """One word's ids: its byte letters, the last with the word's end; the pair of lowest rank is merged first."""
        return self.id_of[self.core._encode_single_piece(word.encode() + WORD_END)]

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not PLAIN.fullmatch(text) or self.special.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = WORD.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.known.__getitem__, words))


@functools.lru_cache(2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as token pieces of at most ``capacity``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = memoryview(known.ids(t or "") + END.to_bytes(4, "little"))
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((i, k, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(split, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY, thrifty: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given; ``thrifty``: a new sequence only where no gap fits."""
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        # N[g] -> N[g] - 1 and N[g - s] -> N[g - s] + 1 change the sum by 2 (N[g - s] - N[g]) + 2; below, less by 2
        change = 2 * (count[: capacity - s + 1] - count[s:])
        change[0] = -2 * count[s] - 1  # a gap of exactly s is closed
        change[count[s:] == 0] = np.iinfo(np.int64).max
        change[capacity - s] = 2 * count[capacity - s] - 1 if s < capacity else 0  # a new sequence
        if thrifty and s < capacity and count[s:capacity].any():
            change[capacity - s] = np.iinfo(np.int64).max
        g = int(change.argmin()) + s
        if g == capacity:
            b = len(used)
            used.append(0)
        else:
            b = stacks[g].pop()
            count[g] -= 1
        seq[i], off[i] = b, used[b]
        used[b] += s
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return seq, off


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece by two rounds: what is in sequences that stay open is placed once more, thriftily."""
    seq, off = sum_of_squares(sizes, capacity)
    fill = np.bincount(seq, sizes)
    again = (fill < capacity)[seq] if len(sizes) else np.zeros(0, bool)
    if again.any():
        seq2, off2 = sum_of_squares(sizes[again], capacity, True)
        if seq2.max() + 1 < (fill < capacity).sum():
            seq[again], off[again] = seq2 + len(fill), off2
    return seq, off


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``parts`` with the sequence each piece is put in and its offset there."""
    parts = cut(parts)
    groups = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def place(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]))
        seq, off = pack_group(table["length"].to_numpy(), capacity)
        at = table["grp"].to_numpy().astype(np.int64) << 40
        return table.drop_columns("grp").append_column("sequence_id", pa.array(seq + at)).append_column("offset", pa.array(off))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.repartition(groups, "grp").groupBy("grp").applyInArrow(place, schema)
