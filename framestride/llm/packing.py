"""Sequence packing by best-fit decreasing over a segment tree of remaining capacities.

Overlong documents are first cut into full windows. What is left of each document, shorter than a
window, goes into the open window with the least room that still holds it, longest pieces first.
Best-fit decreasing treats pieces of one length alike, so it is run on the number of pieces of each
length (at most `size` numbers, whatever the corpus), placing all equal pieces that meet equal open
windows at once; the result is the same as that of placing them one by one. Each piece then finds
its window by its rank among the pieces of its length, and ranks are counted in salted buckets.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, shingles

SIZE = 2048
END = 1
#: Words outside U+00FF whose ids a worker remembers, of LONG characters at most: below 16 MB.
WORDS, LONG = 50_000, 64


#: Stands for the mark of a word's end. Texts that hold this control character are left to the tokenizer.
MARK = b"\x01"


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, then the rest."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> tuple[dict[bytes, int], list[int], list[str]] | None:
    """(ranks by bytes, ids by rank, added tokens in lower case) that merge words as the tokenizer file does, or None if that isn't sure.

    The file merges listed pairs, in their order; ranks by bytes merge any pair whose bytes together
    are a token. Both give the same ids if no token comes from two pairs and the listed merges take
    every token's own characters to that token: a pair that only the ranks would merge would, in a
    token of its own, be left in two parts by the listed merges, since what merges within a stretch
    that no merge crosses does not depend on what lies around it.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, of, mark = told["model"], _alphabet(), told["model"].get("end_of_word_suffix")
    steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
    if model.get("type", "BPE") != "BPE" or mark != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    bare = lambda t: bytes(of[c] for c in t.removesuffix(mark)) + MARK * t.endswith(mark)
    pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    tokens = [bytes([b]) for b in range(256)] + [bytes([b]) + MARK for b in range(256)] + [bare(a) + bare(b) for a, b in pairs]
    if len(set(tokens)) < len(tokens):
        return None
    for a, b in pairs:
        whole = a + b
        parts = list(whole.removesuffix(mark))
        if whole.endswith(mark):
            parts[-1] += mark
        while len(parts) > 1:
            least, at = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if least == 1 << 30:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    ids = {bare(t): i for t, i in model["vocab"].items() if all(c in of for c in t.removesuffix(mark))}
    return {t: i for i, t in enumerate(tokens)}, [ids.get(t, -1) for t in tokens], [x["content"].lower() for x in told.get("added_tokens", [])]


def _class(kinds: str) -> str:
    """A character class of the characters up to U+00FF of some general categories."""
    return "".join(f"\\x{i:02x}" for i in range(256) if unicodedata.category(chr(i))[0] in kinds and chr(i) not in _SPACES)


_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: The pre-tokens that are not words: runs of signs and single digits, and before them contractions, if there are apostrophes.
_SIGNS = re.compile(f"[{_class('PSCZMN')}](?:(?<![{_class('N')}])[{_class('PSCZM')}]+)?")
_SHORT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_class('PSCZM')}]+|[{_class('N')}]")
#: What Python's split() takes for white space and the tokenizer does not.
_ODD = tuple("\x1c\x1d\x1e\x1f")


class WordIds:
    """Ids (as little-endian bytes) of texts, for a tokenizer that drops white space.

    In a text of characters up to U+00FF, on which lower case and composition act one by one, a mark
    takes the place of white space and follows every pre-token, and all pieces between marks are
    merged by merge_ranks() at once, so that nothing need be remembered from word to word. Any other
    text gets the ids of its words in turn, from the tokenizer; WORDS of them are remembered.
    """

    def __init__(self, path: str, ranks: tuple[dict[bytes, int], list[int], list[str]] | None):
        import tiktoken

        self.path, self.words, self.tokenizer, self.merge = path, {}, None, None
        self.added = ranks[2] if ranks else []
        if ranks and ranks[1] and min(ranks[1][256:], default=-1) >= 0:
            self.merge = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks[0], special_tokens={})
            # Single bytes need no id of their own: the last one of a piece is joined with its mark before all else.
            self.id = np.array(ranks[1], np.int64).astype(np.uint32)

    def _slow(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        self.tokenizer = self.tokenizer or Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.merge and "\x01" not in text and (text.isascii() or max(text) <= "\xff"):
            low = text.lower()
            if not any(x in low for x in self.added):
                marked = (_SHORT if "'" in low else _SIGNS).sub("\x01\\g<0>\x01", low) + "\x01"
                for c in _SPACES:
                    marked = marked.replace(c, "\x01")
                return self.id[self.merge.encode_to_numpy(marked, disallowed_special=())].astype("<u4").tobytes()
        if any(c in text for c in _ODD):
            return self._slow(text)
        return b"".join([self.words.get(w) or self._learn(w) for w in text.split()])

    def _learn(self, word: str) -> bytes:
        if len(self.words) >= WORDS:
            self.words.clear()
        got = self._slow(word)
        if len(word) <= LONG:
            self.words[word] = got
        return got


_known: dict[str, WordIds] = {}


def ids(texts: list[str | None], path: str, ranks: tuple | None = None) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers, without special tokens added."""
    known = _known.get(path) or _known.setdefault(path, WordIds(path, ranks))
    return [known.encode(t or "") for t in texts]


def forget() -> None:
    """Drop the tokenizers: workers outlive tasks, and a later stage needs their memory."""
    _known.clear()


def _pieces(path: str, ranks: tuple | None, size: int, end: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = int(end).to_bytes(4, "little")
        for part in parts:
            texts = part.column(1).to_pylist()
            for a, b in shingles.batches(texts):
                row, start, length, crc, total = [], [], [], [], []
                for i, x in enumerate(ids(texts[a:b], path, ranks), a):
                    x = x + last
                    n = len(x) // 4
                    for at in range(0, n, size):
                        row.append(i)
                        start.append(at)
                        length.append(min(size, n - at))
                        crc.append(zlib.crc32(x[4 * at : 4 * (at + size)]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        forget()

    return run


class _Room:
    """A segment tree over capacities: whether any window with so much room is open."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)

    def set(self, room: int, open_: bool) -> None:
        at = room + self.width
        self.any[at] = open_
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of at least need that a window has."""
        at = need + self.width
        if self.any[at]:
            return at - self.width
        while at > 1 and (at & 1 or not self.any[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.width:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.width


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces; rows (length, first rank, windows' first id, pieces each, offset).

    The pieces of a length from a row's first rank on go into windows of rising ids, so many to each,
    the first at the offset.
    """
    room, open_, rows, ids_ = _Room(size), {}, [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            open_.setdefault(space, []).append((first, n))
            room.set(space, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = room.tightest(length)
            if space is None:
                each = size // length
                n = -(-left // each)
                put(size, ids_, n)
                ids_ += n
                continue
            first, n = open_[space].pop()
            if not open_[space]:
                room.set(space, False)
            each = space // length
            full = min(n, left // each)
            used = size - space
            if full:
                rows.append((length, rank, first, each, used))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if n > full:
                if left:
                    rows.append((length, rank, first + full, left, used))
                    put(space - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(space, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of docs (doc_id, text).

    Each document is its text's ids and then the id end; a null or empty text has that id alone.
    A very long text is tokenised whole and cut into full windows. Rows that repeat a doc_id are
    documents of their own, and so are equal rows. Pieces of equal length are ranked by their own
    values, so which of them comes first does not change from run to run. Other columns are not read,
    whatever their names; no documents give no pieces.
    """
    kind = dict(docs.dtypes)["doc_id"]
    piece = docs.select("doc_id", "text").mapInArrow(shared.tidy(_pieces(path, merge_ranks(path), size, end)), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    piece = shared.cut(piece, "pack-pieces")
    count = {r["length"]: r["count"] for r in piece.groupBy("length").count().collect()}  # at most `size` rows
    rows = plan(count, size)
    key = rows[:, 0] << 44 | rows[:, 1]
    order = np.argsort(key)
    key, rows = key[order], rows[order]

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length, rank = (part.column(c).to_numpy() for c in ("length", "rank"))
            own = rows[np.searchsorted(key, length << 44 | rank, "right") - 1]
            i = rank - own[:, 1]
            new = [pa.array(own[:, 2] + i // own[:, 3]), pa.array(own[:, 4] + i % own[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), *new], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # A length's pieces are ranked in about as many buckets as each holds pieces, a sixteenth of that, so neither grows fast.
    salts = docs.sparkSession.createDataFrame([(n, math.isqrt(many) // 4 + 1) for n, many in count.items()], "length bigint, salts int")
    salted = piece.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "salts"))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
