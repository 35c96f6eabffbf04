import bisect
import random

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from llm_helpers import check_packed
from tokenizers import Tokenizer

from framestride.llm import packing

PATH = P.path("word_bpe_49k.json")


def one_by_one(counts, size):
    """(windows, rooms left) of best-fit decreasing, a piece at a time."""
    rooms, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                n, room = n + 1, size
            else:
                room = rooms.pop(i)
            if room > length:
                bisect.insort(rooms, room - length)
    return n, rooms


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 100])
    counts = {n: rng.randint(1, 20) for n in rng.sample(range(1, size + 1), rng.randint(1, size))}
    rows, fill = packing.plan(counts, size), {}
    for length, n in counts.items():
        own = rows[rows[:, 0] == length]
        own = own[np.argsort(own[:, 1])]
        for rank in range(n):
            _, first, window, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            i = rank - first
            fill.setdefault(int(window + i // each), []).append((int(offset + i % each * length), length))
    left = []
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        left += [size - at] if at < size else []
    assert (len(fill), sorted(left)) == one_by_one(counts, size)
    assert sorted(fill) == list(range(len(fill)))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    check_packed(docs.collect(), packing.pack(docs, PATH).collect())


TEXTS = [None, "", " ", "<|endoftext|> a<|startoftext|>b", "it's they'RE o'clock.,", "İstanbul ǅ ß ẞ Σας ΟΔΟΣ", "é a\x1cb \x85x", " x　y", "ﬁ ²½ ª º µ", "abc., 12,000. a1.", "日本語。テスト", "naïve,NAÏVE.", "é.x x́, ́.", "word " * 30_000]


def test_words_are_encoded_as_the_library_does():
    tokenizer, ranks = Tokenizer.from_file(PATH), packing.merge_ranks(PATH)
    assert ranks is not None
    got = packing.ids(TEXTS, PATH, ranks)
    assert got == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    plain = packing.WordIds(PATH, None)
    assert all(plain.encode(w) == packing.WordIds(PATH, ranks).encode(w) for w in ("naïve,", "Hello.", "x", "ß.", "12."))


def test_random_characters_as_the_library_does(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    tokenizer, ranks, rng = Tokenizer.from_file(PATH), packing.merge_ranks(PATH), random.Random(3)
    pool = [*"abstreldmÉßªµ×÷¿²½159.,!_|- '\n\t\x0b", "\xa0", "\x85", "\xad", "\x00", "\x01", "\x1c", "\x7f", "Ω", "日", "\u0301", "İ", "'s", "'LL"]
    for size in (3, 12, 40):
        texts = ["".join(rng.choices(pool, k=rng.randint(0, size))) for _ in range(3000)]
        assert packing.ids(texts, PATH, ranks) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, length int")
    got = packing.pack(docs, PATH)
    check_packed(docs.collect(), got.collect())
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id bigint, text string"), PATH).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
