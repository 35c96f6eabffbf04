import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framestride.llm import shingles

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def plain(text, size=5):
    words = WORD.findall((text or "").lower())
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


@settings(max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab 1.É\n", max_size=40)), max_size=8))
def test_hashes_are_equal_as_words_are(texts):
    h, at = shingles.words(texts)
    want = [WORD.findall((t or "").lower()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    h, at = shingles.shingles(texts)
    flat = [s for t in texts for s in plain(t)]
    assert np.diff(at).tolist() == [len(plain(t)) for t in texts]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_a_text_longer_than_a_block_is_read_whole():
    text = "alpha beta gamma delta " * 200_000
    h, at = shingles.words([text, "alpha", "x" * 5_000_000])
    assert np.diff(at).tolist() == [800_000, 1, 1] and len(set(h[:800_000].tolist())) == 4 and h[800_000] == h[0]


def test_batches_cover_all_texts():
    assert shingles.batches(["a" * 10, None, "b" * 10, "c"], 12) == [(0, 2), (2, 4)] and shingles.batches([]) == []
