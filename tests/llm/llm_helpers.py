"""Brute force that several tests share."""

import itertools
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from framestride.llm import line_dedup, near_dedup, packing


def brute_classes(rows):
    """Classes by all pairs of distinct texts."""
    texts = sorted({t for _, t in rows if t is not None})
    h, w, at = near_dedup.weighted(texts)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = slice(at[i], at[i + 1]), slice(at[j], at[j + 1])
        if near_dedup.prob_jaccard(h[a], w[a], h[b], w[b]) >= 0.8 - 1e-12:
            x, y = find(texts[i]), find(texts[j])
            root[max(x, y)] = min(x, y)
    least = {}
    for d, t in rows:
        if t is not None:
            least[find(t)] = min(d, least.get(find(t), d))
    return sorted((d, d if t is None else least[find(t)]) for d, t in rows)


LEAST, LINE = line_dedup.LEAST, line_dedup.LINE


def runs(lines):
    """The shortest run of 50 words or more from each line that has a word: (from, to, lines)."""
    words = [len(x.split()) for x in lines]
    for i in range(len(lines)):
        n = 0
        for j in range(i, len(lines)):
            n += words[j]
            if words[i] and n >= LEAST:
                yield i, j + 1, tuple(lines[i : j + 1])
                break


def brute_repeats(rows):
    """Per document (lines that must go, lines that may go), by sets of lines and lists of runs, without any alignment.

    Whole lines of LINE words or more go by membership alone; shorter ones may go with their neighbours.
    """
    owner, out, texts = {}, {}, {}
    for d, text in rows:
        lines = text.split("\n")
        texts[d], must, may = lines, set(), set()
        n = lambda x: len(x.split())
        share = {}
        for x in set(lines):
            if n(x) >= LINE and x in owner:
                share[owner[x]] = share.get(owner[x], 0) + min(LEAST, n(x) * lines.count(x))
        for run in {r for _, _, r in runs(lines)}:
            if run in owner:
                share[owner[run]] = share.get(owner[run], 0) + LEAST
        for early in (e for e, words in share.items() if words >= LEAST):
            have, ran = set(texts[early]), {r for _, _, r in runs(texts[early])}
            sure = {i for i, x in enumerate(lines) if n(x) >= LINE and x in have} | {k for i, j, r in runs(lines) if r in ran for k in range(i, j)}
            any_ = {i for i, x in enumerate(lines) if x in have}
            if sum(n(lines[i]) for i in sure) >= LEAST:
                must |= sure
            if sum(n(lines[i]) for i in any_) >= LEAST:
                may |= any_
        out[d] = must, may
        for key in [*(x for x in lines if n(x) >= LINE), *(r for _, _, r in runs(lines))]:
            owner.setdefault(key, d)
    return out


def check_packed(docs, got):
    """Pieces cover each document's ids, as the library gives them, and fill windows without gaps."""
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for r in docs:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    windows = {}
    for p in got:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SIZE
