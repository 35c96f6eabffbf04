"""Words and word shingles of many texts at once, as 64-bit hashes in NumPy arrays.

A word is a run of letters, digits or characters outside ASCII, in lower case. All arithmetic is on
the UTF-8 bytes of a batch of texts; texts are worked through in blocks of about BLOCK bytes, cut
between words, so that one very long text needs no more memory than many short ones.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18
SHINGLE = 5

_U = np.uint64
_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _WORD[list(_r)] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash's base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 4096)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)])) for b in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def _block(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words in raw."""
    flag = np.zeros(len(raw) + 2, np.int8)
    flag[1:-1] = _WORD[raw]
    turn = np.diff(flag)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]; null is empty."""
    parts = [b"" if t is None else t.lower().encode("utf-8", "replace") for t in texts]
    size = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    begin = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    out, at, place = [], 0, []
    while at < len(raw):
        to = min(len(raw), at + BLOCK)
        while to < len(raw) and _WORD[raw[to - 1]]:
            near = np.flatnonzero(~_WORD[raw[to : to + BLOCK]])
            to = to + int(near[0]) + 1 if len(near) else min(len(raw), to + BLOCK)
        h, s = _block(raw[at:to])
        out.append(h)
        place.append(s + at)
        at = to
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    starts = np.concatenate(place) if place else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, begin)


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the runs of size words; a text of 1 to size - 1 words has one run, of all."""
    h, at = words(texts)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    wide = np.concatenate([h, np.zeros(size, np.uint64)])
    short = np.flatnonzero((n > 0) & (n < size))
    total = np.zeros(len(first), np.uint64)
    for j in range(size):
        total += mix(wide[first + j] + _U(j)) * _STEP[j]
    for i in short:
        own = h[at[i] : at[i + 1]]
        total[to[i]] = sum(int(mix(own[j : j + 1] + _U(j))[0]) * int(_STEP[j]) for j in range(len(own))) & 0xFFFFFFFFFFFFFFFF
    return mix(total), to


def batches(texts: list[str | None], limit: int = BLOCK) -> list[tuple[int, int]]:
    """Slices of texts of about limit characters, one text at least."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            out.append((at, i + 1))
            at, size = i + 1, 0
    return out + ([(at, len(texts))] if at < len(texts) else [])
