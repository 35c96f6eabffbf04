"""Exact per-episode statistics and their merge: NumPy arithmetic in the feature's own precision.

Each dimension of a feature is one contiguous column; sums are NumPy's pairwise sums of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import DatasetError

BINS = 5000
QUANTILES = {"q01": 0.01, "q10": 0.10, "q50": 0.50, "q90": 0.90, "q99": 0.99}
LOWEST = ("min", "q01", "q10", "q50")
SINGLE = {"float32", "int8", "int16", "uint8", "uint16", "bool", "image", "video"}
NAN = "numeric features cannot contain NaN or infinity"


def arithmetic(dtype: str) -> type:
    return np.float32 if dtype in SINGLE else np.float64


@dataclass
class Stats:
    """Statistics of a feature's dimensions, as float64; exact extrema as Python ints for integers."""

    count: int
    values: dict[str, np.ndarray]
    exact: dict[str, list[int]] | None = None
    single: bool = False

    def extreme(self, name: str) -> list:
        return self.exact[name] if self.exact else self.values[name].tolist()


def quantiles(x: np.ndarray, low, high) -> tuple[dict[str, float], set[str]]:
    """Quantiles of one dimension by a histogram of BINS bins from low to high; those that were interpolated."""
    kind = x.dtype.type
    low, high = low - kind(1e-10), high + kind(1e-10)
    step = (high - low) / kind(BINS)
    edges = np.arange(BINS + 1).astype(kind) * step + low
    edges[-1] = high
    at = np.clip(np.searchsorted(edges, x, "right") - 1, 0, BINS - 1)
    count = np.bincount(at, minlength=BINS)
    total = np.cumsum(count)
    out, between = {}, set()
    for name, q in QUANTILES.items():
        want = q * float(len(x))
        b = int(np.searchsorted(total, want, "left"))
        if b >= BINS:
            out[name] = float(edges[-1])
        elif b == 0 or count[b] == 0:
            out[name] = float(edges[b])
        else:
            part = (want - float(total[b] - count[b])) / float(count[b])
            out[name] = float(edges[b]) + part * float(edges[b + 1] - edges[b])
            between.add(name)
    return out, between


def episode(columns: np.ndarray, dtype: str, exact: np.ndarray | None = None) -> Stats:
    """Statistics of columns (dimensions x values). exact: the integers themselves, where that matters."""
    kind = arithmetic(dtype)
    x = np.ascontiguousarray(columns.astype(kind))
    width, n = x.shape
    if not np.isfinite(x).all():
        raise DatasetError(NAN)
    held = None
    if exact is not None:
        held = {"min": [int(v) for v in exact.min(1)], "max": [int(v) for v in exact.max(1)]}
    values = {s: np.zeros(width) for s in ("min", "max", "mean", "std", *QUANTILES)}
    for d in range(width):
        own = x[d]
        if n == 1:
            for s in values:
                values[s][d] = 0.0 if s == "std" else float(own[0])
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            total, squares = np.add.reduce(own), np.add.reduce(own * own)
            mean = total / kind(n)
            spread = np.sqrt(np.maximum(kind(0), squares / kind(n) - mean * mean))
        low, high = own.min(), own.max()
        for s, v in (("min", low), ("max", high), ("mean", mean), ("std", spread)):
            values[s][d] = float(v)
        for s, v in quantiles(own, low, high)[0].items():
            values[s][d] = v
    return Stats(n, values, held, kind is np.float32)


def visual(samples: np.ndarray, is_depth: bool) -> Stats:
    """Statistics of channels x sampled pixels; RGB is divided by 255 afterwards."""
    out = episode(samples, "image")
    if is_depth:
        return out
    x = samples.astype(np.float32)
    scale = np.float32(255)
    for s in ("min", "max", "mean", "std"):
        out.values[s] = (out.values[s].astype(np.float32) / scale).astype(np.float64)
    # A quantile that is interpolated in any channel is float64 in all, which decides how it is divided.
    between = set() if x.shape[1] == 1 else set().union(*(quantiles(np.ascontiguousarray(c), c.min(), c.max())[1] for c in x))
    for s in QUANTILES:
        out.values[s] = out.values[s] / 255.0 if s in between else (out.values[s].astype(np.float32) / scale).astype(np.float64)
    return out


def merge(a: Stats, b: Stats, first: bool = False) -> Stats:
    """Statistics of two parts together; b is an episode's. first: whether a is one too, not yet a merge."""
    n = a.count + b.count
    mean = (a.values["mean"] * a.count + b.values["mean"] * b.count) / n

    def variance(s: Stats, own: bool) -> np.ndarray:
        std = s.values["std"]
        return (std.astype(np.float32) ** 2).astype(np.float64) if own and s.single else std * std

    spread = sum(s.count * (variance(s, own) + (s.values["mean"] - mean) ** 2) for s, own in ((a, first), (b, True))) / n
    values = {s: np.minimum(a.values[s], b.values[s]) if s in LOWEST else np.maximum(a.values[s], b.values[s]) for s in a.values}
    values |= {"mean": mean, "std": np.sqrt(spread)}
    exact = {"min": [min(p) for p in zip(a.exact["min"], b.exact["min"], strict=True)], "max": [max(p) for p in zip(a.exact["max"], b.exact["max"], strict=True)]} if a.exact and b.exact else None
    return Stats(n, values, exact, a.single)


def merge_all(parts: list[Stats]) -> Stats:
    """Statistics of episodes, merged one by one in their order."""
    out, first = parts[0], True
    for p in parts[1:]:
        out, first = merge(out, p, first), False
    return out
