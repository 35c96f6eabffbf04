"""Pixel helpers: nearest resize, frame sampling, raw frame types."""

from __future__ import annotations

import numpy as np

from ..errors import DatasetError


def resize_indices(source: int, target: int) -> np.ndarray:
    """The source index of each target index, by steps that are summed up from half a step in double."""
    step = float(np.float32(source)) / target
    at = np.add.accumulate(np.concatenate([[step * 0.5], np.full(target - 1, step)]))
    return np.minimum(source - 1, at.astype(np.int64))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return image[resize_indices(image.shape[0], height)][:, resize_indices(image.shape[1], width)]


def sample_frames(n: int) -> np.ndarray:
    """The frames of an episode of n that visual statistics look at."""
    count = max(min(100, n), min(int(n**0.75), 10_000))
    if count <= 1:
        return np.zeros(count, np.int64)
    at = np.rint(np.arange(count) * ((n - 1) / (count - 1))).astype(np.int64)
    at[-1] = n - 1
    return at


def sample_stride(width: int, height: int) -> int:
    """The distance of the pixels of a frame that visual statistics look at."""
    longest = max(width, height)
    return max(1, longest // 150) if longest >= 300 else 1


def raw_type(size: int, height: int, width: int, depth: bool) -> np.dtype:
    """The type of a raw frame of so many bytes: RGB bytes, uint16 millimetres or float32 metres."""
    pixels = height * width
    kinds = {2 * pixels: np.dtype("<u2"), 4 * pixels: np.dtype("<f4")} if depth else {3 * pixels: np.dtype("u1")}
    if size not in kinds:
        raise DatasetError(f"raw frame has {size} bytes; expected {' or '.join(map(str, kinds))}")
    return kinds[size]
