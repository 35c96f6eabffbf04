"""Depth maps as 12-bit levels: quantise and dequantise, in float32 arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..errors import DatasetError

LEVELS = np.float32(4095)


@dataclass(frozen=True)
class Depth:
    """A quantiser: depths in metres from least to most; log spreads the levels over log(depth + shift)."""

    least: float = 0.01
    most: float = 10.0
    shift: float = 3.5
    log: bool = True
    clip: bool = True

    def scale(self) -> tuple[float, float]:
        """(step, first) of the level line, in metres or in their logarithm."""
        low, high = (math.log(self.least + self.shift), math.log(self.most + self.shift)) if self.log else (self.least, self.most)
        return (high - low) / 4095.0, low

    def valid(self) -> bool:
        """Whether the bounds are finite, ordered and of use in float32."""
        if not all(map(math.isfinite, (self.least, self.most, self.shift))):
            return False
        with np.errstate(over="ignore"):
            least, most, shift = (np.float32(x) for x in (self.least, self.most, self.shift))
        if not (np.isfinite([least, most, shift]).all() and least < most):
            return False
        if self.log and not (self.least + self.shift > 0 and self.most + self.shift > self.least + self.shift and math.isfinite(self.most + self.shift)):
            return False
        step, first = self.scale()
        with np.errstate(over="ignore"):
            return bool(np.isfinite(np.float32(step)) and np.float32(step) > 0 and np.isfinite(np.float32(first)))


def quantize(depth: np.ndarray, how: Depth, millimetres: bool) -> np.ndarray:
    """Levels 0 to 4095 of depths in metres or millimetres."""
    depth, unit = depth.astype(np.float32), 1000.0 if millimetres else 1.0
    low, high, shift = (np.float32(x * unit) for x in (how.least, how.most, how.shift))
    if not np.isfinite(depth).all():
        raise DatasetError("depth frames require finite values")
    if not how.clip and ((depth < low) | (depth > high)).any():
        raise DatasetError("depth value is outside DEPTH_MIN/DEPTH_MAX with DEPTH_CLIP=false")
    if how.log:
        if not (depth + shift > 0).all():
            raise DatasetError("logarithmic depth values require depth + DEPTH_SHIFT > 0")
        first, last = math.log(float(low + shift)), math.log(float(high + shift))
        at = np.log((depth + shift).astype(np.float64)).astype(np.float32)
        part = (at - np.float32(first)) / np.float32(last - first)
    else:
        part = (depth - low) / (high - low)
    return np.rint(np.clip(part, np.float32(0), np.float32(1)) * LEVELS).astype(np.uint16)


def dequantize(levels: np.ndarray, how: Depth, unit: str = "mm") -> np.ndarray:
    """Depths of levels: uint16 millimetres (half to even, at most 65535), or float32 metres."""
    if unit not in ("m", "mm"):
        raise DatasetError("depth_output_unit must be 'm' or 'mm'")
    step, first = how.scale()
    depth = levels.astype(np.float32) * np.float32(step) + np.float32(first)
    if how.log:
        depth = np.exp(depth) - np.float32(how.shift)
    depth = np.clip(depth, np.float32(how.least), np.float32(how.most))
    if unit == "m":
        return depth
    return np.clip(np.rint(depth * np.float32(1000)), 0, 65535).astype(np.uint16)
