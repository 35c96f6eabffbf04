"""Video codecs as plug-ins. None for compressed video comes with the engine; a plain container does.

A codec opens a local media file and gives its frames' times and pixels, and writes such files. An
application registers codecs by file suffix; metadata columns never open a file. Workers register
what they need through a codec's module (see register()).
"""

from __future__ import annotations

import importlib
import struct
from typing import Protocol

import numpy as np

from ..errors import DatasetError


class Video(Protocol):
    def times(self) -> np.ndarray: ...

    def frame(self, index: int) -> np.ndarray: ...

    def close(self) -> None: ...


class Codec(Protocol):
    name: str
    pixel_format: str

    def open(self, path: str) -> Video: ...

    def write(self, path: str, frames: list[np.ndarray], times: list[float]) -> None: ...


_codecs: dict[str, str] = {".raw": f"{__name__}:PlainCodec"}


def register(suffix: str, place: str) -> None:
    """Use the codec class at place ('module:Class') for files that end in suffix."""
    _codecs[suffix] = place


def known() -> dict[str, str]:
    return dict(_codecs)


def codec_for(path: str, places: dict[str, str] | None = None) -> Codec:
    for suffix, place in (places or _codecs).items():
        if path.endswith(suffix):
            module, _, name = place.partition(":")
            return getattr(importlib.import_module(module), name)()
    raise DatasetError(f"no codec is registered for video '{path}'; register one, or select metadata columns only")


_HEAD = struct.Struct("<8sIIIIq")
_MAGIC = b"FSPLAIN1"


class PlainCodec:
    """Frames one after the other without compression, their times in front."""

    name, pixel_format = "plain", "raw"

    def open(self, path: str) -> Video:
        return _Plain(path)

    def write(self, path: str, frames: list[np.ndarray], times: list[float]) -> None:
        shape = (*frames[0].shape, 1)[:3]
        with open(path, "wb") as f:
            f.write(_HEAD.pack(_MAGIC, *shape, frames[0].dtype.itemsize, len(frames)))
            f.write(np.asarray(times, "<f8").tobytes())
            for x in frames:
                f.write(np.ascontiguousarray(x).tobytes())


class _Plain:
    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        magic, h, w, c, size, n = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != _MAGIC:
            raise DatasetError(f"'{path}' is not a plain video")
        self.shape, self.kind = (h, w, c), np.dtype(f"<u{size}")
        self._times = np.frombuffer(self.file.read(8 * n), "<f8")
        self.at = _HEAD.size + 8 * n

    def times(self) -> np.ndarray:
        return self._times

    def frame(self, index: int) -> np.ndarray:
        n = int(np.prod(self.shape)) * self.kind.itemsize
        self.file.seek(self.at + index * n)
        return np.frombuffer(self.file.read(n), self.kind).reshape(self.shape)

    def close(self) -> None:
        self.file.close()
