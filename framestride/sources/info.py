"""The dataset's info document: parsing, validation and the schemas that it implies."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import DatasetError
from ..functions.depth import Depth
from . import paths

# Scalar types by dtype. Spark has no unsigned types, so they are read one size wider.
SCALARS = {
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "bool": T.BooleanType(),
    "string": T.StringType(),
}
VISUAL = ("image", "video")
STATS = ("min", "max", "mean", "std", "count", "q01", "q10", "q50", "q90", "q99")
GENERATED = {"timestamp": "float32", "frame_index": "int64", "episode_index": "int64", "index": "int64", "task_index": "int64"}
IMAGE = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
REQUIRED = ("codebase_version", "data_path", "fps", "total_episodes", "total_frames", "total_tasks")
QUANTIZER = ("video.depth_min", "video.depth_max", "video.shift", "video.use_log", "video.pix_fmt")
DEPTH_FORMAT = "gray12le"
TABLE_FORMAT = "lance"


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    shape: tuple[int, ...] = ()
    is_depth: bool = False
    depth: Depth | None = None
    names: object = None

    @property
    def visual(self) -> bool:
        return self.dtype in VISUAL

    @property
    def width(self) -> int:
        return 3 if self.visual and not self.is_depth else 1 if self.visual else math.prod(self.shape)

    def spark_type(self) -> T.DataType:
        """The column's type in frames: nested lists, or a bare value where the shape is [1]."""
        if self.dtype == "image":
            return IMAGE
        if self.dtype not in SCALARS:
            raise DatasetError(f"feature '{self.name}' has unsupported dtype '{self.dtype}'")
        return nested(SCALARS[self.dtype], 0 if self.shape == (1,) else len(self.shape))

    def stat_type(self, stat: str) -> T.DataType:
        if stat == "count":
            return T.ArrayType(T.LongType())
        leaf: T.DataType = T.DoubleType()
        if stat in ("min", "max") and self.dtype.startswith(("int", "uint")):
            leaf = T.DecimalType(20, 0) if self.dtype == "uint64" else T.LongType()
        return nested(leaf, 3 if self.visual else len(self.shape))


def nested(leaf: T.DataType, times: int) -> T.DataType:
    for _ in range(times):
        leaf = T.ArrayType(leaf)
    return leaf


@dataclass(frozen=True)
class Info:
    version: str
    data_path: str
    video_path: str | None
    fps: int
    episodes: int
    frames: int
    tasks: int
    features: tuple[Feature, ...] = ()
    storage: str | None = None
    raw: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def videos(self) -> list[Feature]:
        return sorted((f for f in self.features if f.dtype == "video"), key=lambda f: f.name.encode())

    def video(self, key: str) -> Feature:
        for f in self.features:
            if f.dtype == "video" and f.name == key:
                return f
        raise DatasetError(f"Unknown video key '{key}'")

    @property
    def in_table(self) -> bool:
        return self.storage == TABLE_FORMAT

    def frame_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.features if f.dtype != "video"])

    def episode_schema(self) -> T.StructType:
        return episode_schema(self.features)


def episode_schema(features: tuple[Feature, ...] | list[Feature]) -> T.StructType:
    """The episode table's columns: lengths and routes, then video routes, then statistics."""
    long, double = T.LongType(), T.DoubleType()
    out = [("episode_index", long), ("tasks", T.ArrayType(T.StringType())), ("length", long), ("data/chunk_index", long), ("data/file_index", long), ("dataset_from_index", long), ("dataset_to_index", long)]
    for f in features:
        if f.dtype == "video":
            out += [(f"videos/{f.name}/{c}", long if c.endswith("index") else double) for c in ("chunk_index", "file_index", "from_timestamp", "to_timestamp")]
    for f in features:
        if f.dtype != "string":
            out += [(f"stats/{f.name}/{s}", f.stat_type(s)) for s in STATS]
    out += [("meta/episodes/chunk_index", long), ("meta/episodes/file_index", long)]
    return T.StructType([T.StructField(n, t) for n, t in out])


def _unique(pairs: list[tuple[str, object]]) -> dict:
    seen: dict[str, object] = {}
    for k, v in pairs:
        if k in seen:
            raise DatasetError(f"Duplicate feature key or field '{k}' in info.json")
        seen[k] = v
    return seen


def _integer(value: object, what: str) -> int:
    if isinstance(value, str) and value.strip().lstrip("+-").isdigit():
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int | float) or int(value) != value:
        raise DatasetError(f"info.json {what} must be an integer")
    return int(value)


def parse_feature(name: str, told: dict, depth_videos: bool = True) -> Feature:
    """One entry of the features map."""
    paths.feature_name(name)
    if not isinstance(told, dict) or not isinstance(told.get("dtype"), str):
        raise DatasetError("Each feature requires a non-NULL dtype field")
    shape = told.get("shape") or ()
    if not isinstance(shape, list | tuple):
        raise DatasetError(f"feature '{name}' shape must be a list")
    for d in shape:
        if isinstance(d, bool) or not isinstance(d, int) or d <= 0:
            raise DatasetError(f"feature '{name}' shape dimensions must be positive")
    shape = tuple(shape)
    about, older = told.get("info") or {}, told.get("video_info") or {}
    is_depth = about.get("is_depth_map") is True
    depth = None
    if told["dtype"] == "video" and depth_videos:
        for marker in (about.get("video.is_depth_map"), older.get("video.is_depth_map")):
            if marker not in (None, False, "false"):
                raise DatasetError(f"video feature '{name}' uses a legacy depth marker; use info.is_depth_map instead")
        values = [about.get(k) for k in QUANTIZER]
        if is_depth:
            if any(v is None for v in values) or len(shape) != 3:
                raise DatasetError(f"depth video feature '{name}' requires {', '.join(QUANTIZER)}, and a channel dimension")
            depth = Depth(float(values[0]), float(values[1]), float(values[2]), values[3] in (True, "true"))
            if not (depth.least < depth.most and depth.valid()):
                raise DatasetError(f"depth video feature '{name}' has invalid quantization parameters")
            if values[4] != DEPTH_FORMAT:
                raise DatasetError(f"depth video feature '{name}' requires video.pix_fmt '{DEPTH_FORMAT}'")
            if shape[2] != 1:
                raise DatasetError(f"depth video feature '{name}' requires exactly one channel")
        elif any(v is not None for v in values[:4]) or values[4] == DEPTH_FORMAT or (len(shape) == 3 and shape[2] == 1):
            raise DatasetError(f"video feature '{name}' uses depth-only metadata but info.is_depth_map is not true")
    return Feature(name, told["dtype"], shape, is_depth, depth, told.get("names"))


def check_shapes(features: tuple[Feature, ...] | list[Feature]) -> None:
    """The rules that hold wherever the features are the schema: writers and datasets without frames."""
    if not features:
        raise DatasetError("info.json features must not be empty")
    for f in features:
        if not 1 <= len(f.shape) <= 5:
            raise DatasetError(f"feature '{f.name}' requires a shape with one to five dimensions")
        if f.is_depth and not f.visual:
            raise DatasetError(f"feature '{f.name}' marks is_depth_map but is not visual")
        if f.visual and len(f.shape) != 3:
            raise DatasetError(f"visual feature '{f.name}' requires a three-dimensional HWC shape")
        if f.visual and f.shape[2] != (1 if f.is_depth else 3):
            raise DatasetError(f"visual feature '{f.name}' requires {1 if f.is_depth else 3} HWC channel(s)")
        if f.dtype != "video":
            f.spark_type()


def parse(text: str) -> Info:
    """Read and check an info document. Duplicate keys, old versions and unfit totals are errors."""
    try:
        told = json.loads(text, object_pairs_hook=_unique)
    except json.JSONDecodeError as e:
        what = "must contain exactly one metadata record" if e.msg == "Extra data" else "is not valid JSON"
        raise DatasetError(f"info.json {what}") from e
    if not isinstance(told, dict):
        raise DatasetError("info.json must contain exactly one metadata record")
    storage = told.get("storage_format")
    if storage is not None and not (isinstance(storage, str) and storage.isidentifier() and storage == storage.lower()):
        raise DatasetError(f"Unsupported storage_format '{storage}'")
    if any(told.get(k) is None for k in REQUIRED):
        raise DatasetError(f"info.json requires non-NULL {', '.join(REQUIRED)} fields")
    version, data_path = str(told["codebase_version"]), str(told["data_path"])
    if not version or not data_path:
        raise DatasetError("info.json codebase_version and data_path fields must not be empty")
    if version not in ("v3", "3") and not version.startswith(("v3.", "3.")):
        raise DatasetError(f"route pruning requires a v3 dataset, found codebase_version '{version}'")
    fps, episodes, frames, tasks = (_integer(told[k], k) for k in REQUIRED[2:])
    if fps <= 0:
        raise DatasetError("info.json fps must be positive")
    if min(episodes, frames, tasks) < 0:
        raise DatasetError("info.json total counts must be non-negative")
    if (episodes == 0) != (frames == 0):
        raise DatasetError("info.json total_episodes and total_frames must either both be zero or both be positive")
    features = [parse_feature(k, v) for k, v in (told.get("features") or {}).items()]
    seen = set()
    for f in features:
        if f.name.lower() in seen:
            raise DatasetError(f"Duplicate {'video ' if f.dtype == 'video' else ''}feature key '{f.name}' in info.json")
        seen.add(f.name.lower())
    info = Info(version, data_path, told.get("video_path"), fps, episodes, frames, tasks, tuple(features), storage, told)
    if info.videos and not info.video_path:
        raise DatasetError("info.json requires video_path when video features are present")
    if not episodes:
        check_shapes(info.features)
    if info.in_table:
        table_names(info)
    return info


def table_names(info: Info) -> dict[str, str]:
    """The column of each feature in a table format whose names have no dots."""
    out: dict[str, str] = {}
    for f in info.features:
        if f.dtype != "video":
            if (n := f.name.replace(".", "_")).lower() in {x.lower() for x in out.values()}:
                raise DatasetError(f"feature names collide after replacing '.' with '_': '{f.name}'")
            out[f.name] = n
    return out
