"""Writing a dataset: generated columns, exact statistics, shards and metadata, published by one rename.

Frames get their generated columns from window and join expressions. One Arrow pass computes each
episode's statistics and encoded size into a table; a task that reads its small columns in episode
order plans the shards, and a task a feature merges its statistics in that order. A second pass
writes the shards, each in one task, and another the files of episode metadata. The driver gets one
row a feature. An episode must fit a worker's memory, as must a video shard.
"""

from __future__ import annotations

import json
import math
import os
import pickle
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError
from ..functions.depth import Depth, quantize
from ..functions.images import encode_raw
from ..functions.pixels import raw_type, sample_frames, sample_stride
from ..operators import codecs
from ..operators import stats as exact
from ..scratch import kept, ranked
from . import info as meta
from .dataset import col, first_seen

# The layout of a written dataset.
VERSION = "v3.0"
DATA_PATH = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
EPISODE_PATH = "meta/episodes/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
VIDEO_PATH = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}"
VIDEO_CODECS = ("libsvtav1", "libaom-av1")
RESERVED = ("task", *meta.GENERATED)

_ARROW = {
    "float32": pa.float32(), "float64": pa.float64(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(),
    "uint8": pa.uint8(), "uint16": pa.uint16(), "uint32": pa.uint32(), "uint64": pa.uint64(), "bool": pa.bool_(), "string": pa.string(),
}
IMAGE = pa.struct([("bytes", pa.binary()), ("path", pa.string())])
VALUES = ("min", "max", "mean", "std", *exact.QUANTILES)
#: What is measured of an episode: bytes of its frames in Parquet, its tasks as they come, the raw types of visual features, the bytes of videos, the statistics of features.
MEASURED = pa.schema([("episode_index", pa.int64()), ("bytes", pa.int64()), ("tasks", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("stats", pa.list_(pa.binary()))])
#: Stored bytes of a task that writes shards, about, if these are no larger; and rows of a row group of tasks.
TASK_BYTES, TASK_ROWS = 32 << 20, 100_000


@dataclass(frozen=True, kw_only=True)
class Options:
    fps: int | None = None
    robot_type: str | None = None
    chunks_size: int = 1000
    data_files_size_in_mb: float = 100.0
    video_files_size_in_mb: float = 200.0
    metadata_buffer_size: int = 10
    max_visual_frame_bytes: int = 64 << 20
    video_workers: int = 4
    encoder_threads: int = 4
    rgb_codec: str | None = None
    rgb_crf: float = 30
    rgb_gop: float = 2
    depth_min: float = 0.01
    depth_max: float = 10.0
    depth_shift: float = 3.5
    depth_use_log: bool = True
    depth_clip: bool = True
    suffix: str = ".mp4"

    def __post_init__(self):
        if self.fps is None:
            raise DatasetError("writing requires the FPS option")
        whole = [("fps", 1, 1 << 62), ("chunks_size", 1, 1 << 62), ("metadata_buffer_size", 1, 1 << 62), ("max_visual_frame_bytes", 1, 1 << 62), ("video_workers", 1, 1024), ("encoder_threads", 1, 1024), ("rgb_crf", 0, 63), ("rgb_gop", 1, 2**31 - 1)]
        for name, low, high in whole:
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or value != int(value) or not low <= value <= high:
                raise DatasetError(f"{name.upper()} must be an integer between {low} and {high}")
        for name in ("data_files_size_in_mb", "video_files_size_in_mb"):
            value = getattr(self, name)
            if not isinstance(value, int | float) or not math.isfinite(value) or value <= 0:
                raise DatasetError(f"{name.upper()} must be finite and positive")
        if self.rgb_codec is not None and self.rgb_codec not in (*VIDEO_CODECS, "plain"):
            raise DatasetError(f"RGB_CODEC must be one of {', '.join(VIDEO_CODECS)}")
        if not all(isinstance(x, int | float) and math.isfinite(x) for x in (self.depth_min, self.depth_max, self.depth_shift)) or not 0 <= self.depth_min < self.depth_max:
            raise DatasetError("DEPTH_MIN and DEPTH_MAX must be finite, 0 <= DEPTH_MIN < DEPTH_MAX")
        metres = self.depth
        for unit in (1.0, 1000.0):
            if not Depth(metres.least * unit, metres.most * unit, metres.shift * unit, metres.log).valid():
                raise DatasetError("DEPTH_MIN, DEPTH_MAX and DEPTH_SHIFT do not make a float32 scale")

    @property
    def depth(self) -> Depth:
        return Depth(self.depth_min, self.depth_max, self.depth_shift, self.depth_use_log, self.depth_clip)


def parse_features(told: str | dict) -> list[meta.Feature]:
    """The FEATURES option: a JSON object (or dict) of feature name to dtype, shape, names and info."""
    if isinstance(told, str):
        try:
            told = json.loads(told, object_pairs_hook=meta._unique)
        except json.JSONDecodeError as e:
            raise DatasetError("FEATURES must be a JSON object") from e
    if not isinstance(told, dict) or not told:
        raise DatasetError("FEATURES must be a JSON object with a feature at least")
    out, seen = [], set()
    for name, spec in told.items():
        f = meta.parse_feature(name, spec, depth_videos=False)
        if name.lower() in RESERVED:
            raise DatasetError(f"feature '{name}' is generated by the writer and must not be in FEATURES")
        if name.lower() in seen:
            raise DatasetError(f"Duplicate feature name '{name}'")
        seen.add(name.lower())
        out.append(f)
    meta.check_shapes(out)
    return out


def _input_type(f: meta.Feature) -> T.DataType:
    return T.BinaryType() if f.visual else f.spark_type()


def _plain(kind: T.DataType) -> str:
    return kind.simpleString()


def _matched(df: DataFrame, features: list[meta.Feature], order_by: list[str]) -> DataFrame:
    """df's columns by the features' names, in any case, of the features' types exactly."""
    want = {"episode_index": T.LongType(), "task": T.StringType(), **{f.name: _input_type(f) for f in features}}
    have = {c.lower(): c for c in df.columns}
    extra = [c for c in df.columns if c.lower() not in {w.lower() for w in want} and c not in order_by]
    if extra or any(w.lower() not in have for w in want):
        raise DatasetError(f"expected exactly episode_index, task, and {len(features)} user feature columns")
    for w, kind in want.items():
        found = df.schema[have[w.lower()]].dataType
        if _plain(found) != _plain(kind):
            raise DatasetError(f"column '{w}' has type {_plain(found)}; expected {_plain(kind)}")
    if missing := [c for c in order_by if c.lower() not in have]:
        raise DatasetError(f"order_by names no column: {', '.join(missing)}")
    return df.select(*(col(have[w.lower()]).alias(w) for w in want), *(col(have[c.lower()]).alias(f"_order{i}") for i, c in enumerate(order_by)))


@dataclass
class _Columns:
    """An episode's features as arrays: frames x dimensions, or lists of raw frames."""

    n: int
    values: dict[str, object] = field(default_factory=dict)


def flat(column: pa.Array, f: meta.Feature) -> np.ndarray:
    """frames x dimensions of a numeric or boolean column; lengths and nulls are checked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    depth = 0 if f.shape == (1,) else len(f.shape)
    for d in range(depth):
        if column.null_count:
            raise DatasetError("feature values must not be NULL")
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes != f.shape[d]).any():
            raise DatasetError(f"feature '{f.name}' has arrays of other lengths than its shape")
        column = column.flatten()
    if column.null_count:
        raise DatasetError("feature values must not be NULL")
    if pa.types.is_decimal(column.type):
        return np.array([int(v) for v in column.to_pylist()], np.uint64).reshape(n, -1)
    return column.to_numpy(zero_copy_only=False).reshape(n, -1)


def _raws(frames: list, f: meta.Feature, most: int) -> tuple[list[np.ndarray], np.dtype]:
    """Raw frames as height x width x channels, all of one type."""
    h, w, c = f.shape
    kinds = set()
    for b in frames:
        if b is None:
            raise DatasetError("feature values must not be NULL")
        if len(b) > most:
            raise DatasetError(f"raw frame has {len(b)} bytes, exceeding MAX_VISUAL_FRAME_BYTES")
        kinds.add(raw_type(len(b), h, w, f.is_depth))
    if len(kinds) > 1:
        raise DatasetError(f"feature '{f.name}' changes raw dtype within the dataset")
    kind = kinds.pop()
    return [np.frombuffer(b, kind).reshape(h, w, c) for b in frames], kind


def _nested(x: list, shape: tuple[int, ...]) -> list:
    out = list(x)
    for d in reversed(shape[1:]):
        out = [out[i : i + d] for i in range(0, len(out), d)]
    return out


def stats_dict(s: exact.Stats, f: meta.Feature) -> dict:
    shape = (f.width, 1, 1) if f.visual else f.shape
    out = {k: _nested(s.extreme(k) if k in ("min", "max") else s.values[k].tolist(), shape) for k in ("min", "max", "mean", "std")}
    return out | {"count": [s.count]} | {q: _nested(s.values[q].tolist(), shape) for q in exact.QUANTILES}


def _generated() -> list[meta.Feature]:
    return [meta.Feature(n, t, (1,)) for n, t in meta.GENERATED.items()]


def _episode_stats(table: pa.Table, features: list[meta.Feature], options: Options) -> tuple[dict[str, exact.Stats], dict[str, str], dict[str, int]]:
    """(statistics, raw types of visual features, bytes of video features) of one episode's frames."""
    out, raw, size = {}, {}, {}
    n = table.num_rows
    for f in features:
        column = table.column(f.name)
        if f.dtype == "string":
            if column.null_count:
                raise DatasetError("feature values must not be NULL")
            continue
        if f.visual:
            frames, kind = _raws(column.to_pylist(), f, options.max_visual_frame_bytes)
            step = sample_stride(f.shape[1], f.shape[0])
            picked = np.concatenate([frames[i][::step, ::step].reshape(-1, f.shape[2]) for i in sample_frames(n)])
            s = exact.visual(np.ascontiguousarray(picked.T), f.is_depth)
            s.count = len(sample_frames(n))
            out[f.name], raw[f.name] = s, kind.name
            if f.dtype == "video":
                size[f.name] = sum(x.nbytes if not f.is_depth else 2 * x.size for x in frames)
            continue
        values = flat(column, f)
        whole = np.ascontiguousarray(values.T) if f.dtype.startswith(("int", "uint")) else None
        out[f.name] = exact.episode(values.T, f.dtype, whole)
    for g in _generated():
        values = np.arange(n) / options.fps if g.name == "timestamp" else table.column(g.name).to_numpy()
        whole = values[None] if g.dtype == "int64" else None
        out[g.name] = exact.episode(values[None], "float64" if g.name == "timestamp" else g.dtype, whole)
    return out, raw, size


def _frame_schema(features: list[meta.Feature]) -> pa.Schema:
    fields = []
    for f in [*features, *_generated()]:
        if f.dtype == "video":
            continue
        kind = IMAGE if f.dtype == "image" else _ARROW[f.dtype]
        for _ in range(0 if f.dtype == "image" or f.shape == (1,) else len(f.shape)):
            kind = pa.list_(kind)
        fields.append(pa.field(f.name, kind))
    return pa.schema(fields).with_metadata({"huggingface": json.dumps({"info": {"features": {f.name: _hub(f) for f in [*features, *_generated()] if f.dtype != "video"}}})})


def _hub(f: meta.Feature) -> dict:
    if f.dtype == "image":
        return {"_type": "Image"}
    value = {"dtype": f.dtype, "_type": "Value"}
    if f.shape == (1,):
        return value
    if len(f.shape) == 1:
        return {"feature": value, "length": f.shape[0], "_type": "List"}
    return {"shape": list(f.shape), "dtype": f.dtype, "_type": f"Array{len(f.shape)}D"}


def _stored(table: pa.Table, features: list[meta.Feature], fps: int, schema: pa.Schema) -> pa.Table:
    """An episode's frames as they are stored: images encoded, timestamps as float32."""
    kinds = {f.name: f for f in features}
    columns = []
    for field_ in schema:
        name = field_.name
        if name == "timestamp":
            columns.append(pa.array((np.arange(table.num_rows) / fps).astype(np.float32)))
            continue
        column = table.column(name)
        f = kinds.get(name)
        if f is not None and f.dtype == "image":
            h, w, _ = f.shape
            suffix, frames = ("tiff" if f.is_depth else "png"), column.to_pylist()
            kind = raw_type(len(frames[0]), h, w, f.is_depth).name
            columns.append(pa.array([{"bytes": encode_raw(b, h, w, kind), "path": f"frame-{i:06d}.{suffix}"} for i, b in enumerate(frames)], IMAGE))
        else:
            columns.append(column.cast(field_.type))
    return pa.table(columns, schema=schema)


def _runs(parts: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each run of equal keys, in order."""
    held, now = [], None
    for part in parts:
        keys = part.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(keys[a])
            held.append(part.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _packed(s: exact.Stats) -> bytes:
    return pickle.dumps((s.count, np.stack([s.values[k] for k in VALUES]).tobytes(), s.exact, s.single))


def _unpacked(told: bytes) -> exact.Stats:
    count, values, whole, single = pickle.loads(told)
    return exact.Stats(count, dict(zip(VALUES, np.frombuffer(values).reshape(len(VALUES), -1), strict=True)), whole, single)


def _measure(features: list[meta.Feature], options: Options):
    visual = [f.name for f in features if f.visual]
    every, videos = [f.name for f in [*features, *_generated()]], [f.name for f in features if f.dtype == "video"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _frame_schema(features)
        for episode, table in _runs(parts, "episode_index"):
            found, raw, size = _episode_stats(table, features, options)
            sink = pa.BufferOutputStream()
            with pq.ParquetWriter(sink, schema, compression="snappy") as w:
                w.write_table(_stored(table, features, options.fps, schema))
            row = {
                "episode_index": episode, "bytes": sink.getvalue().size, "tasks": pc.unique(table.column("task_index")).to_pylist(), "kinds": [raw[n] for n in visual], "sizes": [size[n] for n in videos],
                "stats": [_packed(found[n]) if n in found else None for n in every],
            }
            yield pa.RecordBatch.from_pylist([row], MEASURED)

    return run


def _write_data(features: list[meta.Feature], options: Options, staging: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _frame_schema(features)
        names = [n for n in schema.names if n != "timestamp"]
        now, writer, draft, path, n = None, None, "", "", 0

        def close() -> pa.RecordBatch:
            writer.close()
            os.replace(draft, path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])

        for _, table in _runs(parts, "episode_index"):
            shard = table.column("_shard")[0].as_py()
            if shard != now:
                if writer is not None:
                    yield close()
                path = os.path.join(staging, _place(DATA_PATH, shard, options.chunks_size))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                draft = f"{path}.{uuid.uuid4().hex}"
                writer, now, n = pq.ParquetWriter(draft, schema, compression="snappy"), shard, 0
            writer.write_table(_stored(table.select(names), features, options.fps, schema), row_group_size=max(1, table.num_rows))
            n += table.num_rows
        if writer is not None:
            yield close()

    return run


def _write_video(f: meta.Feature, options: Options, staging: str, places: dict[str, str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in _runs(parts, "_shard"):
            frames, kind = _raws(table.column(f.name).to_pylist(), f, options.max_visual_frame_bytes)
            if f.is_depth:
                frames = [quantize(x, options.depth, kind.name == "uint16") for x in frames]
            path = os.path.join(staging, _place(VIDEO_PATH, shard, options.chunks_size, f.name) + options.suffix)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            draft = f"{path}.{uuid.uuid4().hex}"
            codecs.codec_for(path, places).write(draft, frames, [i / options.fps for i in range(len(frames))])
            os.replace(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(frames)], pa.int64())], ["path", "n"])

    return run


def _place(template: str, number: int, per_chunk: int, key: str = "") -> str:
    from .paths import expand

    return expand(template, number // per_chunk, number % per_chunk, key)


class ShardPlan:
    """The data shard of each episode, told one by one: a new one once the open one would pass the limit with the episode's share."""

    def __init__(self, limit: float):
        self.limit, self.now, self.size, self.frames = limit, 0, 0, 0

    def add(self, size: int, n: int) -> int:
        if self.frames and self.size >= self.limit / (1.0 + n / self.frames):
            self.now, self.size, self.frames = self.now + 1, 0, 0
        self.size, self.frames = self.size + size, self.frames + n
        return self.now


class SegmentPlan:
    """The video shard of each episode, told one by one: a new one where the sum would reach the limit."""

    def __init__(self, limit: float):
        self.limit, self.now, self.size, self.first = limit, 0, 0, True

    def add(self, size: int) -> int:
        if not self.first and self.size + size >= self.limit:
            self.now, self.size = self.now + 1, 0
        self.size, self.first = self.size + size, False
        return self.now


def shard_plan(sizes: list[int], lengths: list[int], limit: float) -> list[int]:
    """The data shard of each episode."""
    plan = ShardPlan(limit)
    return [plan.add(bytes_, n) for bytes_, n in zip(sizes, lengths, strict=True)]


def segment_plan(sizes: list[int], limit: float) -> list[int]:
    """The video shard of each episode."""
    plan = SegmentPlan(limit)
    return [plan.add(bytes_) for bytes_ in sizes]


def planned_shards(sized: DataFrame, limit: float) -> DataFrame:
    """(episode_index, shard) of sized (episode_index, bytes, length): one task takes them in order and holds a batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = ShardPlan(limit)
        for part in parts:
            shards = [plan.add(b, n) for b, n in zip(part.column("bytes").to_pylist(), part.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("episode_index"), pa.array(shards, pa.int64())], ["episode_index", "shard"])

    return _in_order(sized.select("episode_index", "bytes", "length")).mapInArrow(run, "episode_index bigint, shard bigint")


def _in_order(df: DataFrame, by: str = "episode_index") -> DataFrame:
    return df.repartition(1).sortWithinPartitions(by)


def _planned_segments(sized: DataFrame, n: int, limit: float) -> DataFrame:
    """(episode_index, segments, begins: of each of n videos) of sized (episode_index, sizes, length); begins count frames of the shard before."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, now, begin = [SegmentPlan(limit) for _ in range(n)], [0] * n, [0] * n
        for part in parts:
            segments, begins = [], []
            for sizes, length in zip(part.column("sizes").to_pylist(), part.column("length").to_pylist(), strict=True):
                got = [p.add(b) for p, b in zip(plans, sizes, strict=True)]
                begin = [b if s == t else 0 for b, s, t in zip(begin, got, now, strict=True)]
                segments.append(got)
                begins.append(begin)
                now, begin = got, [b + length for b in begin]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("episode_index"), pa.array(segments, kind), pa.array(begins, kind)], ["episode_index", "segments", "begins"])

    return _in_order(sized.select("episode_index", "sizes", "length")).mapInArrow(run, "episode_index bigint, segments array<bigint>, begins array<bigint>")


def generated_columns(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames with frame_index, index and task_index, episodes with length and first index, tasks).

    The episodes (one row each) and the tasks are kept as tables, which all that follows reads.
    """
    within = F.row_number().over(Window.partitionBy("episode_index").orderBy(*order)) - 1
    rows = rows.withColumn("frame_index", within.cast("bigint"))
    episodes = rows.groupBy("episode_index").agg(F.count("*").alias("length"))
    episodes = ranked(episodes, ["episode_index"], "episodes", "length").withColumn("dataset_from_index", F.col("_before")).drop("_rank", "_before")
    tasks = first_seen(rows.groupBy("task").agg(F.min(F.struct("episode_index", "frame_index")).alias("at")), "task", ["at"])
    rows = rows.join(episodes.select("episode_index", "dataset_from_index"), "episode_index").join(tasks, "task")
    return rows.withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).drop("dataset_from_index"), episodes, tasks


def write_dataset(df: DataFrame, root: str, *, features: str | dict, order_by: list[str] | str, **options) -> dict:
    """Write df (episode_index, task and the features, plus the columns of order_by) as a new dataset; its info.

    order_by orders the frames of an episode, since rows of a DataFrame have no order. The root must
    not exist and must be on a file system that all workers share.
    """
    own = Options(**options)
    listed = parse_features(features)
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    root = os.path.abspath(root.removeprefix("file://").rstrip("/"))
    if os.path.lexists(root):
        raise DatasetError(f"dataset root already exists: '{root}'")
    videos = [f for f in listed if f.dtype == "video"]
    spark = df.sparkSession
    rows = _matched(df, listed, order_by)
    nulls = F.max(F.greatest(*(F.col(c).isNull().cast("int") for c in ("episode_index", "task"))))
    found = rows.agg(nulls.alias("null"), F.min("episode_index").alias("a"), F.max("episode_index").alias("b"), F.count_distinct("episode_index").alias("n")).first()
    if found["null"]:
        raise DatasetError("episode_index and task must not contain NULL")
    if found["n"] and (found["a"] != 0 or found["b"] != found["n"] - 1):
        raise DatasetError("episodes must be contiguous and ordered from zero")
    if videos and found["n"]:
        _codec_or_error(videos, own)
    staging = f"{root}.tmp-{uuid.uuid4().hex}"
    try:
        os.makedirs(f"{staging}/meta")
        told = _write(spark, rows, listed, videos, [f"_order{i}" for i in range(len(order_by))], own, staging, found["n"])
        os.rename(staging, root)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return told


def _codec_or_error(videos: list[meta.Feature], own: Options) -> None:
    if own.rgb_codec == "plain" or own.suffix != ".mp4":
        codecs.codec_for(f"x{own.suffix}")
        return
    codecs.codec_for("x.mp4")


def _tasks(spark: SparkSession, pieces: int, bytes_: int) -> int:
    """Tasks that write some pieces of so many bytes in all: not one a piece, since these may be small."""
    return max(1, min(pieces, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-bytes_ // TASK_BYTES))))


def _write(spark, rows: DataFrame, listed, videos, order, own: Options, staging: str, n_episodes: int) -> dict:
    raw: dict[str, str] = {}
    n_frames, n_tasks = 0, 0
    if n_episodes:
        frames, episodes, task_table = generated_columns(rows, order)
        every = [*listed, *_generated()]
        columns = [*(col(f.name) for f in listed), "frame_index", "episode_index", "index", "task_index"]
        dealt = frames.select(*columns).repartition("episode_index").sortWithinPartitions("episode_index", "frame_index")
        measured = kept(dealt.mapInArrow(_measure(listed, own), "episode_index bigint, bytes bigint, tasks array<bigint>, kinds array<string>, sizes array<bigint>, stats array<binary>"), "measured")
        for i, f in enumerate(f for f in listed if f.visual):
            kinds = [r[0] for r in measured.select(F.get("kinds", F.lit(i))).distinct().limit(2).collect()]
            if len(kinds) > 1:
                raise DatasetError(f"feature '{f.name}' changes raw dtype within the dataset")
            raw[f.name] = kinds[0]
        sized = measured.select("episode_index", "bytes", "sizes").join(episodes, "episode_index")
        plan = kept(planned_shards(sized, own.data_files_size_in_mb * 1024 * 1024).withColumnRenamed("shard", "_shard"), "shards")
        n_shards = plan.agg(F.max("_shard")).first()[0] + 1
        size, n_frames = sized.agg(F.sum("bytes"), F.sum("length")).first()
        placed = frames.select(*columns).join(plan, "episode_index").repartition(_tasks(spark, n_shards, size), "_shard").sortWithinPartitions("_shard", "episode_index", "frame_index")
        wrote = placed.mapInArrow(_write_data(listed, own, staging), "path string, n bigint").agg(F.sum("n"), F.count("*")).first()
        if tuple(wrote) != (n_frames, n_shards):
            raise DatasetError("a data shard was not written in full")
        entries = sized.select("episode_index", "length", "dataset_from_index").join(plan, "episode_index").join(_task_names(measured, task_table), "episode_index")
        if videos:
            segments = kept(_planned_segments(sized, len(videos), own.video_files_size_in_mb * 1024 * 1024), "segments")
            entries = entries.join(segments, "episode_index")
        for i, f in enumerate(videos):
            at = segments.select("episode_index", F.get("segments", F.lit(i)).alias("_shard"))
            n, size = at.agg(F.max("_shard")).first()[0] + 1, sized.agg(F.sum(F.get("sizes", F.lit(i)))).first()[0]
            cut = frames.select("episode_index", "frame_index", col(f.name)).join(at, "episode_index").repartition(_tasks(spark, n, size), "_shard").sortWithinPartitions("_shard", "episode_index", "frame_index")
            wrote = cut.mapInArrow(_write_video(f, own, staging, codecs.known()), "path string, n bigint").agg(F.sum("n"), F.count("*")).first()
            if tuple(wrote) != (n_frames, n):
                raise DatasetError("a video shard was not written in full")
        _write_episodes(spark, entries.join(measured.select("episode_index", "stats"), "episode_index"), listed, videos, own, staging)
        n_tasks = _in_order(task_table, "task_index").mapInArrow(_write_tasks(staging), "n bigint").agg(F.sum("n")).first()[0]
        with open(f"{staging}/meta/stats.json", "w", encoding="utf-8") as out:
            out.write(_json(_totals(measured, every)))
    told = _info(listed, own, raw, n_episodes, n_frames, n_tasks)
    with open(f"{staging}/meta/info.json", "w", encoding="utf-8") as out:
        json.dump(told, out, allow_nan=False, ensure_ascii=False)
    return told


def _task_names(measured: DataFrame, tasks: DataFrame) -> DataFrame:
    """(episode_index, names: of its tasks, as they come)."""
    each = measured.select("episode_index", F.posexplode("tasks").alias("at", "task_index")).join(tasks, "task_index")
    return each.groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("at", "task"))).alias("names")).select("episode_index", F.col("names.task").alias("names"))


def _totals(measured: DataFrame, every: list[meta.Feature]) -> dict:
    """The statistics of all episodes: a task a feature merges them one by one in their order; the driver gets a row a feature."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first = None, None, True

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_packed(held)], pa.binary())], ["f", "s"])

        for part in parts:
            for f, s in zip(part.column("f").to_pylist(), part.column("s").to_pylist(), strict=True):
                own = _unpacked(s)
                if f == now:
                    held, first = exact.merge(held, own, first), False
                    continue
                if held is not None:
                    yield told()
                now, held, first = f, own, True
        if held is not None:
            yield told()

    each = measured.select("episode_index", F.posexplode("stats").alias("f", "s")).where("s is not null")
    merged = each.repartition(len(every), "f").sortWithinPartitions("f", "episode_index").mapInArrow(run, "f int, s binary").collect()
    return {every[r["f"]].name: stats_dict(_unpacked(bytes(r["s"])), every[r["f"]]) for r in sorted(merged, key=lambda r: r["f"])}


def _json(totals: dict) -> str:
    try:
        return json.dumps(totals, allow_nan=False, ensure_ascii=False)
    except ValueError as e:
        raise DatasetError("statistics cannot contain NaN or infinity") from e


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "decimal(20,0)": pa.uint64()}[kind.simpleString()]


PLACE = ("meta/episodes/chunk_index", "meta/episodes/file_index")


def _entries(part: pa.RecordBatch, features: list[meta.Feature], videos: list[meta.Feature], own: Options) -> list[dict]:
    """Rows of episode metadata, but for the place of their own file."""
    every, out = [*features, *_generated()], []
    for r in part.to_pylist():
        shard, begin = r["_shard"], r["dataset_from_index"]
        entry = {"episode_index": r["episode_index"], "tasks": r["names"], "length": r["length"], "data/chunk_index": shard // own.chunks_size, "data/file_index": shard % own.chunks_size, "dataset_from_index": begin, "dataset_to_index": begin + r["length"]}
        for i, f in enumerate(videos):
            s, at = r["segments"][i], r["begins"][i]
            entry |= {f"videos/{f.name}/chunk_index": s // own.chunks_size, f"videos/{f.name}/file_index": s % own.chunks_size, f"videos/{f.name}/from_timestamp": at / own.fps, f"videos/{f.name}/to_timestamp": (at + r["length"]) / own.fps}
        for f, s in zip(every, r["stats"], strict=True):
            if s is not None:
                entry |= {f"stats/{f.name}/{k}": v for k, v in stats_dict(_unpacked(s), f).items()}
        out.append(entry)
    return out


def _group_bytes(rows: list[dict], schema: pa.Schema) -> int:
    """What a row group adds to a file."""
    sink = pa.BufferOutputStream()
    with pq.ParquetWriter(sink, schema, compression="snappy") as w:
        before = sink.tell()
        w.write_table(pa.Table.from_pylist(rows, schema))
        return sink.tell() - before


def _write_episodes(spark: SparkSession, rows: DataFrame, features: list[meta.Feature], videos: list[meta.Feature], own: Options, staging: str) -> None:
    """Episode metadata in files that are rotated as data files are, a row group each flush of the buffer.

    The row groups are measured in parallel, one task deals them to files in their order, and the
    files are written in parallel.
    """
    schema = pa.schema([(f.name, _arrow(f.dataType)) for f in meta.episode_schema([*features, *_generated()])])
    bare, place = pa.schema([f for f in schema if f.name not in PLACE]), pa.schema([f for f in schema if f.name in PLACE])
    limit, step = own.data_files_size_in_mb * 1024 * 1024, own.metadata_buffer_size
    where = lambda number: dict(zip(PLACE, (number // own.chunks_size, number % own.chunks_size), strict=True))
    rows = rows.withColumn("_group", F.floor(F.col("episode_index") / step).cast("bigint"))

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in _runs(parts, "_group"):
            told = [e for p in table.to_batches() for e in _entries(p, features, videos, own)]
            yield pa.RecordBatch.from_pylist([{"_group": group, "n": len(told), "bytes": _group_bytes(told, bare)}], pa.schema([("_group", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64())]))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, n, more = 0, 4, 0, {}  # a file begins with four bytes
        for part in parts:
            out = []
            for rows_, bytes_ in zip(part.column("n").to_pylist(), part.column("bytes").to_pylist(), strict=True):
                if n and size >= limit / (1.0 + 1.0 / n):
                    number, size, n = number + 1, 4, 0
                if (number, rows_) not in more:
                    more = {(number, rows_): _group_bytes([where(number)] * rows_, place)}
                size, n = size + bytes_ + more[(number, rows_)], n + rows_
                out.append(number)
            yield pa.RecordBatch.from_arrays([part.column("_group"), pa.array(out, pa.int64())], ["_group", "_file"])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, draft, path, n = None, None, "", "", 0

        def close() -> pa.RecordBatch:
            writer.close()
            os.replace(draft, path)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        for _, table in _runs(parts, "_group"):
            file = table.column("_file")[0].as_py()
            if file != now:
                if writer is not None:
                    yield close()
                path = os.path.join(staging, _place(EPISODE_PATH, file, own.chunks_size))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                draft = f"{path}.{uuid.uuid4().hex}"
                writer, now, n = pq.ParquetWriter(draft, schema, compression="snappy"), file, 0
            told = [e | where(file) for p in table.to_batches() for e in _entries(p, features, videos, own)]
            writer.write_table(pa.Table.from_pylist(told, schema))
            n += len(told)
        if writer is not None:
            yield close()

    sized = rows.repartition("_group").sortWithinPartitions("_group", "episode_index").mapInArrow(measure, "_group bigint, n bigint, bytes bigint")
    dealt = kept(_in_order(sized, "_group").mapInArrow(deal, "_group bigint, _file bigint"), "episode-files")
    n_files, n_groups = dealt.agg(F.max("_file"), F.count("*")).first()
    n_files += 1
    placed = rows.join(dealt, "_group").repartition(_tasks(spark, n_files, n_groups * step * len(schema) * 16), "_file").sortWithinPartitions("_file", "_group", "episode_index")
    wrote = placed.mapInArrow(write, "n bigint").agg(F.count("*")).first()[0]
    if wrote != n_files:
        raise DatasetError("episode metadata were not written in full")


def _write_tasks(staging: str):
    column = lambda name, kind, numpy: {"name": name, "field_name": name, "pandas_type": kind, "numpy_type": numpy, "metadata": None}
    about = {
        "index_columns": ["task"],
        "column_indexes": [{"name": None, "field_name": None, "pandas_type": "unicode", "numpy_type": "object", "metadata": {"encoding": "UTF-8"}}],
        "columns": [column("task_index", "int64", "int64"), column("task", "unicode", "object")],
        "attributes": {},
    }
    schema = pa.schema([("task_index", pa.int64()), ("task", pa.string())]).with_metadata({"pandas": json.dumps(about)})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, n = f"{staging}/meta/tasks.parquet", [], 0
        draft = f"{path}.{uuid.uuid4().hex}"
        with pq.ParquetWriter(draft, schema) as w:

            def flush() -> int:
                table = pa.Table.from_batches(held).select(schema.names).combine_chunks()
                w.write_table(pa.table([c.cast(f.type) for c, f in zip(table.columns, schema, strict=True)], schema=schema))
                held.clear()
                return table.num_rows

            for part in parts:
                held.append(part)
                if sum(p.num_rows for p in held) >= TASK_ROWS:
                    n += flush()
            if held:
                n += flush()
        os.replace(draft, path)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def _quantizer(own: Options) -> dict:
    return {"video.depth_min": float(own.depth_min), "video.depth_max": float(own.depth_max), "video.shift": float(own.depth_shift), "video.use_log": own.depth_use_log}


def _visual_info(f: meta.Feature, own: Options, raw: str | None) -> dict | None:
    if not f.visual:
        return None
    unit = {"depth_unit": "mm" if raw == "uint16" else "m"} if f.is_depth and raw else {}
    if f.dtype == "image":
        return {"is_depth_map": True, **unit} if f.is_depth else None
    if raw is None:
        return {"video.pix_fmt": meta.DEPTH_FORMAT, **_quantizer(own), "is_depth_map": True} if f.is_depth else None
    codec = codecs.codec_for(f"x{own.suffix}")
    out = {
        "video.height": f.shape[0], "video.width": f.shape[1], "video.codec": codec.name, "video.pix_fmt": meta.DEPTH_FORMAT if f.is_depth else codec.pixel_format,
        "video.fps": own.fps, "video.channels": f.shape[2], "has_audio": False, "video.g": 1 if f.is_depth else int(own.rgb_gop), "video.crf": 30 if f.is_depth else int(own.rgb_crf), "is_depth_map": f.is_depth,
    }
    return out | _quantizer(own) | unit if f.is_depth else out


def _info(features: list[meta.Feature], own: Options, raw: dict[str, str], episodes: int, frames: int, tasks: int) -> dict:
    described = {}
    for f in [*features, *_generated()]:
        described[f.name] = {"dtype": f.dtype, "shape": list(f.shape), "names": f.names}
        if about := _visual_info(f, own, raw.get(f.name)):
            described[f.name]["info"] = about
    video = VIDEO_PATH + own.suffix if any(f.dtype == "video" for f in features) else None
    return {
        "codebase_version": VERSION, "fps": int(own.fps), "features": described, "total_episodes": episodes, "total_frames": frames, "total_tasks": tasks,
        "chunks_size": int(own.chunks_size), "data_files_size_in_mb": own.data_files_size_in_mb, "video_files_size_in_mb": own.video_files_size_in_mb,
        "data_path": DATA_PATH, "video_path": video, "robot_type": own.robot_type, "splits": {"train": f"0:{episodes}"} if episodes else {},
    }
