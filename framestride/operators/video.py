"""Video frames, windows and targets: where each requested frame is, and, if asked for, its pixels.

All columns but the decoded ones are plain expressions. Decoded columns are fields of one Arrow UDF
column, so a query that does not select them never opens a media file.
"""

import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions.depth import dequantize
from ..functions.pixels import resize
from ..sources.dataset import Dataset, any_of, canonical
from . import codecs, lookup
from .temporal import TOLERANCE, check_tolerance, clamp, deltas, few, first_problem, guard, nth, numbered, relation, request_problem, text

#: Frames that one seek may run over, and request x delta pairs that a window call may expand to.
SPAN = 20_000
PAIRS = 100_000
#: Stands for every episode where episodes are listed.
ALL = object()
DECODED = "struct<decoded_timestamp: double, width: int, height: int, image: binary>"


@dataclass(frozen=True, kw_only=True)
class Options:
    """Options of decoding; those about threads, queues and seeking are accepted and left to Spark's scheduler and the codecs."""

    width: int = 0
    height: int = 0
    tolerance: float = TOLERANCE
    cluster_gap: float = 10.0
    batch_size: int = 16
    target_buffer_size: int = 256
    max_cached_decoders: int = 8
    decode_threads: int = 8
    producer_threads: int = 4
    max_pending_targets: int = 0
    max_output_bytes: int = 64 << 20
    codec_threads: int = 1
    depth_output_unit: str = "mm"

    def __post_init__(self):
        check_tolerance(self.tolerance)
        for name, low, high in (
            ("batch_size", 1, 2048), ("target_buffer_size", 1, 1 << 20), ("max_cached_decoders", 1, 1024), ("decode_threads", 1, 1024), ("producer_threads", 1, 1024),
            ("max_pending_targets", 0, 10 << 20), ("max_output_bytes", 1, 1 << 62), ("codec_threads", 0, 64),
        ):
            value = getattr(self, name)
            if value is None or not low <= value <= high:
                raise DatasetError(f"{name} must be between {low} and {high}")
        if (self.width, self.height) != (0, 0) and not (1 <= self.width <= 32768 and 1 <= self.height <= 32768):
            raise DatasetError("width and height must both be 0 or both between 1 and 32768")
        if self.cluster_gap is None or not (math.isfinite(self.cluster_gap) and self.cluster_gap >= 0):
            raise DatasetError("cluster_gap must be finite and not negative")
        if self.depth_output_unit not in ("m", "mm"):
            raise DatasetError("depth_output_unit must be 'm' or 'mm'")


def frame_span(first: float, last: float, fps: float) -> int:
    """Frames from one time to another, both included."""
    return int(math.floor((last - first) * fps + 0.5)) + 1


def clusters(times: list[float], gap: float, fps: float, span: int = SPAN) -> list[int]:
    """The seek cluster of each of some rising times: a new one after a gap, or beyond a span of frames."""
    out, first = [], 0.0
    for i, t in enumerate(times):
        new = i == 0 or t - times[i - 1] > gap or frame_span(first, t, fps) > span
        out.append(out[-1] + new if out else 0)
        if new:
            first = t
    return out


def gap_clusters(rows: DataFrame, by: str, at: str, gap: float) -> DataFrame:
    """rows with seek_cluster: runs of times per key that no gap over `gap` breaks, numbered from 0."""
    order = Window.partitionBy(by).orderBy(at)
    new = (F.col(at) - F.lag(at).over(order) > gap).cast("bigint")
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(0)))
    return rows.withColumn("seek_cluster", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def nearest_index(times: np.ndarray, at: float) -> int:
    """The time nearest to `at`; of two as near the earlier."""
    i = int(np.searchsorted(times, at, "left"))
    if i == len(times) or (i and at - times[i - 1] <= times[i] - at):
        return i - 1
    return i


class _Decoders:
    """Open videos of a worker, the least recently used closed first."""

    def __init__(self, most: int, places: dict[str, str]):
        self.most, self.places, self.open = most, places, OrderedDict()

    def get(self, path: str) -> codecs.Video:
        if path not in self.open:
            while len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[path] = codecs.codec_for(path, self.places).open(path.removeprefix("file://"))
        self.open.move_to_end(path)
        return self.open[path]

    def close(self) -> None:
        for v in self.open.values():
            v.close()


def decoder(options: Options, depth: dict, places: dict[str, str]):
    """An Arrow UDF (path, key, time) -> DECODED over the batches of a task, whose decoders stay open from one to the next.

    Rows go in stretches of batch_size, or of as many images as max_output_bytes holds, so what a
    worker has in memory does not grow with the batch; within a stretch each video's targets go in
    order of time.
    """
    kind = pa.struct([("decoded_timestamp", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("image", pa.binary())])

    def stretch(videos: _Decoders, path: list, key: list, time: list) -> pa.Array:
        out: list = [None] * len(path)
        last: tuple = (None, None, None)
        for i in sorted(range(len(path)), key=lambda i: (path[i] or "", time[i] or 0.0)):
            if path[i] is None or time[i] is None:
                continue
            video = videos.get(path[i])
            stamps = video.times()
            j = nearest_index(stamps, time[i]) if len(stamps) else -1
            if j < 0 or abs(stamps[j] - time[i]) > options.tolerance:
                near = f" (closest decoded timestamp {stamps[j]:.6f})" if j >= 0 else ""
                raise DatasetError(f"No frame in video '{path[i]}' matched timestamp {time[i]:.6f} within tolerance {options.tolerance:.6f}{near}")
            if last[:2] != (path[i], j):
                image = video.frame(j)
                if (how := depth.get(key[i])) is not None:
                    image = dequantize(image, how, options.depth_output_unit)
                if options.width:
                    image = resize(image, options.width, options.height)
                last = (path[i], j, image)
            image = last[2]
            out[i] = {"decoded_timestamp": float(stamps[j]), "width": image.shape[1], "height": image.shape[0], "image": np.ascontiguousarray(image).tobytes()}
        return pa.array(out, kind)

    def run(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        videos, size = _Decoders(options.max_cached_decoders, places), 1
        try:
            for paths, keys, times in parts:
                path, key, time = paths.to_pylist(), keys.to_pylist(), times.to_pylist()
                at = 0
                while at < len(path):
                    # The first image of a task tells how many fit.
                    to = at + max(1, min(options.batch_size, options.max_output_bytes // size if size > 1 else 1))
                    out = stretch(videos, path[at:to], key[at:to], time[at:to])
                    size = max(size, out.nbytes // len(out))
                    yield out
                    at = to
        finally:
            videos.close()

    return F.arrow_udf(run, DECODED)


def _located(ds: Dataset, rows: DataFrame, options: Options, frame: str) -> DataFrame:
    """rows (.., timestamp and a route) with video_timestamp, within the route, and the decoded columns."""
    at = F.col("from_timestamp") + F.col("timestamp")
    out = (at < F.col("from_timestamp") - options.tolerance) | (at > F.col("to_timestamp") + options.tolerance)
    rows = guard(rows.withColumn("video_timestamp", at), F.when(out, text("episode ", F.col("episode_index"), " frame ", F.col(frame), " timestamp falls outside video route for key '", F.col("video_key"), "'")))
    info = ds.meta()
    depth = {f.name: f.depth for f in info.videos if f.depth}
    shown = decoder(options, depth, codecs.known())("video_path", "video_key", "video_timestamp")
    rows = rows.withColumn("_decoded", shown)
    size = {s: F.lit(getattr(options, s)).cast("int") if options.width else F.col(f"_decoded.{s}") for s in ("width", "height")}
    channels = F.when(any_of(F.col("video_key"), [f.name for f in info.videos if f.is_depth]), 1).otherwise(3).cast("int")
    return rows.withColumns({"decoded_timestamp": F.col("_decoded.decoded_timestamp"), **size, "channels": channels, "image": F.col("_decoded.image")})


SHOWN = ["video_timestamp", "decoded_timestamp", "width", "height", "channels", "image"]


def _keys(ds: Dataset, video_keys: Iterable[str] | None) -> list[str]:
    info = ds.meta()
    keys = [f.name for f in info.videos] if video_keys is None else canonical(video_keys, "video_keys", whole=False)
    for k in keys:
        info.video(k)
    return keys


def frames(ds: Dataset, episode_indices: Iterable[int] | object, *, frame_indices: Iterable[int] | None = None, video_keys: Iterable[str] | None = None, refresh: bool = False, **options) -> DataFrame:
    """Every frame of the episodes (or of ALL) on every camera. Repeated frame rows are repeated here."""
    own = Options(**options)
    episodes = None if episode_indices is ALL else canonical(episode_indices, "episode_indices")
    chosen = None if frame_indices is None else canonical(frame_indices, "frame_indices")
    ds._fresh(refresh)
    keys = _keys(ds, video_keys)
    rows = ds.frame_times(episodes)
    if chosen is not None:
        rows = rows.where(any_of(F.col("frame_index"), chosen))
    rows = rows.select(*(F.col(c).cast(t).alias(c) for c, t in (("episode_index", "bigint"), ("frame_index", "bigint"), ("timestamp", "double"))))
    t = F.col("timestamp")
    rows = guard(rows, first_problem(
        (F.col("episode_index").isNull() | F.col("frame_index").isNull() | (F.col("frame_index") < 0), "frame rows require non-NULL, non-negative indices"),
        (t.isNull() | F.isnan(t) | (F.abs(t) == math.inf) | (t < 0), text("Invalid timestamp for episode ", F.col("episode_index"), " frame ", F.col("frame_index"))),
    ))
    routes = ds.video_route_table(keys).drop("length")
    if episodes is not None:
        routes = routes.where(any_of(F.col("episode_index"), episodes))
    joined = rows.join(few(ds, routes), "episode_index")
    return _located(ds, joined, own, "frame_index").select("episode_index", "frame_index", "timestamp", "video_key", "video_path", *SHOWN)


def windows(ds: Dataset, requests: list | DataFrame, *, delta_timestamps: Iterable[float] | None = (0.0,), video_keys: Iterable[str] | None = None, refresh: bool = False, **options) -> DataFrame:
    """Each request (request_id, episode_index, frame_index) at each delta on each camera.

    requests is a list of tuples or dicts, in the order that request_ordinal counts, or a DataFrame of
    these columns and request_ordinal.
    """
    own = Options(**options)
    ds._fresh(refresh)
    info = ds.meta()
    steps = deltas(delta_timestamps, info.fps, own.tolerance)
    keys = _keys(ds, video_keys)
    if not isinstance(requests, DataFrame):
        if requests is None:
            raise DatasetError("requests must not be NULL")
        listed = [tuple(r.get(c) for c in ("request_id", "episode_index", "frame_index")) if isinstance(r, dict) else tuple(r) if r is not None else (None,) * 3 for r in requests]
        if len(listed) * len(steps) > PAIRS:
            raise DatasetError(f"requests expands to more than {PAIRS} frame targets")
        requests = ds.spark.createDataFrame([(*(None if v is None else int(v) for v in r), i) for i, r in enumerate(listed)], "request_id bigint, episode_index bigint, frame_index bigint, request_ordinal bigint")
    base = requests.select(*(F.col(c).cast("bigint").alias(c) for c in ("request_id", "episode_index", "frame_index", "request_ordinal")))
    ds.data_files()
    routes = few(ds, ds.video_route_table(keys))
    by_episode = routes.groupBy("episode_index").agg(F.count("*").alias("routes"))
    lengths = ds.routes().select("episode_index", "length") if info.episodes else ds.spark.createDataFrame([], "episode_index bigint, length bigint")
    rows = base.join(few(ds, lengths), "episode_index", "left").join(few(ds, by_episode), "episode_index", "left")
    lacks = text("episode ", F.col("episode_index"), " does not have every requested video route")
    problem = first_problem(
        *((F.col(c).isNull(), "requests must not contain NULL") for c in ("request_id", "episode_index", "frame_index")),
        *((F.col(c) < 0, f"requests {c} must be non-negative") for c in ("episode_index", "frame_index")),
        (F.lit(bool(keys)) & (F.coalesce("routes", F.lit(0)) < len(keys)), lacks),
        (F.lit(bool(keys)) & (F.col("frame_index") >= F.col("length")), text("frame ", F.col("frame_index"), " is outside episode ", F.col("episode_index"), " length ", F.col("length"))),
    )
    if bad := rows.agg(F.min(problem)).first()[0]:
        raise DatasetError(bad)
    step = F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("delta_ordinal"), F.lit(d.seconds).alias("delta_timestamp"), F.lit(d.frames).cast("bigint").alias("_offset")) for i, d in enumerate(steps)))) if steps else None
    if step is None or not keys:
        rows = rows.limit(0)
        step = F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("delta_ordinal"), F.lit(0.0).alias("delta_timestamp"), F.lit(0).cast("bigint").alias("_offset"))))
    rows = guard(rows, problem).select("*", step.alias("_d")).select("*", "_d.*").drop("_d", "routes")
    rows = clamp(rows, F.col("_offset"))
    timed = lookup.timestamps(rows, ds.frame_times(_some_episodes(base)))
    joined = timed.drop("length").join(routes.drop("length"), "episode_index")
    names = ["request_id", "request_ordinal", "delta_ordinal", "delta_timestamp", "delta_frame_offset", "is_padding", "episode_index", "frame_index", "target_frame_index", "timestamp", "video_key", "video_path", *SHOWN]
    return _located(ds, joined, own, "target_frame_index").select(*names)


def _some_episodes(base: DataFrame, most: int = 10_000) -> list[int] | None:
    """The episodes of a request relation, to prune files by; None if there are many."""
    found = [r[0] for r in base.select("episode_index").distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def targets(ds: Dataset, requests: DataFrame, *, delta_timestamps: Iterable[float] | None = (0.0,), refresh: bool = False, **options) -> DataFrame:
    """Each request (request_id, episode_index, frame_index, video_key, delta_index[, target_id]) as a target on its camera."""
    if "producer_threads" in options or "video_keys" in options:
        raise TypeError("targets() takes neither producer_threads nor video_keys")
    own = Options(**options)
    ds._fresh(refresh)
    info = ds.meta()
    rows = relation(requests, {"request_id": "bigint", "episode_index": "bigint", "frame_index": "bigint", "video_key": "string", "delta_index": "bigint"})
    steps = deltas(delta_timestamps, info.fps, own.tolerance)
    ds.data_files()
    routes = few(ds, ds.video_route_table())
    lengths = ds.routes().select("episode_index", F.col("length").alias("_length")) if info.episodes else ds.spark.createDataFrame([], "episode_index bigint, _length bigint")
    joined = rows.join(routes, ["episode_index", "video_key"], "left").join(few(ds, lengths), "episode_index", "left").withColumn("length", F.col("_length"))
    lacks = text("episode ", F.col("episode_index"), " has no video route for key '", F.col("video_key"), "'")
    problem = F.coalesce(request_problem(joined, len(steps), F.col("_length").isNotNull(), rows.columns), F.when(F.col("video_path").isNull(), lacks))
    joined = guard(numbered(joined, problem, rows.columns), problem)
    joined = joined.withColumn("delta_timestamp", nth([d.seconds for d in steps], "double", F.col("delta_index")))
    clamped = clamp(joined, nth([d.frames for d in steps], "bigint", F.col("delta_index")))
    timed = lookup.timestamps(clamped, ds.frame_times(_some_episodes(rows)))
    names = ["request_id", "target_ordinal", "episode_index", "frame_index", "video_key", "delta_index", "delta_timestamp", "delta_frame_offset", "is_padding", "target_frame_index", "timestamp", "video_path", *SHOWN]
    return _located(ds, timed, own, "target_frame_index").select(*names, *(["target_id"] if "target_id" in rows.columns else []))


