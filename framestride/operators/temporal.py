"""Temporal targets: a frame and a time offset become a target frame, clamped to its episode."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..scratch import kept
from ..sources.dataset import Dataset, col

TOLERANCE = 1e-4
#: Episodes up to this number are broadcast: their routes are below 10 MB.
FEW = 100_000
#: Rows that number themselves in one bucket, about, and buckets at most.
BUCKET, BUCKETS = 50_000, 4096


@dataclass(frozen=True)
class Delta:
    seconds: float
    frames: int


def check_tolerance(tolerance: float | None) -> float:
    if tolerance is None or not math.isfinite(tolerance) or tolerance <= 0:
        raise DatasetError("tolerance must be finite and positive")
    return float(tolerance)


def deltas(seconds: Iterable[float] | None, fps: int, tolerance: float = TOLERANCE) -> list[Delta]:
    """Each time offset as a number of frames, rounded half to even; it must be one within the tolerance."""
    if seconds is None:
        raise DatasetError("delta_timestamps must not be NULL")
    out = []
    for s in seconds:
        if s is None:
            raise DatasetError("delta_timestamps must not contain NULL")
        s = float(s)
        if not math.isfinite(s) or not abs(s * fps) < 2.0**63:
            raise DatasetError("delta_timestamps must be finite and within the range of frames")
        frames = round(s * fps)
        if abs(s - frames / fps) > tolerance:
            raise DatasetError(f"delta_timestamp {s} is not a multiple of 1/fps ({fps}) within tolerance")
        out.append(Delta(s, frames))
    return out


def relation(requests: DataFrame, columns: dict[str, str], optional: str = "target_id") -> DataFrame:
    """requests with exactly the columns, in that order and cast; names match in any case."""
    have: dict[str, str] = {}
    for name in requests.columns:
        if name.lower() in have:
            raise DatasetError(f"duplicate column '{name}' in the input relation")
        have[name.lower()] = name
    kinds = dict(columns)
    if optional in have:
        kinds[optional] = "bigint"
    if len(requests.columns) != len(kinds):
        raise DatasetError(f"input relation must contain exactly {', '.join(columns)} and optionally {optional}")
    for name in kinds:
        if name not in have:
            raise DatasetError(f"input relation requires column '{name}'")
    return requests.select(*(col(have[n]).cast(t).alias(n) for n, t in kinds.items()))


def first_problem(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for bad, message in reversed(checks):
        out = F.when(bad, F.lit(message) if isinstance(message, str) else message).otherwise(out)
    return out


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def guard(df: DataFrame, problem: Column) -> DataFrame:
    """df, failing its job at a row that has a problem; as a filter, so that no projection prunes it away."""
    return df.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True)))


def few(ds: Dataset, routes: DataFrame) -> DataFrame:
    return F.broadcast(routes) if ds.meta().episodes <= FEW else routes


def request_problem(rows: DataFrame, n_deltas: int, known: Column, needed: list[str]) -> Column:
    """What is wrong with a request that has been joined with its episode's length."""
    checks: list[tuple[Column, Column | str]] = [(F.col(c).isNull(), f"input column '{c}' must not contain NULL") for c in needed]
    checks += [(F.col(c) < 0, f"input column '{c}' must be non-negative") for c in ("episode_index", "frame_index")]
    if "delta_index" in needed:
        checks.append(((F.col("delta_index") < 0) | (F.col("delta_index") >= n_deltas), text("delta_index ", F.col("delta_index"), f" is outside delta_timestamps length {n_deltas}")))
    checks.append((~known, text("episode ", F.col("episode_index"), " does not exist")))
    checks.append((F.col("frame_index") >= F.col("length"), text("frame ", F.col("frame_index"), " is outside episode ", F.col("episode_index"), " length ", F.col("length"))))
    return first_problem(*checks)


def clamp(rows: DataFrame, offset: Column) -> DataFrame:
    """rows with delta_frame_offset, is_padding and target_frame_index; no sum of theirs overflows."""
    last, frame = F.col("length") - 1, F.col("frame_index")
    early, late = offset < -frame, offset > last - frame
    target = F.when(early, F.lit(0)).when(late, last).otherwise(F.when(early | late, F.lit(0)).otherwise(offset) + frame)
    return rows.withColumns({"delta_frame_offset": offset, "is_padding": early | late, "target_frame_index": target.cast("bigint")})


def nth(values: list, kind: str, index: Column) -> Column:
    """The value at an index from 0; null outside."""
    if not values:
        return F.lit(None).cast(kind)
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), index.cast("int"))


def numbered(rows: DataFrame, problem: Column, keys: list[str]) -> DataFrame:
    """rows with target_ordinal: unique numbers from 0 without gaps, whose order means nothing.

    Rows number themselves within hashed buckets, so no task sees them all. The job that counts the
    buckets also looks for problems, so that a bad row raises before any filter or limit hides it.
    """
    # A table, so that what the rows were joined with is not joined again by the plan that follows.
    base = kept(rows, "numbered").withColumn("_hash", F.xxhash64(*keys))
    found = base.groupBy(F.pmod("_hash", F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n"), F.min(problem).alias("p")).collect()  # BUCKETS rows at most
    if bad := min((r["p"] for r in found if r["p"]), default=None):
        raise DatasetError(bad)
    total = sum(r["n"] for r in found)
    buckets = 1
    while buckets < min(BUCKETS, -(-total // BUCKET)):
        buckets *= 2
    size = [0] * buckets
    for r in found:
        size[r["b"] % buckets] += r["n"]
    before = [sum(size[:i]) for i in range(buckets)]
    bucket = F.pmod("_hash", F.lit(buckets))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy("_hash", *keys)) - 1
    return base.withColumn("target_ordinal", (nth(before, "bigint", bucket) + place).cast("bigint")).drop("_hash")


def targets(ds: Dataset, requests: DataFrame, *, delta_timestamps: Iterable[float] | None = (0.0,), tolerance: float = TOLERANCE, refresh: bool = False) -> DataFrame:
    """The target frame of each request (request_id, episode_index, frame_index, delta_index[, target_id]).

    Every request is checked before this returns, in one job over the requests and the episodes.
    """
    tolerance = check_tolerance(tolerance)
    ds._fresh(refresh)
    rows = relation(requests, {c: "bigint" for c in ("request_id", "episode_index", "frame_index", "delta_index")})
    steps = deltas(delta_timestamps, ds.meta().fps, tolerance)
    ds.data_files()
    joined = rows.join(few(ds, _lengths(ds)), "episode_index", "left")
    problem = request_problem(joined, len(steps), F.col("length").isNotNull(), rows.columns)
    joined = guard(numbered(joined, problem, rows.columns), problem)
    joined = joined.withColumn("delta_timestamp", nth([d.seconds for d in steps], "double", F.col("delta_index")))
    out = clamp(joined, nth([d.frames for d in steps], "bigint", F.col("delta_index")))
    return out.select("request_id", "target_ordinal", "episode_index", "frame_index", "delta_index", "delta_timestamp", "delta_frame_offset", "is_padding", "target_frame_index", *(["target_id"] if "target_id" in rows.columns else []))


def _lengths(ds: Dataset) -> DataFrame:
    if not ds.meta().episodes:
        return ds.spark.createDataFrame([], "episode_index bigint, length bigint")
    return ds.routes().select("episode_index", "length")
