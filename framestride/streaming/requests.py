"""Temporal targets of requests that arrive as a stream, against the routes of a dataset that stands still."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import temporal
from ..sources.dataset import Dataset


def targets(ds: Dataset, requests: DataFrame, *, delta_timestamps: Iterable[float] = (0.0,), tolerance: float = temporal.TOLERANCE) -> DataFrame:
    """temporal.targets() for a streaming relation: a stateless stream-static join.

    A bad request fails its batch. There are no ordinals, since a stream has no last row to count.
    """
    rows = temporal.relation(requests, {c: "bigint" for c in ("request_id", "episode_index", "frame_index", "delta_index")})
    steps = temporal.deltas(delta_timestamps, ds.meta().fps, temporal.check_tolerance(tolerance))
    ds.data_files()
    joined = rows.join(temporal.few(ds, temporal._lengths(ds)), "episode_index", "left")
    joined = temporal.guard(joined, temporal.request_problem(joined, len(steps), F.col("length").isNotNull(), rows.columns))
    joined = joined.withColumn("delta_timestamp", temporal.nth([d.seconds for d in steps], "double", F.col("delta_index")))
    out = temporal.clamp(joined, temporal.nth([d.frames for d in steps], "bigint", F.col("delta_index")))
    return out.select("request_id", "episode_index", "frame_index", "delta_index", "delta_timestamp", "delta_frame_offset", "is_padding", "target_frame_index", *(["target_id"] if "target_id" in rows.columns else []))
