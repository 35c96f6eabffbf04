"""Frame timestamps of target frames: a keyed join that must find exactly one frame for each key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..scratch import kept
from .temporal import first_problem, guard, text


#: Frames that one task sorts, about, where their number is told.
TASK_ROWS = 1_000_000


def matches(keys: DataFrame, frames: DataFrame, rows: int = 0) -> DataFrame:
    """(episode_index, frame_index, timestamp, matches) of each distinct key of keys.

    Frames are joined before they are cast, so unreadable frames that nothing asks for do no harm.
    rows: how many keys or frames there are; beyond TASK_ROWS for each of the session's partitions
    both are dealt to more, so the memory of a task does not grow with them. Beyond TASK_ROWS frames
    are not broadcast, however small Spark takes their files to be.
    """
    pieces = -(-rows // TASK_ROWS)
    if pieces > int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        by = ["episode_index", "frame_index"]
        keys, frames = keys.select(*by).repartition(pieces, *by), frames.select(*by, "timestamp").repartition(pieces, *by)
    wanted = keys.select("episode_index", "frame_index").distinct()
    have = frames.select(F.col("episode_index").alias("_e"), F.col("frame_index").alias("_f"), F.col("timestamp").alias("_t"))
    if rows > TASK_ROWS:
        have = have.hint("merge")
    joined = wanted.join(have, (F.col("episode_index") == F.col("_e")) & (F.col("frame_index") == F.col("_f")), "left")
    return joined.groupBy("episode_index", "frame_index").agg(F.min(F.col("_t").cast("double")).alias("timestamp"), F.count("_e").alias("matches"))


def match_problem(frame: str = "target_frame_index") -> Column:
    t = F.col("timestamp")
    at = (F.col("episode_index"), " frame ", F.col(frame))
    return first_problem(
        (F.col("matches") == 0, text("episode ", F.col("episode_index"), " has no Parquet row for frame ", F.col(frame))),
        (F.col("matches") > 1, text("episode ", F.col("episode_index"), " has ", F.col("matches"), " Parquet rows for frame ", F.col(frame))),
        (t.isNull() | F.isnan(t) | (F.abs(t) == math.inf) | (t < 0), text("Invalid timestamp for episode ", *at)),
    )


def timestamps(targets: DataFrame, frames: DataFrame, eager: bool = True) -> DataFrame:
    """targets (.., episode_index, target_frame_index) with the timestamp of each target frame."""
    found = matches(targets.select("episode_index", F.col("target_frame_index").alias("frame_index")), frames)
    found = found.withColumnRenamed("frame_index", "target_frame_index")
    if eager:
        found = kept(found, "timestamps")
        if bad := found.select(match_problem().alias("p")).agg(F.min("p")).first()[0]:
            raise DatasetError(bad)
    joined = targets.join(guard(found, match_problem()).drop("matches"), ["episode_index", "target_frame_index"], "left")
    return guard(joined, F.when(F.col("timestamp").isNull(), F.lit("target frame has no timestamp")))


def nearest(points: DataFrame, times: DataFrame, by: str, at: str, time: str, tolerance: float) -> DataFrame:
    """points with the time of the same `by` that is nearest to `at`; of two as near the earlier one.

    Both sides are one sorted stream per key, so a key is neither collected nor paired with all its
    times. A point without a time within the tolerance fails the job.
    """
    marks = times.select(by, F.col(time).alias("_x"), F.lit(0).alias("_is"), F.col(time).alias("_t"))
    both = points.withColumns({"_x": F.col(at), "_is": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    past = lambda *order: F.last("_t", ignorenulls=True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("_before", past("_x", "_is")).withColumn("_after", past(F.desc("_x"), "_is"))
    earlier = F.col("_after").isNull() | (F.col(at) - F.col("_before") <= F.col("_after") - F.col(at))
    out = seen.where("_is = 1").withColumn("matched", F.when(F.col("_before").isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after")))
    off = F.col("matched").isNull() | (F.abs(F.col("matched") - F.col(at)) > tolerance)
    return guard(out, F.when(off, text("No frame matched timestamp ", F.col(at), f" within tolerance {tolerance}"))).select(*points.columns, "matched")
