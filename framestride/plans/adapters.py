"""Episodic views of ordinary tables: a dataset whose frames, episodes and routes are DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import ranked
from ..sources import info as meta
from ..sources import paths
from ..sources.dataset import Dataset, any_of
from ..sources.writer import generated_columns

CAMERAS = ("front", "wrist")
ROOT = "/data/events"
VIDEO = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
FPS = 10
#: Episodes whose recordings share a media file.
SHARED = 50


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event (episode_index, task, action, ts, event_id): the users in order are the episodes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = ranked(events.select("user_id").distinct(), ["user_id"], "users").withColumnRenamed("_rank", "episode_index")
    rows = events.join(users, "user_id")
    return rows.select("episode_index", F.col("event_type").alias("task"), F.col("value").alias("action"), "ts", "event_id")


@dataclass
class ViewDataset(Dataset):
    """A dataset of frames (episode_index, frame_index, timestamp, ..) and episodes (episode_index, length) that are not files."""

    frames: DataFrame | None = None
    lengths: DataFrame | None = None
    #: Their number, by which routes are broadcast or not.
    many: int = 1

    @property
    def place(self) -> str:
        return self.root

    def meta(self) -> meta.Info:
        features = tuple(meta.Feature(k, "video", (48, 64, 3)) for k in CAMERAS)
        return meta.Info("v3.0", "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet", VIDEO, FPS, self.many, 1, 1, (*features, meta.Feature("action", "float64", (1,))))

    def routes(self) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return self.lengths.select("episode_index", "length", zero.alias("chunk_index"), zero.alias("file_index"))

    def data_files(self) -> dict:
        return {}

    def video_files(self) -> dict:
        return {}

    def _video_rows(self, info: meta.Info) -> DataFrame:
        """Recordings of SHARED episodes lie one after the other in each camera's file."""
        file = F.floor(F.col("episode_index") / SHARED).cast("bigint")
        until = F.sum("length").over(Window.partitionBy("file_index").orderBy("episode_index").rowsBetween(Window.unboundedPreceding, 0))
        rows = self.lengths.withColumn("file_index", file).withColumn("until", until)
        rows = rows.select("episode_index", "length", F.explode(F.array(*map(F.lit, CAMERAS))).alias("video_key"), F.lit(0).cast("bigint").alias("chunk_index"), "file_index", ((F.col("until") - F.col("length")) / FPS).alias("from_timestamp"), (F.col("until") / FPS).alias("to_timestamp"))
        return rows

    def scan(self, episode_indices=None, **options) -> DataFrame:
        return self.frames if episode_indices is None else self.frames.where(any_of(F.col("episode_index"), sorted(set(episode_indices))))


def event_dataset(spark: SparkSession, sf_dir: str) -> tuple[ViewDataset, DataFrame, DataFrame]:
    """(dataset, episodes, tasks) of the events."""
    frames, episodes, tasks = generated_columns(event_frames(spark, sf_dir), ["ts", "event_id"])
    frames = frames.withColumn("timestamp", F.col("frame_index") / FPS)
    return ViewDataset(spark, ROOT, frames=frames, lengths=episodes.select("episode_index", "length"), many=episodes.count()), episodes, tasks


def expand(template: str, number, per_chunk: int):
    """A template's path for a running file number, as a column."""
    return paths.expand_column(template, F.floor(number / per_chunk).cast("bigint"), F.pmod(number, F.lit(per_chunk)))
