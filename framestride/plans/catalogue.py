"""The registered queries of the episodic engine, each with the SQL that gives the same rows.

Queries run over whole tables: q02 to q23 and q33 to q35 through the operators on an episodic view of
a table, whose episodes and routes are not files; q24 to q27 and q36 to q40 through datasets that are
written and read as files; the others through single functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..functions.depth import Depth, quantize
from ..functions.pixels import resize_indices, sample_frames
from ..operators import lookup, stats, temporal, video
from ..scratch import folder
from ..sources import info as meta
from ..sources import writer
from ..sources.dataset import Dataset
from ..sources.paths import expand_column
from . import adapters

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

DELTAS = [-0.2, -0.1, 0.0, 0.1, 0.2]
EPISODES = [5, 3, 1, 1, 10**9]

E = """e AS (
  SELECT u.episode_index, CAST(row_number() OVER (PARTITION BY x.user_id ORDER BY x.ts, x.event_id) - 1 AS BIGINT) AS frame_index, x.event_type AS task, x.value AS action, x.ts, x.event_id
  FROM events x JOIN (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS episode_index FROM (SELECT DISTINCT user_id FROM events)) u USING (user_id)
), n AS (SELECT episode_index, count(*) AS length FROM e GROUP BY ALL),
p AS (SELECT *, CAST(sum(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS first FROM n),
k AS (SELECT task, CAST(row_number() OVER (ORDER BY min((episode_index, frame_index))) - 1 AS BIGINT) AS task_index FROM e GROUP BY task)"""
R = """r AS (
  SELECT episode_index, length, key AS video_key, 0::BIGINT AS chunk_index, episode_index // 50 AS file_index,
    CAST(sum(length) OVER w - length AS BIGINT) / 10.0::DOUBLE AS from_timestamp, CAST(sum(length) OVER w AS BIGINT) / 10.0::DOUBLE AS to_timestamp
  FROM n, (VALUES ('front'), ('wrist')) c(key) WINDOW w AS (PARTITION BY key, episode_index // 50 ORDER BY episode_index)
), v AS (SELECT *, printf('/data/events/videos/%s/chunk-000/file-%03d.mp4', video_key, file_index) AS video_path FROM r)"""
T = """t AS (
  SELECT e.*, d.delta_index, d.delta_timestamp, d.o AS delta_frame_offset, n.length,
    (frame_index + d.o < 0 OR frame_index + d.o > n.length - 1) AS is_padding, greatest(0, least(n.length - 1, frame_index + d.o))::BIGINT AS target_frame_index
  FROM e JOIN n USING (episode_index), (VALUES (0::BIGINT, -0.2::DOUBLE, -2::BIGINT), (1, -0.1, -1), (2, 0.0, 0), (3, 0.1, 1), (4, 0.2, 2)) d(delta_index, delta_timestamp, o)
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _requests(ds: adapters.ViewDataset, n: int, *more) -> DataFrame:
    """A request for every frame at every delta."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("delta_index")
    return ds.frames.select(F.col("event_id").alias("request_id"), "episode_index", "frame_index", *more, at)


@query("""SELECT * FROM (VALUES ('front', 'video', '[48, 64, 3]', 'image/video column', 3::BIGINT), ('wrist', 'video', '[48, 64, 3]', 'image/video column', 3), ('action', 'float64', '[1]', 'double', 1), ('state', 'float32', '[2, 2]', 'array<array<float>>', 4),
  ('counter', 'uint64', '[1]', 'decimal(20,0)', 1)) x(feature, dtype, shape, spark_type, width)""")
def q01_info_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of an info document and what they are in Spark."""
    camera = '{"dtype": "video", "shape": [48, 64, 3]}'
    info = meta.parse(f"""{{"codebase_version": "v3.0", "data_path": "d/{{file_index}}", "video_path": "v/{{video_key}}/{{file_index}}", "fps": 10, "total_episodes": 1, "total_frames": 1, "total_tasks": 1,
      "features": {{"front": {camera}, "wrist": {camera}, "action": {{"dtype": "float64", "shape": [1]}}, "state": {{"dtype": "float32", "shape": [2, 2]}}, "counter": {{"dtype": "uint64", "shape": [1]}}}}}}""")
    rows = [(f.name, f.dtype, str(list(f.shape)), "image/video column" if f.visual else f.spark_type().simpleString(), f.width) for f in info.features]
    return spark.createDataFrame(rows, "feature string, dtype string, shape string, spark_type string, width bigint")


@query(f"WITH {E} SELECT episode_index, length, first AS dataset_from_index, first + length AS dataset_to_index FROM p")
def q02_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, episodes, _ = adapters.event_dataset(spark, sf_dir)
    return episodes.select("episode_index", "length", "dataset_from_index", (F.col("dataset_from_index") + F.col("length")).alias("dataset_to_index"))


@query(f"WITH {E} SELECT task_index, task FROM k")
def q03_tasks_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_dataset(spark, sf_dir)[2]


@query(f"WITH {E} SELECT episode_index, frame_index, action FROM e WHERE episode_index IN (5, 3, 1)")
def q04_scan_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_dataset(spark, sf_dir)[0].scan(EPISODES).select("episode_index", "frame_index", "action")


@query(f"WITH {E}, {R} SELECT episode_index, video_key, video_path, chunk_index, file_index, from_timestamp, to_timestamp, 10::BIGINT AS fps FROM v")
def q05_video_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_dataset(spark, sf_dir)[0].video_route_table().drop("length")


@query(f"WITH {E}, {T} SELECT event_id AS request_id, episode_index, frame_index, delta_index, delta_timestamp, delta_frame_offset, is_padding, target_frame_index FROM t")
def q06_temporal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame at five time offsets, clamped to its episode."""
    ds = adapters.event_dataset(spark, sf_dir)[0]
    return temporal.targets(ds, _requests(ds, len(DELTAS)), delta_timestamps=DELTAS).drop("target_ordinal")


@query(f"WITH {E}, {T} SELECT t.event_id AS request_id, t.delta_index, e.action AS target_action, k.task_index AS target_task FROM t JOIN e ON e.episode_index = t.episode_index AND e.frame_index = t.target_frame_index JOIN k ON k.task = e.task")
def q07_temporal_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = adapters.event_dataset(spark, sf_dir)[0]
    found = temporal.targets(ds, _requests(ds, len(DELTAS)), delta_timestamps=DELTAS)
    frames = ds.frames.select("episode_index", F.col("frame_index").alias("target_frame_index"), F.col("action").alias("target_action"), F.col("task_index").alias("target_task"))
    return found.join(frames, ["episode_index", "target_frame_index"]).select("request_id", "delta_index", "target_action", "target_task")


@query("SELECT event_id, CAST(round_even(value * 10, 0) AS BIGINT) AS frame_offset, CAST(round_even(user_id / 2.0::DOUBLE, 0) AS BIGINT) AS half FROM events")
def q08_half_even_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.rint(F.col("value") * adapters.FPS).cast("bigint").alias("frame_offset"), F.rint(F.col("user_id") / 2).cast("bigint").alias("half"))


@query(f'WITH {E}, {T} SELECT event_id AS request_id, delta_index, target_frame_index, target_frame_index / 10.0::DOUBLE AS "timestamp" FROM t')
def q09_target_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = adapters.event_dataset(spark, sf_dir)[0]
    found = temporal.targets(ds, _requests(ds, len(DELTAS)), delta_timestamps=DELTAS)
    return lookup.timestamps(found, ds.frame_times()).select("request_id", "delta_index", "target_frame_index", "timestamp")


@query(f"""WITH {E}, {R}, {T} SELECT t.event_id AS request_id, delta_index AS delta_ordinal, delta_timestamp, delta_frame_offset, is_padding, t.episode_index, frame_index, target_frame_index,
  target_frame_index / 10.0::DOUBLE AS "timestamp", video_key, video_path, from_timestamp + target_frame_index / 10.0::DOUBLE AS video_timestamp, 3 AS channels FROM t JOIN v USING (episode_index)""")
def q10_window_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = adapters.event_dataset(spark, sf_dir)[0]
    asked = ds.frames.select(F.col("event_id").alias("request_id"), "episode_index", "frame_index", F.col("event_id").alias("request_ordinal"))
    return video.windows(ds, asked, delta_timestamps=DELTAS).drop("request_ordinal", "decoded_timestamp", "width", "height", "image")


@query(f'WITH {E}, {R} SELECT episode_index, frame_index, frame_index / 10.0::DOUBLE AS "timestamp", video_key, video_path, from_timestamp + frame_index / 10.0::DOUBLE AS video_timestamp FROM e JOIN v USING (episode_index)')
def q11_video_frames_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = adapters.event_dataset(spark, sf_dir)[0]
    return video.frames(ds, video.ALL).select("episode_index", "frame_index", "timestamp", "video_key", "video_path", "video_timestamp")


@query(f"""WITH {E}, {R}, {T} SELECT t.event_id AS request_id, video_key, delta_index, target_frame_index, video_path, from_timestamp + target_frame_index / 10.0::DOUBLE AS video_timestamp, 32 AS width, 24 AS height
  FROM t JOIN v USING (episode_index) WHERE video_key = CASE WHEN event_id % 2 = 0 THEN 'front' ELSE 'wrist' END""")
def q12_video_targets_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = adapters.event_dataset(spark, sf_dir)[0]
    camera = F.when(F.col("event_id") % 2 == 0, "front").otherwise("wrist").alias("video_key")
    found = video.targets(ds, _requests(ds, len(DELTAS), camera), delta_timestamps=DELTAS, width=32, height=24)
    return found.select("request_id", "video_key", "delta_index", "target_frame_index", "video_path", "video_timestamp", "width", "height")


@query(f"""WITH {E}, g AS (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS sec FROM e), h AS (SELECT *, coalesce(sec - lag(sec) OVER (PARTITION BY episode_index ORDER BY sec) > 43200, false) AS new FROM g)
  SELECT event_id, CAST(sum(new::INT) OVER (PARTITION BY episode_index ORDER BY sec) AS BIGINT) AS seek_cluster FROM h""")
def q13_seek_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each user's events that no pause over half a day breaks."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return video.gap_clusters(adapters.event_frames(spark, sf_dir).withColumn("at", at), "episode_index", "at", 43_200.0).select("event_id", "seek_cluster")


@query("""WITH x AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS at FROM events), c AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS seen FROM events WHERE event_type = 'click')
  SELECT x.event_id, arg_min(c.seen, (abs(c.seen - x.at), c.seen)) AS matched FROM x JOIN c USING (user_id) GROUP BY ALL""")
def q14_nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same user's click that is nearest to each event."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    events = _table(spark, sf_dir, "events").withColumn("at", at)
    clicks = events.where("event_type = 'click'").select("user_id", F.col("at").alias("seen"))
    points = events.select("event_id", "user_id", "at").join(clicks.select("user_id").distinct(), "user_id", "left_semi")
    return lookup.nearest(points, clicks, "user_id", "at", "seen", 1e12).select("event_id", "matched")


@query("SELECT l_orderkey AS episode_index, l_linenumber::BIGINT AS frame_index, count(*) AS matches FROM lineitem GROUP BY ALL HAVING count(*) <> 1")
def q15_duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that do not have exactly one frame."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").cast("bigint").alias("frame_index"), F.col("l_quantity").alias("timestamp"))
    return lookup.matches(lines, lines, lines.count()).where("matches != 1").select("episode_index", "frame_index", "matches")


def _numeric_stats(rows: DataFrame, key: str, value: str, dtype: str) -> DataFrame:
    """(key, count, min, max, mean, std, q01..q99) of each key's values, bit by bit as the writer has them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending")])
        s = stats.episode(table.column(value).to_numpy()[None], dtype)
        return pa.table({key: [table.column(key)[0].as_py()], "count": [s.count], **{k: [float(v[0])] for k, v in s.values.items()}})

    names = ["min", "max", "mean", "std", *stats.QUANTILES]
    return rows.groupBy(key).applyInArrow(run, f"{key} bigint, count bigint, " + ", ".join(f"{n} double" for n in names))


@query(f"""WITH {E} SELECT episode_index, count(*) AS "count", min(action) AS "min", max(action) AS "max", round(avg(action), 4) AS mean, round(stddev_pop(action), 4) AS std FROM e GROUP BY ALL""")
def q16_episode_stats_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.event_frames(spark, sf_dir).select("episode_index", "action", F.col("event_id").alias("_order"))
    found = _numeric_stats(rows, "episode_index", "action", "float64")
    return found.select("episode_index", "count", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""SELECT count(*) AS "count", min(value) AS "min", max(value) AS "max", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events""")
def q17_dataset_stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode statistics folded in episode order: within ranges of episodes first, so that one small row a range reaches the driver."""
    rows = adapters.event_frames(spark, sf_dir).select("episode_index", "action", F.col("event_id").alias("_order"))
    names = ["min", "max", "mean", "std", *stats.QUANTILES]

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for part in parts:
            for r in part.to_pylist():
                own = stats.Stats(r["count"], {k: np.array([r[k]]) for k in names})
                held, first = (own, r["episode_index"]) if held is None else (stats.merge_all([held, own]), first)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"episode_index": first, "count": held.count, **{k: float(held.values[k][0]) for k in names}}])

    ordered = _numeric_stats(rows, "episode_index", "action", "float64").orderBy("episode_index")
    ranges = ordered.mapInArrow(fold, "episode_index bigint, count bigint, " + ", ".join(f"{n} double" for n in names)).collect()
    s = stats.merge_all([stats.Stats(r["count"], {k: np.array([r[k]]) for k in names}) for r in sorted(ranges, key=lambda r: r["episode_index"])])
    return spark.createDataFrame([(s.count, *(round(float(s.values[k][0]), 6) for k in ("min", "max", "mean", "std")))], "count bigint, min double, max double, mean double, std double")


@query(f"""WITH {E}, a AS (SELECT episode_index, count(*) AS m, min(action) - 1e-10::DOUBLE AS low, max(action) + 1e-10::DOUBLE AS high FROM e GROUP BY ALL),
  s AS (SELECT *, (high - low) / 5000.0::DOUBLE AS step FROM a),
  g AS (SELECT e.action AS x, s.*, CAST(floor((e.action - low) / step) AS BIGINT) AS b0 FROM e JOIN s USING (episode_index)),
  b AS (SELECT *, least(4999, CASE WHEN b0 * step + low > x THEN b0 - 1 WHEN (b0 + 1) * step + low <= x THEN b0 + 1 ELSE b0 END) AS bin FROM g),
  c AS (SELECT episode_index, m, low, high, step, bin, count(*) AS own FROM b GROUP BY ALL),
  d AS (SELECT *, sum(own) OVER (PARTITION BY episode_index ORDER BY bin) AS upto FROM c),
  q AS (SELECT d.*, p, row_number() OVER (PARTITION BY episode_index, p ORDER BY bin) AS r FROM d, (VALUES (0.01::DOUBLE), (0.1), (0.5), (0.9), (0.99)) z(p) WHERE upto >= p * m)
  SELECT episode_index, p AS quantile, round(CASE WHEN bin = 0 THEN low ELSE bin * step + low + (p * m - (upto - own)) / own * (CASE WHEN bin = 4999 THEN high ELSE (bin + 1) * step + low END - (bin * step + low)) END, 6) AS value FROM q WHERE r = 1""")
def q18_hist_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.event_frames(spark, sf_dir).select("episode_index", "action", F.col("event_id").alias("_order"))
    found = _numeric_stats(rows, "episode_index", "action", "float64")
    long = F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), F.round(n, 6).alias("value")) for n, q in stats.QUANTILES.items()))).alias("q")
    return found.select("episode_index", long).select("episode_index", "q.*")


@query("""SELECT label::BIGINT AS label, d::BIGINT AS dimension, count(*) AS "count", min(x)::DOUBLE AS "min", max(x)::DOUBLE AS "max", round(avg(x::DOUBLE), 6) AS mean, round(stddev_pop(x::DOUBLE), 6) AS std
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY ALL""")
def q19_vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every dimension, in double precision, of the vectors of each label."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])
        x = np.array(table.column("embedding").to_pylist(), np.float64)
        s = stats.episode(x.T, "float64")
        width = x.shape[1]
        return pa.table({"label": [table.column("label")[0].as_py()] * width, "dimension": list(range(width)), "count": [s.count] * width, **{k: s.values[k].tolist() for k in ("min", "max", "mean", "std")}})

    rows = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("label"), "vec_id", "embedding")
    found = rows.groupBy("label").applyInArrow(run, "label bigint, dimension bigint, count bigint, min double, max double, mean double, std double")
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""SELECT event_type AS task, min(event_id) + 9007199254740993 AS least, max(event_id) + 9007199254740993 AS most FROM events GROUP BY ALL""")
def q20_integer_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrema of integers beyond the reach of doubles: each batch's by the exact statistics, then the least and most of those."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            task, n = part.column("task").to_numpy(zero_copy_only=False), part.column("n").to_numpy()
            for name in dict.fromkeys(task.tolist()):
                x = n[task == name][None]
                s = stats.episode(x, "int64", x)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *(pa.array([int(s.exact[k][0])], pa.int64()) for k in ("min", "max"))], ["task", "a", "b"])

    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), (F.col("event_id") + 9007199254740993).alias("n"))
    return rows.mapInArrow(run, "task string, a bigint, b bigint").groupBy("task").agg(F.min("a").alias("least"), F.max("b").alias("most"))


@query(f"""WITH {E}, c AS (SELECT episode_index, length, greatest(least(100, length), least(CAST(floor(pow(length, 0.75)) AS BIGINT), 10000)) AS m FROM n)
  SELECT episode_index, CASE WHEN i = m - 1 THEN length - 1 ELSE CAST(round_even(i * ((length - 1) / (m - 1)::DOUBLE), 0) AS BIGINT) END AS frame_index FROM c, range(10000) z(i) WHERE i < m""")
def q21_visual_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            picked = [sample_frames(n).tolist() for n in part.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("episode_index"), pa.array(picked, pa.list_(pa.int64()))], ["episode_index", "at"])

    _, episodes, _ = adapters.event_dataset(spark, sf_dir)
    return episodes.select("episode_index", "length").mapInArrow(run, "episode_index bigint, at array<bigint>").select("episode_index", F.explode("at").alias("frame_index"))


@query(f'WITH {E} SELECT event_id, episode_index, frame_index, p.first + frame_index AS "index", task_index, (frame_index / 10.0::DOUBLE)::FLOAT AS "timestamp" FROM e JOIN p USING (episode_index) JOIN k USING (task)')
def q22_generated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = adapters.event_dataset(spark, sf_dir)[0]
    return ds.frames.select("event_id", "episode_index", "frame_index", "index", "task_index", F.col("timestamp").cast("float").alias("timestamp"))


@query(f"""WITH RECURSIVE {E}, w AS (
  SELECT episode_index, 0::BIGINT AS shard, (length * 100)::BIGINT AS size, length AS frames FROM n WHERE episode_index = 0
  UNION ALL SELECT n.episode_index, CASE WHEN w.size >= 50000.0::DOUBLE / (1.0::DOUBLE + n.length / w.frames::DOUBLE) THEN w.shard + 1 ELSE w.shard END,
    CASE WHEN w.size >= 50000.0::DOUBLE / (1.0::DOUBLE + n.length / w.frames::DOUBLE) THEN 0 ELSE w.size END + n.length * 100, CASE WHEN w.size >= 50000.0::DOUBLE / (1.0::DOUBLE + n.length / w.frames::DOUBLE) THEN 0 ELSE w.frames END + n.length
  FROM w JOIN n ON n.episode_index = w.episode_index + 1
) SELECT episode_index, shard FROM w""")
def q23_shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data shards of 50 kB for episodes of 100 bytes a frame."""
    episodes = adapters.event_dataset(spark, sf_dir)[1]
    return writer.planned_shards(episodes.select("episode_index", "length", (F.col("length") * 100).alias("bytes")), 50_000.0)


def _written(spark: SparkSession, sf_dir: str) -> Dataset:
    """A new dataset of the events, in the folder that the workers share."""
    root = folder(spark, "events").removeprefix("file://")
    rows = adapters.event_frames(spark, sf_dir).withColumns({"pair": F.array(F.col("action").cast("float"), (-F.col("action")).cast("float")), "event": F.col("event_id")})
    features = {"action": {"dtype": "float64", "shape": [1]}, "pair": {"dtype": "float32", "shape": [2]}, "event": {"dtype": "int64", "shape": [1]}}
    writer.write_dataset(rows.drop("event_id"), root, fps=adapters.FPS, features=features, order_by=["ts", "event"], data_files_size_in_mb=0.05, chunks_size=4)
    return Dataset(spark, root)


@query(f"""WITH {E} SELECT episode_index, frame_index, p.first + frame_index AS "index", task_index, (frame_index / 10.0::DOUBLE)::FLOAT AS "timestamp", action, action::FLOAT AS pair_0, -action::FLOAT AS pair_1, event_id AS event
  FROM e JOIN p USING (episode_index) JOIN k USING (task)""")
def q24_writer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that were written as a dataset and read back."""
    pair = [F.get("pair", i).alias(f"pair_{i}") for i in (0, 1)]
    return _written(spark, sf_dir).scan().select("episode_index", "frame_index", "index", "task_index", "timestamp", "action", *pair, "event")


@query(f"""WITH {E}, o AS (SELECT episode_index, task, min(frame_index) AS place FROM e GROUP BY ALL) SELECT p.episode_index, length, first AS dataset_from_index, first + length AS dataset_to_index, string_agg(task, ',' ORDER BY place) AS tasks
  FROM p JOIN o USING (episode_index) GROUP BY ALL""")
def q25_writer_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _written(spark, sf_dir).episodes()
    return found.select("episode_index", "length", "dataset_from_index", "dataset_to_index", F.array_join("tasks", ",").alias("tasks"))


@query(f"""WITH {E}, z AS (SELECT count(*) AS m, max(event_id) AS event, max(frame_index) AS frame, max(episode_index) AS episode FROM e) SELECT feature, m AS "count", most FROM z, LATERAL (VALUES ('action', NULL::BIGINT), ('pair', NULL), ('event', event),
  ('timestamp', NULL), ('frame_index', frame), ('episode_index', episode), ('index', m - 1), ('task_index', (SELECT count(DISTINCT task) - 1 FROM e))) x(feature, most)""")
def q26_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _written(spark, sf_dir).stats()
    count = F.get_json_object("stats", "$.count[0]").cast("bigint").alias("count")
    most = F.when(~F.col("feature").isin("action", "pair", "timestamp"), F.get_json_object("stats", "$.max[0]").cast("bigint")).alias("most")
    return found.select("feature", count, most)


@query("""SELECT * FROM (VALUES (0::BIGINT, 'data', false, 0::BIGINT), (0, 'video', false, 0), (1, 'data', true, 1), (1, 'video', false, 0), (2, 'data', false, 0), (2, 'video', false, 0)) x(step, component, cached, entries)""")
def q27_cache_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cached of a new dataset: before its first scan, after it, and after a refresh."""
    ds = _written(spark, sf_dir)
    steps = [ds.cache_info()]
    ds.scan()
    steps.append(ds.cache_info())
    ds.tasks(refresh=True)
    steps.append(ds.cache_info())
    out = [s.select(F.lit(i).cast("bigint").alias("step"), "component", "cached", "entries") for i, s in enumerate(steps)]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("""SELECT p_partkey, printf('data/chunk-%03d/file-%05d.parquet', p_partkey // 100, p_partkey % 100) AS data_path, printf('{%s}/c%d-%s', p_brand, p_partkey // 100, lpad(CAST(p_partkey % 100 AS VARCHAR), 4, ' ')) AS video_path FROM part""")
def q28_path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    chunk, file = F.floor(n / 100).cast("bigint"), F.pmod(n, F.lit(100))
    return _table(spark, sf_dir, "part").select("p_partkey", adapters.expand("data/chunk-{chunk_index:03d}/file-{file_index:05d}.parquet", n, 100).alias("data_path"), expand_column("{{{video_key}}}/c{chunk_index}-{file_index:4d}", chunk, file, F.col("p_brand"), "video_path").alias("video_path"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CAST(round_even(greatest(0::FLOAT, least(1::FLOAT, ((l_quantity * 100)::FLOAT - 10::FLOAT) / 9990::FLOAT)) * 4095::FLOAT, 0) AS BIGINT) AS level FROM lineitem""")
def q29_depth_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as depths of so many decimetres, in linear levels from 10 to 10,000 mm."""
    how = Depth(log=False)

    def run(x: pa.Array) -> pa.Array:
        return pa.array(quantize(x.to_numpy(zero_copy_only=False), how, True).astype(np.int64))

    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.arrow_udf(run, "bigint")((F.col("l_quantity") * 100).cast("float")).alias("level"))


@query("""SELECT event_id, upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 24)) AS pixels, 2 AS width, 2 AS height, 3 AS channels, 'uint8' AS dtype FROM events""")
def q30_image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 2 x 2 made-up pixels an event, encoded as PNG and decoded."""
    raw = F.unhex(F.substring(F.md5(F.col("event_id").cast("string")), 1, 24))
    shown = _table(spark, sf_dir, "events").select("event_id", images.decode_image(images.encode_image(raw, 2, 2, "uint8")).alias("d"))
    return shown.select("event_id", F.hex("d.image").alias("pixels"), "d.width", "d.height", "d.channels", "d.dtype")


@query("""SELECT p_partkey, CAST(i AS BIGINT) AS target, least(CAST(p_size + 511 AS BIGINT), CAST(floor((2 * i + 1) * (p_size + 512) / 448.0::DOUBLE) AS BIGINT)) AS source FROM (SELECT * FROM part), range(224) z(i)""")
def q31_resize_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source column of each of 224 columns, for sources of a part's size and 512."""

    def run(sizes: pa.Array) -> pa.Array:
        known = {n: resize_indices(n, 224).tolist() for n in set(sizes.to_pylist())}
        return pa.array([known[n] for n in sizes.to_pylist()], pa.list_(pa.int64()))

    wide = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.arrow_udf(run, "array<bigint>")(F.col("p_size").cast("bigint") + 512)).alias("target", "source"))
    return wide.select("p_partkey", F.col("target").cast("bigint").alias("target"), "source")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def q32_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return nation.unionByName(_table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), allowMissingColumns=True)


@query("SELECT 0::BIGINT AS only_windows, 0::BIGINT AS only_targets")
def q33_except_all_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and targets of the same requests are the same rows, as often."""
    ds = adapters.event_dataset(spark, sf_dir)[0]
    names = ["request_id", "delta_timestamp", "is_padding", "target_frame_index", "video_key", "video_timestamp"]
    asked = ds.frames.select(F.col("event_id").alias("request_id"), "episode_index", "frame_index", F.col("event_id").alias("request_ordinal"))
    a = video.windows(ds, asked, delta_timestamps=DELTAS).select(*names)
    b = video.targets(ds, _both(ds), delta_timestamps=DELTAS).select(*names)
    return _only(a, b, "request_id", "only_windows", "only_targets")


def _only(a: DataFrame, b: DataFrame, by: str, *names: str) -> DataFrame:
    """How many rows a EXCEPT ALL b and b EXCEPT ALL a have, from one count of how much oftener each row is in a.

    Rows are moved once, by one of their columns: hardly any repeats within a task, so nothing is counted before.
    """
    both = a.withColumn("_n", F.lit(1)).unionAll(b.withColumn("_n", F.lit(-1)))
    more = both.repartition(by).groupBy(*a.columns).agg(F.sum("_n").alias("n"))
    return more.agg(*(F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("bigint").alias(name) for n, name in zip((F.col("n"), -F.col("n")), names, strict=True)))


def _both(ds: adapters.ViewDataset) -> DataFrame:
    """A request for every frame at every delta on both cameras."""
    camera = F.explode(F.array(*map(F.lit, adapters.CAMERAS))).alias("video_key")
    return _requests(ds, len(DELTAS)).select("request_id", "episode_index", "frame_index", camera, "delta_index")


@query(f"WITH {E}, {T} SELECT episode_index, count(*) AS targets, sum(is_padding::INT)::BIGINT AS padded, round(avg(is_padding::INT), 6) AS rate FROM t GROUP BY ALL")
def q34_padding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = adapters.event_dataset(spark, sf_dir)[0]
    found = temporal.targets(ds, _requests(ds, len(DELTAS)), delta_timestamps=DELTAS)
    pad = F.col("is_padding").cast("int")
    return found.groupBy("episode_index").agg(F.count("*").alias("targets"), F.sum(pad).alias("padded"), F.round(F.avg(pad), 6).alias("rate"))


@query("SELECT count(*) AS rows, count(*) AS ordinals, 0::BIGINT AS least, count(*) - 1 AS most FROM events")
def q35_target_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of targets are unique and without gaps."""
    ds = adapters.event_dataset(spark, sf_dir)[0]
    found = temporal.targets(ds, _requests(ds, 1))
    return found.agg(F.count("*").alias("rows"), F.count_distinct("target_ordinal").alias("ordinals"), F.min("target_ordinal").alias("least"), F.max("target_ordinal").alias("most"))


@query(f"""WITH {E} SELECT 10::BIGINT AS fps, (SELECT count(*) FROM n) AS total_episodes, (SELECT count(*) FROM e) AS total_frames, (SELECT count(*) FROM k) AS total_tasks, 'v3.0' AS version, 'float64' AS action, [2]::BIGINT[] AS pair""")
def q36_info_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The info document of a written dataset, as a relation."""
    found = _written(spark, sf_dir).info()
    total = [F.col(c).cast("bigint").alias(c) for c in ("fps", "total_episodes", "total_frames", "total_tasks")]
    return found.select(*total, F.col("codebase_version").alias("version"), F.col("features.action.dtype").alias("action"), F.col("features.pair.shape").alias("pair"))


@query(f"WITH {E} SELECT task_index, task FROM k")
def q37_tasks_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a written dataset, read from its own file."""
    return _written(spark, sf_dir).tasks()


@query(f"WITH {E} SELECT episode_index, frame_index, action, true AS in_its_file, true AS no_other_file FROM e WHERE episode_index IN (5, 3, 1)")
def q38_pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of some episodes, from the files that hold them and no others."""
    ds = _written(spark, sf_dir)
    found = ds.scan(EPISODES, filename=True)
    home = ds.routes().where(F.col("episode_index").isin(EPISODES)).select("episode_index", F.format_string("%s/data/chunk-%03d/file-%03d.parquet", F.lit(ds.place), "chunk_index", "file_index").alias("home"))
    needed = {r["home"] for r in home.select("home").distinct().collect()}  # of five episodes at most
    read = {f.removeprefix("file://") for f in found.inputFiles()}
    return found.join(F.broadcast(home), "episode_index").select("episode_index", "frame_index", "action", (F.col("filename") == F.col("home")).alias("in_its_file"), F.lit(read == needed).alias("no_other_file"))


def _files(spark: SparkSession, root: str, tables: dict[str, DataFrame], info: dict) -> Dataset:
    """A dataset of one Parquet file for each of some tables, by path below a new root."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path("x").getFileSystem(conf)
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{root}/parts/{name}")
        made = [f.getPath() for f in fs.listStatus(path(f"parts/{name}")) if f.getPath().getName().endswith(".parquet")]
        fs.mkdirs(path(name).getParent())
        fs.rename(made[0], path(name))
    fs.mkdirs(path("meta"))
    out = fs.create(path("meta/info.json"))
    out.write(bytearray(json.dumps(info).encode()))
    out.close()
    return Dataset(spark, root.removeprefix("file://"))


@query("SELECT 0::BIGINT AS episode_index, n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS place FROM nation UNION ALL SELECT 1, r_regionkey, r_name, NULL, r_regionkey FROM region")
def q39_scan_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset whose second file lacks a column and has the others in another order."""
    whole = lambda c, name: F.col(c).cast("bigint").alias(name)
    nation = _table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.lit(0).cast("bigint").alias("episode_index"), whole("n_nationkey", "key"), F.col("n_name").alias("name"), whole("n_regionkey", "region"))
    region = _table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_name").alias("name"), whole("r_regionkey", "key"), F.lit(1).cast("bigint").alias("episode_index"))
    sizes = [nation.count(), region.count()]
    episodes = spark.createDataFrame([(i, n, 0, i) for i, n in enumerate(sizes)], "episode_index bigint, length bigint, `data/chunk_index` bigint, `data/file_index` bigint")
    info = {"codebase_version": "v3.0", "data_path": "data/{chunk_index}-{file_index}.parquet", "video_path": None, "fps": 1, "total_episodes": 2, "total_frames": sum(sizes), "total_tasks": 0, "features": {}}
    ds = _files(spark, folder(spark, "by-name"), {"data/0-0.parquet": nation, "data/0-1.parquet": region, "meta/episodes/e.parquet": episodes}, info)
    return ds.scan(union_by_name=True, file_row_number=True).select("episode_index", "key", "name", "region", F.col("file_row_number").alias("place"))


@query(f"""WITH {E} SELECT episode_index, frame_index, video_key, upper(substr(md5(concat(event_id, '/', video_key)), 1, 24)) AS pixels, 2 AS width, 2 AS height, 3 AS channels FROM e, (VALUES ('front'), ('wrist')) c(video_key)""")
def q40_video_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 2 x 2 made-up pixels on two cameras, written as videos without compression, and decoded from them."""
    root = folder(spark, "films").removeprefix("file://")
    shown = lambda key: F.unhex(F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(f"/{key}"))), 1, 24)).alias(key)
    rows = adapters.event_frames(spark, sf_dir).select("episode_index", "task", "ts", "event_id", *map(shown, adapters.CAMERAS))
    features = {key: {"dtype": "video", "shape": [2, 2, 3]} for key in adapters.CAMERAS}
    rows = rows.withColumn("event", F.col("event_id")).drop("event_id")
    writer.write_dataset(rows, root, fps=adapters.FPS, features=features | {"event": {"dtype": "int64", "shape": [1]}}, order_by=["ts", "event"], rgb_codec="plain", suffix=".raw", video_files_size_in_mb=0.05)
    found = video.frames(Dataset(spark, root), video.ALL, max_output_bytes=1 << 16, batch_size=512)
    return found.select("episode_index", "frame_index", "video_key", F.hex("image").alias("pixels"), "width", "height", "channels")
