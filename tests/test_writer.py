import json
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framestride.errors import DatasetError
from framestride.functions import images
from framestride.operators import video
from framestride.sources import writer
from framestride.sources.dataset import Dataset

FRAMES = "episode_index bigint, task string, o int, state array<float>, action float"
FEATURES = {"state": {"dtype": "float32", "shape": [2], "names": ["x", "y"]}, "action": {"dtype": "float32", "shape": [1]}}


LENGTHS, TASKS = [3, 1, 4, 2, 2], ["stack", "sort", "stack", "pour", "sort"]


def shuffled(spark, seed=8):
    """Episodes of LENGTHS frames with random values, in random order; and the rows as they should come back."""
    rng = np.random.default_rng(seed)
    rows = [(e, TASKS[e], int(10 * o + rng.integers(10)), [float(np.float32(x)) for x in rng.normal(size=2)], float(np.float32(rng.normal()))) for e, n in enumerate(LENGTHS) for o in range(n)]
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], FRAMES), rows


def small(spark):
    return shuffled(spark)[0]


def slow_stats(values):
    """Statistics of float32 values by a plain loop: pairs of neighbours are added level by level below blocks of eight."""
    x = np.asarray(values, np.float32)
    mean = np.float32(np.add.reduce(x) / np.float32(len(x)))
    off = np.array([(v - mean) * (v - mean) for v in x], np.float32)
    return {"min": float(min(x)), "max": float(max(x)), "mean": float(mean), "std": float(np.sqrt(np.float32(np.add.reduce(off) / np.float32(len(x)))))}


def write(df, root, features=FEATURES, **options):
    return writer.write_dataset(df, str(root), features=features, order_by="o", **({"fps": 10} | options))


def test_numeric_round_trip(spark, tmp_path):
    df, rows = shuffled(spark)
    told = write(df, tmp_path / "d", robot_type="arm of a test", chunks_size=2, data_files_size_in_mb=0.000001, metadata_buffer_size=2)
    ds, n = Dataset(spark, str(tmp_path / "d")), len(rows)
    assert told["total_frames"] == n and ds.meta().tasks == 3 and ds.info().select("robot_type").first()[0] == "arm of a test"
    order = list(dict.fromkeys(TASKS))
    frame = [o for k in LENGTHS for o in range(k)]
    got = [(r["episode_index"], r["frame_index"], r["index"], r["task_index"], r["state"], r["action"], r["timestamp"]) for r in ds.scan().orderBy("index").collect()]
    assert got == [(r[0], f, i, order.index(r[1]), r[3], r[4], np.float32(f / 10)) for i, (r, f) in enumerate(zip(rows, frame, strict=True))]
    assert sorted(tuple(r) for r in ds.tasks().collect()) == list(enumerate(order))
    # A shard that is full after any episode: one file each, two to a chunk.
    ends = np.cumsum(LENGTHS).tolist()
    names = ["episode_index", "length", "data/chunk_index", "data/file_index", "dataset_from_index", "dataset_to_index"]
    episodes = ds.episodes().orderBy("episode_index").collect()
    assert [tuple(r[n] for n in names) for r in episodes] == [(e, k, e // 2, e % 2, ends[e] - k, ends[e]) for e, k in enumerate(LENGTHS)]
    for e, r in enumerate(episodes):
        want = slow_stats([x[4] for x in rows if x[0] == e])
        assert {k: r[f"stats/action/{k}"][0] for k in want} == pytest.approx(want, rel=1e-6, abs=1e-7) and r["stats/action/count"] == [LENGTHS[e]]
    whole = json.load(open(tmp_path / "d/meta/stats.json"))["action"]
    every = np.array([x[4] for x in rows])
    assert whole["count"] == [n] and whole["mean"][0] == pytest.approx(every.mean(), rel=1e-5) and whole["std"][0] == pytest.approx(every.std(), rel=1e-5)
    assert (whole["min"][0], whole["max"][0]) == (every.min(), every.max())
    shard = pq.read_schema(tmp_path / "d/data/chunk-000/file-000.parquet")
    assert json.loads(shard.metadata[b"huggingface"])["info"]["features"]["state"] == {"feature": {"dtype": "float32", "_type": "Value"}, "length": 2, "_type": "List"}
    assert not [p for p in os.listdir(tmp_path) if ".tmp-" in p]


def test_all_numeric_types_and_nested_shapes(spark, tmp_path):
    kinds = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float64": "double", "bool": "boolean"}
    top = {"int8": 127, "int16": 32767, "int32": 2**31 - 1, "int64": 2**63 - 1, "uint8": 255, "uint16": 65535, "uint32": 2**32 - 1, "uint64": 2**64 - 1, "float64": 0.5, "bool": True}
    from decimal import Decimal

    fix = lambda d, v: Decimal(v) if d == "uint64" else v
    rows = [(e, "t", o, *(fix(d, top[d] if o else (False if d == "bool" else 0.0 if d == "float64" else 0)) for d in kinds), [[o, 2], [3, 4]]) for e in (0, 1) for o in (0, 1)]
    df = spark.createDataFrame(rows, "episode_index bigint, task string, o int, " + ", ".join(f"f_{d} {t}" for d, t in kinds.items()) + ", grid array<array<bigint>>")
    features = {f"f_{d}": {"dtype": d, "shape": [1]} for d in kinds} | {"grid": {"dtype": "int64", "shape": [2, 2]}}
    write(df, tmp_path / "d", features)
    told = json.load(open(tmp_path / "d/meta/stats.json"))
    for d in kinds:
        assert told[f"f_{d}"]["max"][0] == top[d]
    assert told["grid"]["max"] == [[1, 2], [3, 4]] and told["grid"]["count"] == [4]
    back = Dataset(spark, str(tmp_path / "d")).scan([1]).orderBy("frame_index").collect()[1]
    assert back["f_uint64"] == 2**64 - 1 and back["f_int64"] == 2**63 - 1 and back["grid"] == [[1, 2], [3, 4]]
    assert pq.read_schema(tmp_path / "d/data/chunk-000/file-000.parquet").field("f_uint32").type == "uint32"


def test_empty_dataset(spark, tmp_path):
    features = {"s": {"dtype": "float32", "shape": [2]}, "n": {"dtype": "int64", "shape": [1]}, "i": {"dtype": "image", "shape": [2, 2, 3]}, "v": {"dtype": "video", "shape": [2, 2, 3]}, "d": {"dtype": "video", "shape": [2, 2, 1], "info": {"is_depth_map": True}}}
    df = spark.createDataFrame([], "episode_index bigint, task string, o int, s array<float>, n bigint, i binary, v binary, d binary")
    write(df, tmp_path / "d", features)
    assert [p for _, _, f in os.walk(tmp_path / "d") for p in f] == ["info.json"]
    ds = Dataset(spark, str(tmp_path / "d"))
    assert len(ds.scan().columns) == 8 and len(ds.episodes().columns) == 117
    assert ds.meta().video("d").depth.most == 10.0 and ds.stats().count() == 0


def test_images(spark, tmp_path):
    rgb = [np.full((4, 6, 3), v, np.uint8) for v in (20, 30)]
    depth = [np.full((4, 6), v, np.uint16) for v in (1000, 2000)]
    df = spark.createDataFrame([(0, "t", i, rgb[i].tobytes(), depth[i].tobytes()) for i in (0, 1)], "episode_index bigint, task string, o int, cam binary, range binary")
    features = {"cam": {"dtype": "image", "shape": [4, 6, 3]}, "range": {"dtype": "image", "shape": [4, 6, 1], "info": {"is_depth_map": True}}}
    write(df, tmp_path / "d", features)
    ds = Dataset(spark, str(tmp_path / "d"))
    rows = ds.scan().orderBy("frame_index").select("cam.path", "range.path", images.decode_image("cam.bytes").alias("c"), images.decode_image("range.bytes").alias("r")).collect()
    assert [r[0] for r in rows] == ["frame-000000.png", "frame-000001.png"] and rows[1][1] == "frame-000001.tiff"
    assert rows[0]["c"]["image"] == rgb[0].tobytes() and rows[1]["r"]["image"] == depth[1].tobytes()
    told = json.load(open(tmp_path / "d/meta/stats.json"))
    assert round(told["cam"]["mean"][0][0][0], 9) == 0.098039217 and round(told["cam"]["q01"][0][0][0], 9) == 0.078431375 and round(told["cam"]["q90"][0][0][0], 9) == 0.117645491 and told["range"]["max"] == [[[2000.0]]]
    assert ds.info().select("features.range.info.depth_unit").first()[0] == "mm"


def test_video_with_the_plain_codec(spark, tmp_path):
    rows = [(e, "t", o, bytes([10 * e + o]) * 72, np.full(24, 2000 + o, np.uint16).tobytes()) for e in range(3) for o in range(4)]
    df = spark.createDataFrame(rows, "episode_index bigint, task string, o int, front binary, range binary")
    features = {"front": {"dtype": "video", "shape": [4, 6, 3]}, "range": {"dtype": "video", "shape": [4, 6, 1], "info": {"is_depth_map": True}}}
    write(df, tmp_path / "d", features, rgb_codec="plain", suffix=".raw")
    ds = Dataset(spark, str(tmp_path / "d"))
    assert [(r["from_timestamp"], r["to_timestamp"]) for r in ds.video_routes([0, 1, 2], video_keys=["front"]).collect()] == [(0.0, 0.4), (0.4, 0.8), (0.8, 1.2)]
    got = video.frames(ds, [1], video_keys=["front"]).orderBy("frame_index").collect()
    assert [r["image"][0] for r in got] == [10, 11, 12, 13] and "front" not in ds.scan().columns
    mm = video.frames(ds, [0], video_keys=["range"]).orderBy("frame_index").first()
    assert np.frombuffer(mm["image"], np.uint16)[0] == 1999 and mm["channels"] == 1


def test_compressed_video_needs_a_codec(spark, tmp_path):
    df = spark.createDataFrame([(0, "t", 0, b"\0" * 12)], "episode_index bigint, task string, o int, v binary")
    with pytest.raises(DatasetError, match="no codec is registered"):
        write(df, tmp_path / "d", {"v": {"dtype": "video", "shape": [2, 2, 3]}})
    assert not os.listdir(tmp_path)


@pytest.mark.parametrize(
    ("rows", "what"),
    [([(1, "t", 0)], "contiguous"), ([(0, "t", 0), (2, "t", 0)], "contiguous"), ([(0, None, 0)], "must not contain NULL"), ([(None, "t", 0)], "must not contain NULL"), ([(-1, "t", 0), (0, "t", 0)], "contiguous")],
)
def test_bad_episodes(spark, tmp_path, rows, what):
    df = spark.createDataFrame([(*r, [0.0, 0.0], 0.0) for r in rows], FRAMES)
    with pytest.raises(DatasetError, match=what):
        write(df, tmp_path / "d")
    assert not os.listdir(tmp_path)


@pytest.mark.parametrize(("state", "action", "what"), [([0.0], 0.0, "other lengths"), (None, 0.0, "must not be NULL"), ([0.0, None], 0.0, "must not be NULL"), ([0.0, 0.0], None, "must not be NULL"), ([0.0, float("nan")], 0.0, "NaN or infinity")])
def test_bad_values_leave_nothing_behind(spark, tmp_path, state, action, what):
    df = spark.createDataFrame([(0, "t", 0, [0.0, 0.0], 0.0), (0, "t", 1, state, action)], FRAMES)
    with pytest.raises(PySparkException, match=what):
        write(df, tmp_path / "d")
    assert not os.listdir(tmp_path)


def test_columns_and_root(spark, tmp_path):
    df = small(spark)
    for bad, what in ((df.drop("action"), "expected exactly"), (df.withColumn("more", F.lit(1)), "expected exactly"), (df.withColumn("action", F.lit(1.0)), "has type double; expected float")):
        with pytest.raises(DatasetError, match=what):
            write(bad, tmp_path / "d")
    os.makedirs(tmp_path / "there")
    with pytest.raises(DatasetError, match="already exists"):
        write(df, tmp_path / "there")


@pytest.mark.parametrize(
    ("features", "what"),
    [
        ("nonsense", "JSON object"), ({}, "a feature at least"), ({"task": {"dtype": "string", "shape": [1]}}, "generated"), ({"Index": {"dtype": "int64", "shape": [1]}}, "generated"), ({"a": {"dtype": "int64"}}, "one to five"),
        ({"a": {"dtype": "int64", "shape": [1] * 6}}, "one to five"), ({"a": {"dtype": "odd", "shape": [1]}}, "unsupported dtype"), ({"con": {"dtype": "int64", "shape": [1]}}, "portable"), ('{"a": {"dtype": "int64", "shape": [1]}, "a": {}}', "Duplicate"),
        ({"a": {"dtype": "int64", "shape": [1], "info": {"is_depth_map": True}}}, "not visual"),
    ],
)
def test_bad_features(features, what):
    with pytest.raises(DatasetError, match=what):
        writer.parse_features(features)


@pytest.mark.parametrize("option", [{"fps": None}, {"fps": 0}, {"fps": 29.97}, {"chunks_size": 0}, {"rgb_crf": 1.5}, {"rgb_crf": 64}, {"rgb_gop": 0}, {"rgb_codec": "h264"}, {"data_files_size_in_mb": 0}, {"data_files_size_in_mb": float("nan")}, {"depth_min": float("nan")}, {"depth_min": 2, "depth_max": 1}, {"depth_max": 1e39}, {"metadata_buffer_size": 0}])
def test_bad_options(option):
    with pytest.raises(DatasetError):
        writer.Options(**({"fps": 10} | option))


def test_no_row_an_episode_reaches_the_driver(spark, tmp_path, monkeypatch):
    n = 120
    rows = spark.range(2 * n).select(F.floor(F.col("id") / 2).alias("episode_index"), F.concat(F.lit("t"), F.floor(F.col("id") / 6)).alias("task"), F.col("id").cast("int").alias("o"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("state"), F.rand(3).cast("float").alias("action"))
    collect, make, seen = type(rows).collect, type(spark).createDataFrame, []
    monkeypatch.setattr(type(rows), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: seen.append(list(data)) or make(self, data, *a, **k))
    told = write(rows, tmp_path / "d", data_files_size_in_mb=0.02, chunks_size=2, metadata_buffer_size=7)
    monkeypatch.undo()
    assert seen and max(map(len, seen)) <= 20 and (told["total_episodes"], told["total_frames"], told["total_tasks"]) == (n, 2 * n, n // 3)
    ds = Dataset(spark, str(tmp_path / "d"))
    got = ds.episodes(filename=True).orderBy("episode_index").collect()
    assert [(r["episode_index"], r["tasks"], r["dataset_from_index"]) for r in got] == [(e, [f"t{e // 3}"], 2 * e) for e in range(n)]
    # Each row names its own file; files are full when they are left, at multiples of the buffer.
    place = [(r["meta/episodes/chunk_index"], r["meta/episodes/file_index"]) for r in got]
    assert [r["filename"] for r in got] == [f"{tmp_path}/d/meta/episodes/chunk-{c:03d}/file-{f:03d}.parquet" for c, f in place]
    assert place == sorted(place) and len(set(place)) > 2 and all(i % 7 == 0 for i in range(1, n) if place[i] != place[i - 1])
    for name in sorted({r["filename"] for r in got})[:-1]:
        groups = pq.ParquetFile(name).metadata
        sizes = [sum(groups.row_group(i).column(j).total_compressed_size for j in range(groups.num_columns)) for i in range(groups.num_row_groups)]
        full = lambda k: 4 + sum(sizes[:k]) >= 0.02 * 1024 * 1024 / (1 + 1 / (7 * k))  # noqa: B023, E731
        assert full(len(sizes)) and not any(full(k) for k in range(1, len(sizes)))
    whole = json.load(open(tmp_path / "d/meta/stats.json"))
    assert whole["index"]["max"] == [2 * n - 1] and whole["action"]["count"] == [2 * n] and list(whole) == ["state", "action", "timestamp", "frame_index", "episode_index", "index", "task_index"]


def test_plans():
    assert writer.shard_plan([10] * 6, [1] * 6, 25) == [0, 0, 1, 1, 2, 2]
    assert writer.segment_plan([10, 10, 30, 1], 25) == [0, 0, 1, 2]
