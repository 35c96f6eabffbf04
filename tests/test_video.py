import math

import numpy as np
import pytest
from helpers import filmed, write
from pyspark.errors import PySparkException

from framestride.errors import DatasetError
from framestride.operators import codecs, lookup, video
from framestride.operators.reader import BatchReader
from framestride.sources.dataset import Dataset

ASK = "request_id bigint, episode_index bigint, frame_index bigint, video_key string, delta_index bigint"


@pytest.fixture
def ds(spark, tmp_path):
    return Dataset(spark, filmed(tmp_path / "set"))


@pytest.fixture
def shot(spark, tmp_path):
    """The same with its media file: four frames at 2 a second, twice."""
    root = filmed(tmp_path / "set", [(0, 0, 0.0), (0, 1, 0.5), (0, 2, 1.0), (0, 3, 1.5), (0, 4, 0.25)])
    frames = [np.full((6, 8, 3), 10 * i, np.uint8) for i in range(4)]
    path = f"{root}/videos/front/file-000.raw"
    import os

    os.makedirs(os.path.dirname(path))
    codecs.PlainCodec().write(path, frames, [0.0, 0.5, 1.0, 1.5])
    return Dataset(spark, root)


def test_metadata_needs_no_media(ds):
    assert video.frames(ds, [0, 1]).count() == 3
    rows = video.frames(ds, [1], width=8, height=6).select("video_timestamp", "width", "height", "channels").collect()
    assert [tuple(r) for r in rows] == [(10.0, 8, 6, 3)]
    with pytest.raises(PySparkException, match="No such file|no codec"):
        video.frames(ds, [0]).select("image").collect()


def test_frames_select(ds):
    assert video.frames(ds, [0, 1, 99], frame_indices=[0]).count() == 2
    assert video.frames(ds, [0], frame_indices=[]).count() == 0
    assert video.frames(ds, [0], video_keys=[]).count() == 0
    with pytest.raises(DatasetError, match="Unknown video key"):
        video.frames(ds, [0], video_keys=["other"])
    with pytest.raises(TypeError):
        video.frames(ds, [0], format="rgb")


def test_windows(ds):
    got = video.windows(ds, [(7, 0, 0)], delta_timestamps=[-0.5, 0.0, 0.5]).orderBy("delta_ordinal")
    assert [(r["is_padding"], r["target_frame_index"], r["video_timestamp"]) for r in got.select("is_padding", "target_frame_index", "video_timestamp").collect()] == [(True, 0, 0.0), (False, 0, 0.0), (False, 1, 0.5)]
    twice = video.windows(ds, [{"request_id": 7, "episode_index": 0, "frame_index": 0}] * 2).select("request_ordinal")
    assert sorted(r[0] for r in twice.collect()) == [0, 1]
    assert video.windows(ds, [(7, 5, 9)], video_keys=[]).count() == 0
    assert video.windows(ds, [(7, 0, 0)], delta_timestamps=[]).count() == 0
    for bad, what in (([(1, None, 0)], "must not contain NULL"), ([(1, 0, 9)], "outside episode 0 length 2"), ([(1, 9, 0)], "does not have every requested"), ([(1, 0, -1)], "non-negative"), ([(1, 0, 0)] * 50_001, "more than 100000")):
        with pytest.raises(DatasetError, match=what):
            video.windows(ds, bad, delta_timestamps=[0.0, 0.5])


def test_targets(ds):
    asked = ds.spark.createDataFrame([(1, 0, 0, "front", 0), (1, 0, 0, "front", 0), (2, 1, 0, "front", 1)], ASK)
    got = video.targets(ds, asked, delta_timestamps=[0.0, 0.5])
    rows = got.select("request_id", "target_ordinal", "target_frame_index", "video_timestamp", "is_padding").collect()
    assert sorted((r[0], r[2], r[3], r[4]) for r in rows) == [(1, 0, 0.0, False), (1, 0, 0.0, False), (2, 0, 10.0, True)]
    assert sorted(r[1] for r in rows) == [0, 1, 2]
    for row, what in (((1, 0, 0, "back", 0), "no video route for key 'back'"), ((1, 0, 0, None, 0), "must not contain NULL"), ((1, 7, 0, "front", 0), "episode 7 does not exist")):
        with pytest.raises(DatasetError, match=what):
            video.targets(ds, ds.spark.createDataFrame([row], ASK))
    with pytest.raises(TypeError):
        video.targets(ds, asked, producer_threads=2)


@pytest.mark.parametrize(
    ("extra", "what"),
    [
        ({"episode_index": [], "frame_index": [], "timestamp": []}, "has no Parquet row"), ({"episode_index": [0, 0], "frame_index": [1, 1], "timestamp": [0.5, 0.5]}, "has 2 Parquet rows"),
        ({"episode_index": [0], "frame_index": [1], "timestamp": [float("nan")]}, "Invalid timestamp"), ({"episode_index": [0], "frame_index": [1], "timestamp": [-1.0]}, "Invalid timestamp"), ({"episode_index": [0], "frame_index": [1], "timestamp": [None]}, "Invalid timestamp"),
    ],
)
def test_a_target_must_have_one_sound_frame(spark, tmp_path, extra, what):
    import pyarrow as pa

    root = filmed(tmp_path / "set")
    base = {"episode_index": [0, 1], "frame_index": [0, 0], "timestamp": [0.0, 0.0]}
    write(f"{root}/data/file-000.parquet", {k: base[k] + extra[k] for k in base}, {"episode_index": pa.int64(), "frame_index": pa.int64(), "timestamp": pa.float64()})
    ds = Dataset(spark, root)
    with pytest.raises(DatasetError, match=what):
        video.targets(ds, spark.createDataFrame([(1, 0, 1, "front", 0)], ASK))
    assert video.targets(ds, spark.createDataFrame([(1, 0, 0, "front", 0)], ASK)).count() == 1


def test_unreadable_frames_that_nothing_asks_for_do_no_harm(spark, tmp_path):
    root = filmed(tmp_path / "set")
    write(f"{root}/data/file-000.parquet", {"episode_index": [0, 0, 1], "frame_index": [0, 1, 0], "timestamp": ["0.0", "soon", "0.0"]})
    ds = Dataset(spark, root)
    assert video.targets(ds, spark.createDataFrame([(1, 0, 0, "front", 0)], ASK)).select("timestamp").first()[0] == 0.0


def test_frames_outside_their_route_fail(spark, tmp_path):
    ds = Dataset(spark, filmed(tmp_path / "set", [(0, 0, 5.0002)], start=0.0))
    with pytest.raises(PySparkException, match="falls outside video route"):
        video.frames(ds, [0]).count()
    assert video.frames(ds, [0], tolerance=0.01).count() == 1


def test_decoding(shot):
    got = video.frames(shot, [0], frame_indices=[0, 1, 2, 3]).orderBy("frame_index").collect()
    assert [(r["decoded_timestamp"], r["width"], r["height"], r["image"][0], len(r["image"])) for r in got] == [(t, 8, 6, 10 * i, 144) for i, t in enumerate((0.0, 0.5, 1.0, 1.5))]
    tie = video.frames(shot, [0], frame_indices=[4], tolerance=0.25, width=4, height=3).first()
    assert (tie["decoded_timestamp"], len(tie["image"])) == (0.0, 36)
    with pytest.raises(PySparkException, match="matched timestamp 0.250000 within tolerance"):
        video.frames(shot, [0], frame_indices=[4]).collect()


def test_batch_reader(shot):
    asked = shot.spark.createDataFrame([(i, 0, i % 4, "front", 0) for i in range(10)], ASK)
    reader = BatchReader(shot, batch_size=4)
    got = list(reader.batches(asked, order_by=["request_id"]))
    assert [b["image"].shape for b in got] == [(4, 6, 8, 3), (4, 6, 8, 3), (2, 6, 8, 3)]
    assert [r for b in got for r in b["request_id"]] == list(range(10))
    assert [int(x[0, 0, 0]) for b in got for x in b["image"]] == [10 * (i % 4) for i in range(10)]
    first = reader.batches(asked, order_by=["request_id"])
    next(first)
    with pytest.raises(DatasetError, match="active iterator"):
        next(iter([reader.batches(asked, order_by=["request_id"])][0]))
    first.close()
    with pytest.raises(DatasetError):
        BatchReader(shot, batch_size=0)


def test_options():
    for bad in ({"width": 1}, {"width": 40000, "height": 1}, {"tolerance": 0.0}, {"cluster_gap": -1.0}, {"batch_size": 0}, {"depth_output_unit": "cm"}, {"codec_threads": 65}, {"max_output_bytes": 0}):
        with pytest.raises(DatasetError):
            video.Options(**bad)


def test_seek_clusters():
    assert video.clusters([0.0, 1.0, 20.0, 29.9], 10.0, 30) == [0, 0, 1, 1]
    far = [10.0 * i for i in range(70)]
    assert video.clusters(far, 10.0, 30) == [i // 67 for i in range(70)]
    assert video.frame_span(0.0, 1.0, 30) == 31


def test_nearest(spark):
    points = spark.createDataFrame([("a", 0.25), ("a", 1.4), ("a", 9.0), ("b", 5.0)], "k string, x double")
    times = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 1.5), ("b", 4.0), ("c", 1.0)], "k string, t double")
    got = sorted(tuple(r) for r in lookup.nearest(points, times, "k", "x", "t", 10.0).collect())
    assert got == [("a", 0.25, 0.0), ("a", 1.4, 1.5), ("a", 9.0, 1.5), ("b", 5.0, 4.0)]
    with pytest.raises(PySparkException, match="within tolerance"):
        lookup.nearest(points, times, "k", "x", "t", 1.0).count()
    assert video.nearest_index(np.array([0.0, 0.5]), 0.25) == 0
    assert math.isclose(video.nearest_index(np.array([0.0, 0.5]), 0.3), 1)
