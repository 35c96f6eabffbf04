import json
import random

import pytest
from helpers import KEYS, info, made, write
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framestride.errors import DatasetError
from framestride.sources.dataset import Dataset, binary_as_string
from framestride.sources.info import parse
from framestride.sources.writer import write_dataset


@pytest.fixture(params=[3, 14])
def model(request, tmp_path):
    return made(tmp_path / "set", request.param, gaps=request.param % 2 == 0)


@pytest.fixture
def ds(spark, model):
    return Dataset(spark, model.root)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def held(ds):
    """What the cache holds: per component whether it is kept; its entries and bytes say the same."""
    got = ds.cache_info().collect()
    assert all(r["entries"] == int(r["cached"]) and (r["bytes"] > 0) == r["cached"] for r in got)
    return {r["component"] for r in got if r["cached"]}


NAMES = ["episode_index", "frame_index", "timestamp", "value"]


def test_scans_are_the_frames_of_the_episodes_and_of_their_files_alone(ds, model):
    assert rows(ds.scan().select(NAMES)) == sorted(model.frames)
    assert len(ds.scan().inputFiles()) == len(set(model.shard.values()))
    rng = random.Random(1)
    for _ in range(6):
        wanted = rng.choices([*model.length, 500], k=rng.randint(1, 4))
        got = ds.scan(wanted)
        assert rows(got.select(NAMES)) == sorted(r for r in model.frames if r[0] in wanted)
        if set(wanted) & set(model.length):
            assert {f.removeprefix("file://") for f in got.inputFiles()} == {model.path(*model.shard[e]) for e in wanted if e in model.shard}
            assert "episode_index" in got.select("value")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


@pytest.mark.parametrize("wanted", [[], [500], [10**12, 500, 500]])
def test_selections_without_a_match_keep_the_schema(ds, wanted):
    assert (ds.scan(wanted).columns, ds.scan(wanted).count()) == (NAMES, 0)
    assert ds.scan(wanted, union_by_name=True).columns == [*NAMES, "extra"]


def test_parquet_options(ds, model):
    df = ds.scan(union_by_name=True, filename=True, file_row_number=True)
    assert df.columns == [*NAMES, "extra", "filename", "file_row_number"]
    at = {}
    for e, f, _, v in model.frames:
        shard = model.shard[e]
        at[shard] = at.get(shard, -1) + 1
        assert df.where(f"episode_index = {e} and frame_index = {f}").select("extra", "filename", "file_row_number").collect() == [(f"x{v}" if shard[0] else None, model.path(*shard), at[shard])]
    assert ds.scan(filename="origin").columns[-1] == "origin"
    with pytest.raises(DatasetError, match="already have"):
        ds.scan(filename="value")
    for option in ("filename", "file_row_number", "union_by_name", "binary_as_string"):
        with pytest.raises(DatasetError, match=f"{option} must not be NULL"):
            ds.scan(**{option: None})
    with pytest.raises(TypeError):
        ds.scan(unknown_option=True)


@pytest.mark.parametrize(("bad", "what"), [(None, "must not be NULL"), ([4, None], "contain NULL"), ([3, -2], "non-negative")])
def test_bad_episode_lists(ds, bad, what):
    with pytest.raises(DatasetError, match=what):
        ds.video_routes(bad)
    if bad is not None:
        with pytest.raises(DatasetError, match=what):
            ds.scan(bad)


@pytest.mark.parametrize(("keys", "what"), [([KEYS[0], None], "contain NULL"), (["", KEYS[1]], "empty key"), (["none such"], "Unknown video key")])
def test_bad_keys(ds, keys, what):
    with pytest.raises(DatasetError, match=what):
        ds.video_routes([0], video_keys=keys)


def test_bad_flags_and_roots(ds):
    for f in (ds.tasks, ds.episodes, ds.stats, ds.info):
        with pytest.raises(DatasetError, match="refresh must not be NULL"):
            f(refresh=None)
    with pytest.raises(DatasetError, match="root must not be NULL"):
        Dataset(ds.spark, None)


def test_video_routes(ds, model):
    def want(episodes, keys):
        return [(e, k, f"{ds.place}/film/{k}/{c}-{f}.bin", c, f, a, b, model.fps) for (e, k), (c, f, a, b) in sorted(model.routes.items()) if e in episodes and k in keys]

    rng = random.Random(2)
    for keys in (None, [KEYS[1]], [KEYS[1], KEYS[0], KEYS[1]], []):
        asked = rng.choices([*model.length, 500], k=5)
        assert [tuple(r) for r in ds.video_routes(asked, video_keys=keys).collect()] == want(asked, KEYS if keys is None else keys)
    assert ds.video_routes([]).count() == 0


def test_metadata_relations(ds, model):
    assert ds.info().select("fps").first()[0] == model.fps
    assert rows(ds.episodes().select("episode_index", "length")) == sorted(model.length.items())
    assert rows(ds.tasks()) == model.tasks


def test_cache(ds, model):
    assert held(ds) == set() == held(ds)
    ds.episodes(), ds.tasks()
    assert held(ds) == set()
    ds.scan(list(model.length)[:1])
    assert held(ds) == {"data"}
    ds.video_routes([0])
    assert held(ds) == {"data", "video"}
    ds.episodes(refresh=True)
    assert held(ds) == set()
    assert {r["root"] for r in Dataset(ds.spark, "/not/there").cache_info().collect()} == {"/not/there"}


def test_many_files_are_not_looked_up_by_a_task_each(spark, tmp_path):
    n, conf = 40, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    rows = spark.range(n).select(F.col("id").alias("episode_index"), F.lit("t").alias("task"), F.col("id").cast("int").alias("o"), F.col("id").cast("float").alias("action"))
    write_dataset(rows, str(tmp_path / "d"), features={"action": {"dtype": "float32", "shape": [1]}}, order_by="o", fps=10, data_files_size_in_mb=1e-6, metadata_buffer_size=1)
    made, before, tracker = Dataset(spark, str(tmp_path / "d")), spark.conf.get(conf), spark.sparkContext.statusTracker()
    assert len(list((tmp_path / "d/meta/episodes").rglob("*.parquet"))) == n
    spark.sparkContext.setJobGroup("looked-up", "files of a dataset")
    try:
        frames, episodes = made.scan(), made.episodes()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("looked-up")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s)]
    assert tasks and max(tasks) <= 4 and spark.conf.get(conf) == before
    assert len(frames.inputFiles()) == n and len(episodes.inputFiles()) == n
    assert sorted(r["action"] for r in frames.collect()) == list(range(n)) and episodes.count() == n


def test_a_changed_info_is_noticed(ds, model):
    assert ds.scan().count() == len(model.frames)
    info(model.root, **json.load(open(f"{model.root}/meta/info.json")) | {"total_frames": 987654})
    with pytest.raises(DatasetError, match="declares 987654 frames"):
        ds.scan()


def _with(values, i, value):
    return [value if j == i else v for j, v in enumerate(values)]


@pytest.mark.parametrize(
    ("column", "change", "what"),
    [
        ("episode_index", lambda v: _with(v, 1, v[0]), "Duplicate episode_index"), ("episode_index", lambda v: _with(v, 2, -7), "non-negative"), ("length", lambda v: _with(v, 3, 0), "must be positive"),
        ("length", lambda v: _with(v, 4, None), "must not contain NULL"), ("length", lambda v: _with(v, 5, v[5] + 1), "frames, but episode metadata"), ("data/file_index", lambda v: _with(v, 0, None), "must not contain NULL"),
    ],
)
def test_bad_episodes(ds, model, column, change, what):
    model.save_episodes(**{column: change(model.episode_columns()[column])})
    with pytest.raises(DatasetError, match=what):
        ds.scan()


@pytest.mark.parametrize(
    ("column", "change", "what"),
    [
        ("to_timestamp", lambda v: _with(v, 1, None), "partially NULL"), ("from_timestamp", lambda v: _with(v, 2, 10**6 * 1.0), "Invalid video timestamp range"), ("to_timestamp", lambda v: _with(v, 3, float("inf")), "Invalid video timestamp range"),
        ("from_timestamp", lambda v: _with(v, 0, float("nan")), "Invalid video timestamp range"), ("chunk_index", lambda v: _with(v, 4, -1), "non-negative"),
    ],
)
def test_bad_routes(ds, model, column, change, what):
    name = f"videos/{KEYS[0]}/{column}"
    model.save_episodes(**{name: change(model.episode_columns()[name])})
    assert ds.scan().count() == len(model.frames)
    with pytest.raises(DatasetError, match=what):
        ds.video_routes([0])


def test_cameras_must_not_share_a_file(ds, model):
    info(model.root, **json.load(open(f"{model.root}/meta/info.json")) | {"video_path": "film/{chunk_index}/{file_index}.bin"})
    both = [e for e in model.length if (e, KEYS[1]) in model.routes]
    assert both
    with pytest.raises(DatasetError, match="is shared by feature keys"):
        ds.video_routes(both)


BASE = {"codebase_version": "v3.0", "data_path": "d", "fps": 10, "total_episodes": 1, "total_frames": 1, "total_tasks": 0, "video_path": "v/{video_key}", "features": {}}
QUANT = {"video.depth_min": 0.01, "video.depth_max": 10.0, "video.shift": 3.5, "video.use_log": True, "video.pix_fmt": "gray12le"}


@pytest.mark.parametrize(
    ("change", "what"),
    [
        ({"codebase_version": "v2.1"}, "requires a v3"), ({"fps": None}, "requires non-NULL"), ({"fps": 0}, "fps must be positive"), ({"fps": 29.97}, "must be an integer"), ({"total_tasks": -1}, "non-negative"),
        ({"total_frames": 0}, "both be zero"), ({"video_path": None, "features": {"a": {"dtype": "video"}}}, "requires video_path"), ({"features": {"a": {}}}, "non-NULL dtype"),
        ({"features": {"a.b": {"dtype": "int64"}, "A.B": {"dtype": "int64"}}}, "Duplicate"), ({"features": {"a/b": {"dtype": "int64"}}}, "portable"), ({"features": {"a": {"dtype": "int64", "shape": [0]}}}, "must be positive"),
        ({"total_episodes": 0, "total_frames": 0}, "must not be empty"), ({"total_episodes": 0, "total_frames": 0, "features": {"a": {"dtype": "odd", "shape": [1]}}}, "unsupported dtype"),
        ({"total_episodes": 0, "total_frames": 0, "features": {"a": {"dtype": "image", "shape": [2, 2]}}}, "three-dimensional"), ({"total_episodes": 0, "total_frames": 0, "features": {"a": {"dtype": "image", "shape": [2, 2, 4]}}}, "3 HWC"),
        ({"features": {"d": {"dtype": "video", "shape": [2, 2, 1], "info": {"is_depth_map": True}}}}, "requires video.depth_min"), ({"features": {"d": {"dtype": "video", "shape": [2, 2, 1], "info": QUANT}}}, "is not true"),
        ({"features": {"d": {"dtype": "video", "shape": [2, 2, 3], "info": {"video.is_depth_map": True}}}}, "legacy"), ({"features": {"d": {"dtype": "video", "shape": [2, 2, 1], "info": QUANT | {"is_depth_map": True, "video.pix_fmt": "gray"}}}}, "gray12le"),
        ({"features": {"d": {"dtype": "video", "shape": [2, 2, 1], "info": QUANT | {"is_depth_map": True, "video.depth_max": 0.001}}}}, "invalid quantization"), ({"storage_format": "Zip File"}, "storage_format"),
        ({"storage_format": "lance", "features": {"a.b": {"dtype": "int64", "shape": [1]}, "a_B": {"dtype": "int64", "shape": [1]}}}, "collide"),
    ],
)
def test_bad_info(change, what):
    with pytest.raises(DatasetError, match=what):
        parse(json.dumps(BASE | change))


def test_info_that_is_fine():
    got = parse(json.dumps(BASE | {"codebase_version": "3.1", "features": {"d": {"dtype": "video", "shape": [2, 2, 1], "info": QUANT | {"is_depth_map": True}}, "v": {"dtype": "video", "info": {"video.is_depth_map": False}}}}))
    assert [f.name for f in got.videos] == ["d", "v"] and got.video("d").depth.log
    with pytest.raises(DatasetError, match="Duplicate"):
        parse('{"fps": 1, "fps": 2}')
    with pytest.raises(DatasetError, match="exactly one"):
        parse("{} {}")


def test_table_formats_need_a_source(spark, tmp_path):
    from framestride.sources import dataset as module

    root = str(tmp_path / "set")
    info(root, storage_format="lance", total_frames=2, features={"a.b": {"dtype": "int32", "shape": [1]}, "episode_index": {"dtype": "int64", "shape": [1]}})
    write(f"{root}/meta/episodes/e.parquet", {"episode_index": [0], "length": [2], "data/chunk_index": [0], "data/file_index": [0]})
    ds = Dataset(spark, root)
    with pytest.raises(DatasetError, match="needs a table source"):
        ds.scan()
    module.TABLE_SOURCES["lance"] = lambda s, p: s.createDataFrame([(7, 0), (8, 0)], "a_b bigint, episode_index bigint")
    try:
        assert ds.scan([0]).schema.simpleString() == "struct<a.b:int,episode_index:bigint>"
        assert rows(ds.scan()) == [(7, 0), (8, 0)]
        with pytest.raises(DatasetError, match="options do not apply"):
            ds.scan(filename=True)
    finally:
        module.TABLE_SOURCES.clear()


def test_empty_datasets(spark, tmp_path):
    root = str(tmp_path / "set")
    info(root, total_episodes=0, total_frames=0, video_path="v/{video_key}", features={"s": {"dtype": "float32", "shape": [2]}, "n": {"dtype": "uint64", "shape": [1]}, "i": {"dtype": "image", "shape": [2, 2, 3]}, "v": {"dtype": "video", "shape": [2, 2, 3]}})
    ds = Dataset(spark, root)
    assert ds.scan(filename=True, binary_as_string=True).dtypes == [("s", "array<float>"), ("n", "decimal(20,0)"), ("i", "struct<bytes:string,path:string>"), ("filename", "string")]
    assert ("stats/n/min", "array<decimal(20,0)>") in ds.episodes().dtypes and len(ds.episodes().columns) == 7 + 4 + 40 + 2
    assert [x.count() for x in (ds.scan([1]), ds.tasks(), ds.stats(), ds.video_routes([1]))] == [0] * 4


def test_binary_as_string_goes_into_nested_types():
    from pyspark.sql.types import _parse_datatype_string as kind

    assert binary_as_string(kind("map<string, array<struct<a: binary, b: int>>>")).simpleString() == "map<string,array<struct<a:string,b:int>>>"


def test_a_missing_root(spark, tmp_path):
    with pytest.raises(DatasetError, match="no file"):
        Dataset(spark, str(tmp_path / "none")).scan()
    with pytest.raises(PySparkException):
        Dataset(spark, str(tmp_path / "none")).info().collect()
