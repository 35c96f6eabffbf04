import random

import pytest
from helpers import made
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framestride.errors import DatasetError
from framestride.operators import temporal
from framestride.sources.dataset import Dataset

COLUMNS = "request_id bigint, episode_index bigint, frame_index bigint, delta_index bigint"
OFFSETS = [-3, 0, 1, 7, -1]


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    return made(tmp_path_factory.mktemp("t") / "set", 21, gaps=True)


@pytest.fixture(scope="module")
def ds(spark, model):
    return Dataset(spark, model.root)


def ask(ds, rows, schema=COLUMNS):
    return ds.spark.createDataFrame(rows, schema)


def brute(model, row):
    """Offset, padding flag and target of a request, one at a time."""
    _, e, f, d = row
    to, last = f + OFFSETS[d], model.length[e] - 1
    return (*row, OFFSETS[d] / model.fps, OFFSETS[d], not 0 <= to <= last, 0 if to < 0 else last if to > last else to)


@pytest.mark.parametrize("seed", range(3))
def test_targets(ds, model, seed):
    rng = random.Random(seed)
    frames = [rng.choice(model.frames) for _ in range(40)]
    asked = [(rng.randint(-5, 5), e, f, rng.randrange(len(OFFSETS))) for e, f, *_ in frames]
    asked += asked[:3]
    got = temporal.targets(ds, ask(ds, asked), delta_timestamps=[o / model.fps for o in OFFSETS])
    assert got.columns == ["request_id", "target_ordinal", "episode_index", "frame_index", "delta_index", "delta_timestamp", "delta_frame_offset", "is_padding", "target_frame_index"]
    assert sorted(r["target_ordinal"] for r in got.collect()) == list(range(len(asked)))
    assert sorted(map(tuple, got.drop("target_ordinal").collect())) == sorted(brute(model, r) for r in asked)


def test_columns_match_in_any_case_and_order_and_are_cast(ds, model):
    e = next(e for e, n in model.length.items() if n > 1)
    asked = ask(ds, [(str(e), 2**62, "1", "-9", "1")], "Episode_Index string, TARGET_ID bigint, delta_index string, Request_ID string, FRAME_index string")
    row = temporal.targets(ds, asked, delta_timestamps=[o / model.fps for o in OFFSETS]).first()
    assert (row["request_id"], row["target_id"], row["target_frame_index"], row["is_padding"]) == (-9, 2**62, 1, False)


@pytest.mark.parametrize(
    ("change", "what"),
    [
        ({0: None}, "input column 'request_id' must not contain NULL"), ({3: None}, "input column 'delta_index' must not contain NULL"), ({1: -4}, "'episode_index' must be non-negative"), ({2: -4}, "'frame_index' must be non-negative"), ({3: 99}, "delta_index 99 is outside delta_timestamps length 5"),
        ({3: -6}, "delta_index -6 is outside"), ({1: 777}, "episode 777 does not exist"), ({2: 555}, "frame 555 is outside episode"),
    ],
)
def test_bad_rows_raise_before_any_filter(ds, model, change, what):
    e, f, *_ = model.frames[0]
    good = (1, e, f, 0)
    bad = tuple(change.get(i, v) for i, v in enumerate(good))
    with pytest.raises(DatasetError, match=what):
        temporal.targets(ds, ask(ds, [good, bad]), delta_timestamps=[o / model.fps for o in OFFSETS])


@pytest.mark.parametrize("drop", ["request_id", "frame_index", "delta_index"])
def test_relations_without_a_column(ds, drop):
    with pytest.raises(DatasetError, match="input relation"):
        temporal.targets(ds, ask(ds, []).drop(drop))


@pytest.mark.parametrize("more", ["other", "delta"])
def test_relations_with_a_column_too_many(ds, more):
    with pytest.raises(DatasetError, match="input relation"):
        temporal.targets(ds, ask(ds, []).withColumn(more, F.lit(1)))


def test_guards_survive_pruning(ds):
    rows = ds.spark.range(3)
    bad = temporal.guard(rows, F.when(F.col("id") == 2, "bad row"))
    with pytest.raises(Exception, match="bad row"):
        bad.count()
    assert temporal.guard(rows, F.when(F.col("id") == 9, "bad row")).count() == 3


def test_empty_requests_and_deltas(ds, model):
    assert temporal.targets(ds, ask(ds, [])).count() == 0
    with pytest.raises(DatasetError, match="outside delta_timestamps length 0"):
        temporal.targets(ds, ask(ds, [(1, *model.frames[0][:2], 0)]), delta_timestamps=[])


def test_half_even_and_tolerance():
    halves = [s * f / 4096 for f in (0.5, 1.5, 2.5) for s in (-1, 1)]
    assert [d.frames for d in temporal.deltas(halves, 4096, 0.0001220703125)] == [0, 0, -2, 2, -2, 2]
    with pytest.raises(DatasetError, match="not a multiple of 1/fps"):
        temporal.deltas([0.05], 10)
    for bad in (None, [None], [float("nan")], [float("inf")], [1e300]):
        with pytest.raises(DatasetError):
            temporal.deltas(bad, 10)
    for bad in (None, 0, -1, float("nan"), float("inf")):
        with pytest.raises(DatasetError):
            temporal.check_tolerance(bad)


@given(st.integers(-(10**6), 10**6), st.integers(1, 240))
def test_whole_frames_are_found_again(frames, fps):
    assert temporal.deltas([frames / fps], fps)[0].frames == frames


def test_clamp_near_the_ends_of_integers(spark):
    big = 2**63 - 1
    rows = spark.createDataFrame([(0, 5, big), (4, 5, -big), (2, 5, 1), (big - 1, big, 1), (big - 1, big, 0)], "frame_index bigint, length bigint, o bigint")
    got = [(r["is_padding"], r["target_frame_index"]) for r in temporal.clamp(rows, F.col("o")).collect()]
    assert got == [(True, 4), (True, 0), (False, 3), (True, big - 1), (False, big - 1)]
