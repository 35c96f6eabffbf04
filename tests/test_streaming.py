import pytest
from helpers import made

from framestride.operators import temporal
from framestride.sources.dataset import Dataset
from framestride.streaming import requests

SCHEMA = "request_id bigint, episode_index bigint, frame_index bigint, delta_index bigint"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def test_a_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    model = made(tmp_path / "set", 5)
    ds, deltas = Dataset(spark, model.root), [-2 / model.fps, 0.0, 1 / model.fps]
    rows = [(10 * i + d, e, f, d) for i, (e, f, *_) in enumerate(model.frames) for d in range(3)]
    stream = requests.targets(ds, feed(spark, str(tmp_path / "in"), rows), delta_timestamps=deltas)
    q = stream.writeStream.format("memory").queryName("targets").trigger(availableNow=True).start()
    q.awaitTermination()
    want = temporal.targets(ds, spark.createDataFrame(rows, SCHEMA), delta_timestamps=deltas).drop("target_ordinal")
    assert sorted(map(tuple, spark.table("targets").collect())) == sorted(map(tuple, want.select(*stream.columns).collect()))


def test_a_bad_request_fails_its_batch(spark, tmp_path):
    ds = Dataset(spark, made(tmp_path / "set", 6).root)
    stream = requests.targets(ds, feed(spark, str(tmp_path / "in"), [(1, 57, 0, 0)]))
    q = stream.writeStream.format("memory").queryName("bad_targets").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="episode 57 does not exist"):
        q.awaitTermination()
