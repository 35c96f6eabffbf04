import random

import pytest

from framestride import scratch
from framestride.errors import DatasetError


@pytest.mark.parametrize("one", [0, 1000])
def test_ranks_and_running_sums(spark, monkeypatch, one):
    """By one task, and by ranges whose counts and sums are carried on."""
    monkeypatch.setattr(scratch, "ONE", one)
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 50), rng.randint(-5, 5)) for i in range(300)]
    got = scratch.ranked(spark.createDataFrame(rows, "id int, at int, n bigint").repartition(7), ["at", "id"], "ranks", "n").collect()
    want, before = [], 0
    for rank, (i, at, n) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        want.append((i, at, n, rank, before))
        before += n
    assert sorted(tuple(r[c] for c in ("id", "at", "n", "_rank", "_before")) for r in got) == sorted(want)
    assert scratch.ranked(spark.createDataFrame([], "at int"), ["at"], "none").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(DatasetError, match="spark.checkpoint.dir"):
        scratch.folder(Session(), "x")
