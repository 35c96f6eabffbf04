import numpy as np
import pytest

from framestride.llm import embedding_dedup


def brute(rows, threshold=0.98):
    """(n_links, component) per row by all pairs of a label."""
    n = len(rows)
    x, ok = [None] * n, np.zeros(n, bool)
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            a = np.array(v, float) / max(map(abs, v))
            x[i], ok[i] = a / np.linalg.norm(a), True
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                link[i, j] = x[i] @ x[j] >= threshold
    root = np.arange(n)
    while True:
        new = np.array([min([root[i], *root[link[i]]]) for i in range(n)])
        if (new == root).all():
            break
        root = new
    least = {r: min(rows[i][0] for i in range(n) if root[i] == r) for r in set(root.tolist())}
    return sorted((rows[i][0], int(link[i].sum()), least[root[i]]) for i in range(n))


def planted(seed, n=240, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=width) * rng.choice([0.0, 0.1, 0.2, 0.3])
        rows.append((i, [float(c) for c in v.astype(np.float32)], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, monkeypatch, seed):
    """Many small cells and blocks: links across cells and within one point's copies."""
    monkeypatch.setattr(embedding_dedup, "CELLS", 4)
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    monkeypatch.setattr(embedding_dedup, "RUN", 7)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = planted(seed)
    got = embedding_dedup.groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, nan], 0), (5, [1.0, inf], 0), (6, [1.0, None], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [1e300, 2e300], 0), (11, [1e-300, 2e-300], 0), (12, [1.0, 2.0, 0.0], 0), (13, [1.0, 2.0], 1), (14, [-1.0, -2.0], 0)]
    schema = "vec_id bigint, embedding array<double>, label int, cell string"
    got = embedding_dedup.groups(spark.createDataFrame([(*r, "x") for r in rows], schema)).collect()
    seen = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert seen == brute(rows)
    assert [s for s in seen if s[1]] == [(8, 3, 8), (9, 3, 8), (10, 3, 8), (11, 3, 8)]
    assert embedding_dedup.groups(spark.createDataFrame([], schema)).count() == 0
    none = embedding_dedup.groups(spark.createDataFrame([(1, None, 0, "x")], schema)).collect()
    assert [tuple(r) for r in none] == [(1, 0, 1, True)]


def test_cells_reach_every_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + rng.normal(size=(200, 8)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = embedding_dedup.fit(x[:150], 30)
    point, cell, home = embedding_dedup.cells(x, centre)
    own = dict(zip(point[home].tolist(), cell[home].tolist(), strict=True))
    there = set(zip(point.tolist(), cell.tolist(), strict=True))
    for i, j in np.argwhere(x @ x.T >= 0.98):
        assert (i, own[j]) in there
