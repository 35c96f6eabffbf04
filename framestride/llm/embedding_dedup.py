"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Vectors are compared only within one label. Equal vectors of a label are one point with a count.
Centroids are fitted on a bounded sample; every point is then assigned to its nearest centroid, its
home cell, and also visits each cell in which a linked point can be at home. For a point x with home
centroid c0, a point y with cosine(x, y) >= t that is at home at c needs y.c >= y.c0, and y lies
within the angle acos(t) of x; so x.(c0 - c) <= |c0 - c| sin(acos(t)). No link is lost that way,
however the centroids lie. A cell in which more than CELL points are at home gets centroids of its
own, fitted on a sample of it, and its points are assigned to those by the same rule, level after
level; so cells grow in number with the data, not in size. Within a cell, home points are dealt into
blocks of about BLOCK, and all points of the cell stream past each block as matrix products in double
precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

THRESHOLD = 0.98
#: Points that the first centroids are fitted on, and those of any other cell, at most; all points are indexed.
SAMPLE = 4096
#: Centroids of one level, points of a sample for each, and home points above which a cell is divided.
CELLS, EACH, CELL = 16, 8, 2048
#: Levels of cells within cells; points that so many do not tell apart are compared in blocks.
LEVELS = 12
ROUNDS = 8
#: Home points in a block, and rows of a divided cell that one task assigns, about.
BLOCK, RUN = 1024, 20_000
#: For rounding in the bound on cells; links themselves are decided by THRESHOLD alone.
SLACK = 1e-9


def fit(points: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means: k unit centroids of unit points."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(points)))
    centre = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        home = np.argmax(points @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, points)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centre)
    return centre


def cells(x: np.ndarray, centre: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, cell, at_home): each unit point's home cell and the cells it visits."""
    dot = x @ centre.T
    home = np.argmax(dot, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T))
    reach = apart[home] * math.sqrt(1 - threshold * threshold) + SLACK
    near = dot[np.arange(len(x)), home][:, None] - dot <= reach
    near[np.arange(len(x)), home] = True
    point, cell = np.nonzero(near)
    return point, cell, home[point] == cell


def units(vectors: list | np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; what cannot have one is not finite."""
    x = np.asarray(vectors, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        # Scaled by the largest component first, so that no square overflows or vanishes.
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, v, h): vectors and the hash of their directions; h is null where a vector can be linked with nothing."""
    for part in parts:
        column = part.column("embedding")
        flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        at = column.offsets.to_numpy()
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False) & part.column("label").is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        h: list = [None] * part.num_rows
        for width in set(size.tolist()) - {0}:
            own = np.flatnonzero(size == width)
            x = flat[at[own][:, None] + np.arange(width)]
            unit = units(x)
            for i in np.flatnonzero(np.isfinite(x).all(1) & np.isfinite(unit).all(1)):
                h[own[i]] = hashlib.md5(unit[i].tobytes()).digest()
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "label")), column, pa.array(h, pa.binary())], ["vec_id", "label", "v", "h"])


_PLACED = ["label", "id", "n", "v", "cell", "home"]


def _placed(part: pa.RecordBatch, rows: np.ndarray, centre: np.ndarray | None, threshold: float, above: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows of part in their cells; a cell's name is that of the cell above and its own number.

    Vectors of unlike lengths are never linked; those unlike the centroids have a cell of their own.
    A point that only visits the cell above is at home in none below.
    """
    vectors = part.column("v").take(pa.array(rows)).to_pylist()
    own = np.array([centre is not None and len(v) == centre.shape[1] for v in vectors], bool)
    point, cell, home = [np.flatnonzero(~own)], [np.full((~own).sum(), -1)], [np.ones((~own).sum(), bool)]
    if own.any():
        p, c, h = cells(units([v for v, o in zip(vectors, own, strict=True) if o]), centre, threshold)
        point.append(np.flatnonzero(own)[p])
        cell.append(c)
        home.append(h)
    point, cell, home = map(np.concatenate, (point, cell, home))
    at = pa.array(rows[point])
    if above is not None:
        home &= above[point]
        names = [f"{x}.{c}" for x, c in zip(part.column("cell").take(at).to_pylist(), cell.tolist(), strict=True)]
    else:
        names = [str(c) for c in cell.tolist()]
    return pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("label", "id", "n", "v")), pa.array(names, pa.string()), pa.array(home, pa.bool_())], _PLACED)


def _assign(centre: np.ndarray, threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, RUN):
                yield _placed(part, np.arange(at, min(part.num_rows, at + RUN)), centre, threshold)

    return run


def _fit_cell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, cell, sample): the centroids of each cell's sample, as one list, and their width."""
    for part in parts:
        out = []
        for sample in part.column("sample").to_pylist():
            width = max(map(len, sample))
            own = [v for v in sample if len(v) == width]
            centre = fit(units(own), max(2, min(CELLS, len(own) // EACH)))
            out.append((centre.ravel().tolist(), width))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "cell")), pa.array([x for x, _ in out], pa.list_(pa.float64())), pa.array([x for _, x in out], pa.int32())], ["label", "cell", "centre", "width"])


def _divide(threshold: float):
    """Rows come sorted by (label, cell, run), the row with the centroids first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for part in parts:
            label, cell, no, width = (part.column(c).to_pylist() for c in ("label", "cell", "run", "width"))
            turn = [i for i in range(part.num_rows) if not i or (label[i], cell[i], no[i]) != (label[i - 1], cell[i - 1], no[i - 1]) or width[i - 1] is not None]
            for at, to in zip(turn, [*turn[1:], part.num_rows], strict=True):
                if width[at] is not None:
                    key, centre = (label[at], cell[at], no[at]), np.array(part.column("centre")[at].as_py()).reshape(-1, width[at])
                    continue
                if key != (label[at], cell[at], no[at]):
                    raise AssertionError("a divided cell has centroids")
                rows = np.arange(at, to)
                yield _placed(part, rows, centre, threshold, np.array(part.column("home").take(pa.array(rows)).to_pylist(), bool))

    return run


def _divided(placed: DataFrame, threshold: float) -> DataFrame:
    """placed with cells of more than CELL home points divided, level after level."""
    done, kinds = None, dict(placed.dtypes)
    for _ in range(LEVELS):
        size = placed.groupBy("label", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("n"))
        big = shared.cut(size.where(F.col("homes") > CELL), "embed-big")
        if big.isEmpty():
            break
        told = F.broadcast(big) if big.count() <= 10_000 else big
        split = placed.drop("n").join(told, ["label", "cell"])
        # A sample by hash, of a size that does not depend on the cell's; the collected lists are bounded by it.
        chosen = split.where(F.col("home") & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(1 << 30) * F.lit(1.0 * CELLS * EACH) / F.col("homes")))
        centre = chosen.groupBy("label", "cell").agg(F.collect_list("v").alias("sample")).mapInArrow(_fit_cell, f"label {kinds['label']}, cell string, centre array<double>, width int")
        centre = shared.cut(centre, "embed-centres").join(big, ["label", "cell"])
        rest = placed.join(centre.select("label", "cell"), ["label", "cell"], "left_anti").select(*_PLACED)
        runs = F.ceil(F.col("n") / RUN)
        first = centre.select("label", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), runs - 1)).alias("run"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("id", "n", "v", "home")), "centre", "width")
        rows = placed.withColumnRenamed("n", "many").join(told, ["label", "cell"]).join(centre.select("label", "cell"), ["label", "cell"], "left_semi")
        rows = rows.select("label", "cell", F.pmod(F.xxhash64("id"), runs).alias("run"), "id", F.col("many").alias("n"), "v", "home", F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("int").alias("width"))
        both = first.unionAll(rows).repartition("label", "cell", "run").sortWithinPartitions("label", "cell", "run", F.col("width").isNull())
        done = rest if done is None else done.unionAll(rest)
        # Where points stay together whatever the centroids are, further levels change nothing; LEVELS ends that.
        placed = shared.cut(both.mapInArrow(_divide(threshold), f"label {kinds['label']}, id binary, n bigint, v {kinds['v']}, cell string, home boolean"), "embed-cells")
    return placed.select(*_PLACED) if done is None else done.unionAll(placed.select(*_PLACED))


def _merge(linked: np.ndarray) -> np.ndarray:
    """Least row of each row's component, for a block's links (rows x columns), and of the columns'."""
    rows, columns = linked.shape
    root = np.arange(rows)
    while True:
        down = np.where(linked, root[:, None], rows).min(0) if rows else np.zeros(columns)
        up = np.where(linked, down[None, :], rows).min(1) if columns else root
        new = np.minimum(root, up)
        if (new == root).all():
            return root, down
        root = new


def _block(threshold: float):
    """Rows come sorted by (label, cell, block), the home points first. Emits (a, b, n): a is linked with b, n vectors.

    Per home point and batch there is one row with the number of vectors it is linked with, and one
    row per point that ties it to a representative of its linked points in the batch.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes = None, {}
        for part in parts:
            if not part.num_rows:
                continue
            label, cell, block, home, ids = (part.column(c).to_pylist() for c in ("label", "cell", "block", "as_home", "id"))
            n, vectors = part.column("n").to_numpy(), part.column("v")
            size = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            turn = [i for i in range(part.num_rows) if not i or (label[i], cell[i], block[i], home[i]) != (label[i - 1], cell[i - 1], block[i - 1], home[i - 1])]
            for at, to in zip(turn, [*turn[1:], part.num_rows], strict=True):
                if key != (label[at], cell[at], block[at]):
                    key, homes = (label[at], cell[at], block[at]), {}
                for width in np.unique(size[at:to]).tolist():
                    rows = at + np.flatnonzero(size[at:to] == width)
                    unit, names = units(vectors.take(pa.array(rows)).to_pylist()), np.array([ids[i] for i in rows], object)
                    if home[at]:
                        had = homes.get(width)
                        homes[width] = (unit, names) if had is None else (np.concatenate([had[0], unit]), np.concatenate([had[1], names]))
                        continue
                    if width not in homes:
                        continue
                    x, hid = homes[width]
                    linked = x @ unit.T >= threshold
                    i, j = np.nonzero(linked)
                    same = hid[i] == names[j]
                    linked[i[same], j[same]] = False
                    total = linked @ n[rows]
                    root, down = _merge(linked)
                    some, met = np.flatnonzero(total), np.flatnonzero(linked.any(0))
                    a = np.concatenate([hid[some], hid[down[met]], hid[root[some]]])
                    b = np.concatenate([hid[some], names[met], hid[some]])
                    c = np.concatenate([total[some], np.zeros(len(met) + len(some), np.int64)])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.binary()), pa.array(b.tolist(), pa.binary()), pa.array(c.astype(np.int64))], ["a", "b", "n"])

    return run


def groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label).

    Vectors that are null, empty, zero or hold a null or non-finite component, and vectors without a
    label, link with nothing: n_links 0, their own component, kept. Vectors of unlike lengths are not
    linked. Rows that repeat a vec_id are vectors of their own that share a name; a null vec_id is
    larger than any in choosing component_id, and is null there only if all are. Equal vectors, ties,
    are one point whose links count for each of them. Extra columns are not read, whatever their
    names; an empty table gives no rows.
    """
    kind = dict(vectors.dtypes)
    # Vectors move in their own precision; directions are computed in double precision wherever they are needed.
    hashed = vectors.select("vec_id", "label", "embedding").mapInArrow(shared.tidy(_hashed), f"vec_id {kind['vec_id']}, label {kind['label']}, v {kind['embedding']}, h binary")
    keyed = hashed.where("h is not null")
    point = keyed.groupBy("label", "h").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    name = F.unhex(F.md5(F.concat(F.encode(F.col("label").cast("string"), "UTF-8"), F.unhex(F.lit("00")), "h")))
    point = shared.cut(point.withColumn("id", name), "embed-points")
    total, width = point.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = shared.pick(point.where(F.size("v") == width).select("h", "label", "v"), SAMPLE, "h", "label").collect()
    sample = units([r["v"] for r in sorted(sample, key=lambda r: (r["h"], str(r["label"])))])
    centre = fit(sample, max(1, min(CELLS, len(sample) // EACH)))
    placed = point.select("label", "id", "n", "v").mapInArrow(shared.tidy(_assign(centre, threshold)), f"label {kind['label']}, id binary, n bigint, v {kind['embedding']}, cell string, home boolean")
    placed = _divided(shared.cut(placed, "embed-cells"), threshold)
    blocks = shared.cut(placed.where("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "embed-blocks")
    dealt = placed.join(F.broadcast(blocks) if blocks.count() <= shared.HOT else blocks, ["label", "cell"])
    own = F.struct(F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(True).alias("as_home"))
    past = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), F.lit(False).alias("as_home")))
    rows = dealt.select("label", "cell", "id", "n", "v", F.explode(F.when(F.col("home"), F.concat(F.array(own), past)).otherwise(past)).alias("to")).select("label", "cell", "to.*", "id", "n", "v")
    rows = rows.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", F.desc("as_home"))
    found = shared.cut(rows.mapInArrow(shared.tidy(_block(threshold)), "a binary, b binary, n bigint"), "embed-links")
    many = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    root = shared.components(found.where("a != b").select("a", "b"))
    named = point.select("id", "label", "h", "n", "least").join(root.withColumnRenamed("node", "id"), "id", "left").join(many, "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    # A table of its own, so that the join has an exchange on either side, whose hot roots can be split.
    least = shared.cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "embed-least")
    named = named.join(least, "root").select("label", "h", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    alone = hashed.where("h is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = keyed.select("vec_id", "label", "h").join(shared.cut(named, "embed-named"), ["label", "h"])
    return linked.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionAll(alone)
