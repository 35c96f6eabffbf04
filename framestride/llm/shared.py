"""Spark plumbing of the training-data operators: shared scratch tables and components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that all executors share.

    Only where the session has no such setting and one machine does all the work (local tests) is a
    folder of our own used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "framestride-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the scratch table that cut() made; for tables that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Graphs of at most so many links (below 10 MB) are worked through in one task.
LOCAL_LINKS = 200_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that links reach.

    Large-star and small-star rounds: each round keeps at most one row per edge, and every table is
    cut in the shared folder. A graph of LOCAL_LINKS links or fewer is read by a single task instead,
    with the same result. Nulls and self links are ignored. No row reaches the driver but the count
    and checksum that tell when a round changes nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and hi != lo").distinct()
    kind = dict(e.dtypes)["hi"]
    e, last = cut(e, name), None
    if e.count() <= LOCAL_LINKS:
        return e.coalesce(1).mapInArrow(_union_find, f"node {kind}, root {kind}")
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        new = cut(small.select("e.hi", "e.lo").where("hi != lo").distinct(), name)
        sign = [x.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first() for x in ([e] if last is None else []) + [new]]
        before, last = (sign[0] if last is None else last), sign[-1]
        drop(e)
        e = new
        if before == last:
            roots = e.select("lo").distinct()
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots.select("lo", "lo"))


def _union_find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kind = pa.binary()
    for part in parts:
        kind = part.column(0).type
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "root"])


#: Rows of the bitmap of apart() at most, of 64 bits each: below 16 MB when broadcast.
SLOTS = 1 << 18


def apart(rows: DataFrame, keys: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(the rows whose values of names are surely in no row of keys, the others), without moving a row.

    A bitmap of the keys' hashes with a fixed bound on its size is broadcast. The others hold all
    rows that are in keys and some that are not, so a join with keys must follow; with more keys than
    the bitmap can tell apart nearly all rows are among them, and the join does all the work. keys is
    a table, read twice.
    """
    slots = min(SLOTS, 1 << max(10, (keys.count() // 4).bit_length()))
    h = F.xxhash64(*names)
    slot, bit = F.pmod(F.shiftright(h, 6), F.lit(slots)).alias("_slot"), h.bitwiseAND(F.lit(63)).cast("int")
    bits = keys.select(slot, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    told = rows.select("*", slot, bit.alias("_place")).join(F.broadcast(bits), "_slot", "left")
    maybe = F.coalesce(F.getbit("_bits", F.col("_place")) == 1, F.lit(False))
    return tuple(told.where(x).select(*rows.columns) for x in (~maybe, maybe))


#: Heads with more than one run that are broadcast, at most: below 8 MB.
HOT = 100_000


def dealt(pairs: DataFrame, head: str, member: str, run: int) -> DataFrame:
    """pairs (a table) with a column salt, which deals the members of each head over runs of about `run`."""
    hot = cut(pairs.groupBy(head).agg(F.ceil(F.count("*") / run).alias("runs")).where("runs > 1"), "hot-heads")
    hot = F.broadcast(hot) if hot.count() <= HOT else hot
    return pairs.join(hot, head, "left").withColumn("salt", F.pmod(F.xxhash64(member), F.coalesce("runs", F.lit(1))).cast("int")).drop("runs")


def sql_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(sql_path(sf_dir, name))
    return df.select(*columns) if columns else df


def trim() -> None:
    """Give a worker's freed memory back: workers stay alive between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that ends with trim()."""

    @functools.wraps(run)
    def tidied(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            trim()

    return tidied


def pick(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """About `limit` rows of df, those whose keys' hash is least: a filter, so no task gathers more than its share.

    The threshold follows from the number of rows; twice the limit is never passed.
    """
    n = df.count()
    if n <= limit:
        return df
    least = int(-(2**63) + 2**64 * limit / n)
    return df.where(F.xxhash64(*keys) < least).limit(2 * limit)
