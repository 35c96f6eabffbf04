"""Small intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import DatasetError


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or, where the session has none and one machine does all, below the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise DatasetError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or os.path.join(tempfile.gettempdir(), 'framestride')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is computed once, however often a plan uses it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task numbers.
ONE = 100_000


def ranked(df: DataFrame, order: list, name: str, add: str | None = None) -> DataFrame:
    """df as a table with _rank, its place in an order from 0, and, with add, _before: the sum of that column over all earlier rows.

    Beyond ONE rows they are sorted in ranges and numbered within them, so no task sees them all; the
    driver gets one row a range.
    """
    df = kept(df, name)
    if df.count() <= ONE:
        place = Window.orderBy(*order)
        out = df.withColumn("_rank", (F.row_number().over(place) - 1).cast("bigint"))
        return out.withColumn("_before", (F.sum(add).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(add)).cast("bigint")) if add else out
    spot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = kept(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), spot.alias("_spot")), name)
    total = F.sum(add).cast("bigint") if add else F.lit(0).cast("bigint")
    rank, before, base = 0, 0, []
    for part, n, s in table.groupBy("_part").agg(F.count("*"), total).orderBy("_part").collect():
        base.append((part, rank, before))
        rank, before = rank + n, before + s
    told = df.sparkSession.createDataFrame(base, "_part int, _first bigint, _sum bigint")
    rows = table.join(F.broadcast(told), "_part").withColumn("_rank", F.col("_first") + F.col("_spot"))
    if add:
        own = F.sum(add).over(Window.partitionBy("_part").orderBy("_spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(add)
        rows = rows.withColumn("_before", (F.col("_sum") + own).cast("bigint"))
    return rows.drop("_part", "_spot", "_first", "_sum")
