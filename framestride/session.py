"""Readies a session for the package's Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch, at most: a worker holds a few batches, whatever the length of the rows.
BATCH = 2 << 20


def reachable(spark: SparkSession) -> SparkSession:
    """Workers get the folder that holds this package on their path, for sessions that share it.

    On a cluster whose machines do not, ship the package with --py-files as usual. Arrow batches are
    kept to BATCH bytes, unless the session's own limit is lower.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark
