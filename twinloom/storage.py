"""Shared scratch space and partitioning."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, from ``spark.checkpoint.dir``.

    Where nothing is configured, a session that runs in one process gets a folder in its
    warehouse, deleted at its end; on a cluster that is an error, as executors must share it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"
            own = urlparse(configured).path
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably, so later passes see the same rows after an executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """DataFrames made in here remove their shuffle files as soon as they are written or checkpointed.

    Else these files stay until the driver happens to collect its garbage. Not for a DataFrame that is
    handed on: whoever runs it twice would shuffle twice.
    """
    before = spark.conf.get(REMOVAL, None)
    spark.conf.set(REMOVAL, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVAL)
        else:
            spark.conf.set(REMOVAL, before)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition compact rows that the next step multiplies.

    A fixed partition count keeps adaptive execution from merging the partitions by their
    size before the expansion.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism), *keys)
