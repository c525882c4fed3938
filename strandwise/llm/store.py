"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own where it is unset and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or f"file://{tempfile.gettempdir()}/strandwise-checkpoints").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandwise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_recorders: list[list[str]] = []


@contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Add the paths of the tables that are stored meanwhile."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.remove(paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    It cuts lineage so that a lost executor costs one stage, gives the next join the true size of
    its side, and leaves both sides of that join as plain exchanges, which AQE can split when a key is hot.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    # Shuffle files of finished stages are removed only once the driver has collected its garbage, which a driver with little to
    # do seldom does; PySpark has no call of its own for it.
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def leaving(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables stored meanwhile, but for those that the block puts into the list it is given."""
    paths: list[str] = []
    kept: list[DataFrame] = []
    with recording(paths):
        yield kept
    stay = {df.stored_at for df in kept}
    for path in paths:
        if path not in stay:
            remove(spark, path)


def settle(spark: SparkSession, seconds: float = 1.0) -> None:
    """Let go of the shuffles of what was stored last, where the next step's are large: Spark's own listeners hold a query for a moment after its end."""
    time.sleep(seconds)
    spark._jvm.System.gc()
    time.sleep(seconds)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() gave; what was computed from them and isn't stored can't be read any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
