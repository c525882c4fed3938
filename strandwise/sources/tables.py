"""Stored tables that are merged into: the last row of a key stays, and a job that is repeated or fails leaves one version."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the most bases of a reference that is taken in.
MOST_BASES = 100_000


def scratch(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or f"file://{tempfile.gettempdir()}/strandwise-checkpoints").rstrip("/")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None before its first rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def last_of(rows: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """The last row of each key by order (nulls first), whole, or the first one (nulls last); of equal ones any."""
    fields = [c for c in rows.columns if c not in keys]
    if fields == order and len(order) == 1:  # what rows go by is all that they have
        return rows.groupBy(*keys).agg((F.min if first else F.max)(order[0]).alias(order[0])).select(rows.columns)
    by = F.min_by if first else F.max_by
    last = by(F.struct(*fields), F.struct(*[F.struct(F.col(c).isNull() if first else F.col(c).isNotNull(), c) for c in order]))
    return rows.groupBy(*keys).agg(last.alias("__row")).select(*keys, "__row.*").select(rows.columns)


def merge(path: str, rows: DataFrame, keys: list[str], order: list[str], buckets: int = 64, first: bool = False) -> None:
    """Put rows into the table at path: of each key, the last row by order of old and new ones stays, or the first one.

    The table is dealt into buckets by the hash of its keys. Only buckets that the rows touch are read and written: to a folder beside
    the table first, then in one dynamic overwrite of these buckets. A job that ends in between has left the table as it was, and
    the same rows once more change nothing. Writers must take turns.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    old = stored(spark, path)
    if old is not None:
        touched = F.broadcast(new.select("bucket").distinct())  # 64 rows
        new = new.unionByName(old.join(touched, "bucket", "left_semi").select(new.columns))
    merged = last_of(new, [*keys, "bucket"], order, first)
    beside = f"{path}.merging"
    merged.repartition("bucket").write.mode("overwrite").parquet(beside)
    spark.read.schema(merged.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_references(path: str, references: DataFrame) -> None:
    """Put references (name, bases, version) into the table at path: a name keeps its latest version.

    Bases go in upper case. Rows without a name, or with more than MOST_BASES bases or none, are refused: the job fails and the table stays.
    """
    refused = F.col("name").isNull() | (F.coalesce(F.length("bases"), F.lit(0)) == 0) | (F.length("bases") > MOST_BASES)
    if not references.where(refused).isEmpty():
        raise ValueError(f"references need a name and 1 to {MOST_BASES} bases")
    merge(path, references.withColumn("bases", F.upper("bases")), ["name"], ["version", "bases"])


def replace_annotations(path: str, annotations: DataFrame) -> None:
    """Replace the annotations of the references that are named in annotations (reference_id and more); others stay.

    A reference is a partition of the table, overwritten as a whole: what it had is gone, and a repeated job leaves the same. A row whose
    start_pos is null stands for a reference without annotations.
    """
    annotations.repartition("reference_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reference_id").parquet(path)


def read_annotations_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("start_pos is not null")
