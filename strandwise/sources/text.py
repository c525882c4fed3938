"""FASTA and annotation text as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, bases) of each record: the header's first word, the lines in upper case joined. What stands before the first
    header is left out; a > within a line starts no record. A record is one row, read by the line break and > before it, so a
    file of many records splits among tasks."""
    text = spark.read.option("lineSep", "\n>").text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    text = text.withColumn("at", F.monotonically_increasing_id())
    # no line break stands before a file's first row: it is a record only if it starts with >
    first = text.where("block = 0").groupBy("file").agg(F.min("at").alias("at")).withColumn("first", F.lit(True))
    rows = text.join(F.broadcast(first), ["file", "at"], "left")  # one row for each file
    rows = rows.where("first is null or startswith(value, '>')").select(F.when(F.col("first"), F.expr("substr(value, 2)")).otherwise(F.col("value")).alias("value"))
    lines = rows.select(F.transform(F.split("value", r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\r"))).alias("l")).where(F.get("l", F.lit(0)) != "")
    bases = F.upper(F.array_join(F.slice("l", 2, F.size("l")), ""))
    return lines.select(F.split(F.get("l", F.lit(0)), r"\s+")[0].alias("name"), bases.alias("bases"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, start_pos, end_pos, feature_type, gene_name) of lines with five or more words; # starts a comment."""
    words = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(F.split(F.trim("value"), r"\s+").alias("w"))
    return words.where(F.size("w") >= 5).select(F.col("w")[0].alias("sequence"), F.col("w")[1].cast("bigint").alias("start_pos"), F.col("w")[2].cast("bigint").alias("end_pos"), F.col("w")[3].alias("feature_type"), F.col("w")[4].alias("gene_name"))
