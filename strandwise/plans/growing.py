"""Queries on stored tables that are merged into, and on streams of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables
from ..sources.projection import VIEWS, view
from ..streaming import spectra
from .genomics import BASE, QUERIES, SPEC, SQL, query  # noqa: F401  its queries join those of genomics


def new_table(spark) -> str:
    return f"{tables.scratch(spark)}/strandwise-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query("""SELECT 'g' || genome_id AS name, coalesce(s.bases, g.bases) AS bases FROM genome g LEFT JOIN (SELECT * FROM strain WHERE strain = 2) s USING (genome_id)""", ("genome", "strain"))
def upserted_references(spark, d):
    """Genomes first, then a strain of each as a newer version, then the genomes once more, as a repeated job would."""
    path = new_table(spark)
    name = F.concat(F.lit("g"), F.col("genome_id").cast("string")).alias("name")
    first = view(spark, d, "genome").select(name, "bases", F.lit(1).alias("version"))
    for rows in (first, view(spark, d, "strain").where("strain = 2").select(name, "bases", F.lit(2).alias("version")), first):
        tables.upsert_references(path, rows)
    return spark.read.parquet(path).select("name", "bases")


@query("""SELECT reference_id, annotation_id, start_pos, end_pos FROM annotation WHERE reference_id >= 3 OR feature_type = 'exon'""", ("annotation",))
def replaced_annotations(spark, d):
    """All annotations, then those of three references replaced by their exons, twice."""
    path = new_table(spark)
    rows = view(spark, d, "annotation")
    exons = rows.where("reference_id < 3 and feature_type = 'exon'")
    for part in (rows, exons, exons):
        tables.replace_annotations(path, part)
    return tables.read_annotations_of(spark, path).select(F.col("reference_id").cast("bigint").alias("reference_id"), "annotation_id", "start_pos", "end_pos")


@query(SPEC + "SELECT * FROM spectrum", BASE)
def grown_spectrum(spark, d):
    """The spectrum of the variants as a stream of the table's files, with the first batch merged once more."""
    path = new_table(spark)
    source = f"{d}/lineitem.parquet"
    lines = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/lineitem[.]parquet")  # as a pattern: a stream's folder can't be one file
    variants = spark.sql(VIEWS["variant"][1].replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
    links = view(spark, d, "link")
    spectra.grow_spectrum(variants, links, path, f"{path}-checkpoint").awaitTermination()
    spectra.merge_batch(path, spectra.carried(links, view(spark, d, "variant").where("variant_id % 7 = 0")))
    return spectra.grown_spectrum(spark, path)
