"""The corpus pipeline: five stages from documents to piece ids, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import bloom_dedup, jaccard_join, piece_matching, poisson_mix, quality_rules
from strandwise.llm.store import materialize, recording, remove

#: The share of a source in the mix goes with its rows to this power.
TEMPER = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Inner tables that stages called by hand have left, by folder: (stage, path).
_by_folder: dict[str, list[tuple[str, str]]] = {}


def _stage(function: Stage) -> Stage:
    """A stage whose inner tables are deleted as another stage of its run begins, unless that stage's docs still read them.

    run() keeps a list of its own, so that runs don't touch each other's tables. Stages called by hand share a list for each folder; two
    results of one stage never delete each other's.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, left: list[tuple[str, str]] | None = None) -> DataFrame:
        left = _by_folder.setdefault(sf_dir, []) if left is None else left
        others = [x for x in left if x[0] != function.__name__]
        read = docs.inputFiles() if others else []
        for name, path in others:
            if not any(path.rsplit("/", 1)[1] in f for f in read):
                remove(spark, path)
                left.remove((name, path))
        paths: list[str] = []
        try:
            with recording(paths):
                return function(spark, docs, sf_dir)
        finally:
            left += [(function.__name__, path) for path in paths]

    return run_stage


def _beside(docs: DataFrame, taken: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs, those named like the operator's own (taken) too."""
    held = {c: f"__held_{c}" for c in docs.columns if c in taken}
    return work(docs.withColumnsRenamed(held)).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns of docs.

    Null and blank texts and those below 20 words go. Repeated rows all stay or all go. All columns pass
    through, whatever their names. An empty table gives an empty table.
    """
    return _beside(docs, quality_rules.OUT, lambda d: quality_rules.judge(d).where("kept"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id.

    Null counts as the empty text, a null doc_id as the largest. Of rows that repeat one stays. All columns pass through,
    whatever their names. An empty table gives an empty table.
    """
    return _beside(docs, bloom_dedup.OUT, lambda d: bloom_dedup.exact_dedup(d).where("kept"))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their shingles, the one with the smallest doc_id.

    Documents without a word, or whose group has null doc_ids only, stay; rows that repeat stay together. All columns pass through.
    An empty table gives an empty table.
    """
    return jaccard_join.near_dedup(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a random order.

    A null source is a source of its own. Rows that repeat are drawn alike. All columns pass through, whatever their
    names. An empty table gives an empty table.
    """
    rates = poisson_mix.tempered_rates(docs, TEMPER)
    return _beside(docs, poisson_mix.OUT, lambda d: poisson_mix.poisson_mix(d, rates))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and piece ids of each row; null and empty texts have none. An empty table gives an empty table."""
    coded = piece_matching.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", "piece_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing to target weights", mix),
    ("piece encoding", encode),
]

#: SQL can't express the stages' estimation, components and merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, piece_ids) of the documents that are left, one row for each repetition that the mix draws.

    The stages' docstrings tell what becomes of nulls, blanks, repeated rows, clashing columns and empty tables. Each stage's
    output is stored once; it is deleted, with the stage's inner tables, when the stage after it has been stored.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    left: list[tuple[str, str]] = []
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir, left=left)
            if k < len(STAGES) - 1:
                before, docs = path, materialize(docs, name.replace(" ", "-"))
                path = docs.stored_at
                if before:
                    remove(spark, before)
    except BaseException:  # nothing of a run that fails is left
        for gone in [*(x for _, x in left), *([path] if path else [])]:
            remove(spark, gone)
        raise
    return docs
