"""Stored tables after repeated, failed and partial jobs; a stream whose batches come twice."""

import pytest
from pyspark.sql import functions as F

from strandwise.operators import spectrum
from strandwise.sources import tables
from strandwise.streaming import spectra

REFS = "name string, bases string, version int"


def state(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("name", "bases", "version").collect()))


def test_upsert_keeps_the_last_version(spark, tmp_path):
    path = str(tmp_path / "refs")
    first = spark.createDataFrame([(f"r{k}", "acgt" * (k + 1), 1) for k in range(40)] + [("r3", "TT", 0)], REFS)
    tables.upsert_references(path, first)
    want = {f"r{k}": ("ACGT" * (k + 1), 1) for k in range(40)}
    assert state(spark, path) == sorted((n, *v) for n, v in want.items())
    second = spark.createDataFrame([("r1", "GGG", 2), ("r2", "old", 0), ("new", "CC", 1)], REFS)
    want |= {"r1": ("GGG", 2), "new": ("CC", 1)}
    for _ in range(2):  # a repeated job changes nothing
        tables.upsert_references(path, second)
        assert state(spark, path) == sorted((n, *v) for n, v in want.items())
    tables.upsert_references(path, first)
    assert state(spark, path) == sorted((n, *v) for n, v in want.items())


def test_refused_and_failed_halves_leave_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "refs")
    tables.upsert_references(path, spark.createDataFrame([("a", "ACGT", 1), ("b", "AC", 1)], REFS))
    before = state(spark, path)
    for bad in [("x", "A" * 100_001, 1), (None, "A", 1), ("x", "", 1), ("x", None, 1)]:
        with pytest.raises(ValueError):
            tables.upsert_references(path, spark.createDataFrame([("a", "T", 9), bad], REFS))
    tables.upsert_references(path, spark.createDataFrame([("c", "A" * 100_000, 1)], REFS))
    before = sorted([*before, ("c", "A" * 100_000, 1)])
    assert state(spark, path) == before
    broken = spark.createDataFrame([("a", "T", 9), ("d", "T", 1)], REFS).withColumn("version", F.when(F.col("name") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("version")).cast("int"))
    with pytest.raises(Exception, match="lost"):  # ends while it writes beside the table
        tables.upsert_references(path, broken)
    assert state(spark, path) == before
    tables.upsert_references(path, spark.createDataFrame([("a", "T", 9)], REFS))
    assert ("a", "T", 9) in state(spark, path) and len(state(spark, path)) == 3


def test_annotations_of_a_reference_are_replaced(spark, tmp_path):
    path = str(tmp_path / "annotations")
    rows = lambda *x: spark.createDataFrame([(r, s, s and s + 9, "exon") for r, s in x], "reference_id int, start_pos long, end_pos long, feature_type string")
    tables.replace_annotations(path, rows((1, 5), (1, 50), (2, 5), (3, 7)))
    for _ in range(2):
        tables.replace_annotations(path, rows((1, 8), (3, None)))
    assert sorted((r.reference_id, r.start_pos) for r in tables.read_annotations_of(spark, path).collect()) == [(1, 8), (2, 5)]


def test_a_batch_twice_changes_nothing(spark, tmp_path):
    kind = "alignment_id long, variant_id long, reference_id long, ref_pos long, variant_type string, ref_base string, alt_base string"
    rows = [(k % 13, k, k % 2, k % 17, "SNP", "A", "CG"[k % 3 == 0]) for k in range(300)]
    links = spark.createDataFrame([(s, a) for a in range(13) for s in {a % 5, a % 3}], "sample_id long, alignment_id long")
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):  # each a file, the second one's rows again in the third
        spark.createDataFrame(rows[max(0, k * 100 - 50) : k * 100 + 100], kind).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    spectra.grow_spectrum(stream(), links, path, str(tmp_path / "seen")).awaitTermination()
    want = sorted(map(tuple, spectrum.variant_spectrum(links, spark.createDataFrame(rows, kind)).collect()))
    got = lambda: sorted(map(tuple, spectra.grown_spectrum(spark, path).collect()))
    assert got() == want
    spectra.merge_batch(path, spectra.carried(links, spark.createDataFrame(rows[40:160], kind)))  # replayed
    assert got() == want
    spectra.grow_spectrum(stream(), links, path, str(tmp_path / "lost")).awaitTermination()  # the whole stream again, its checkpoint lost
    assert got() == want
    spark.createDataFrame([(1, 900, 0, 99, "DEL", "A", "")], kind).coalesce(1).write.mode("append").parquet(source)
    spectra.grow_spectrum(stream(), links, path, str(tmp_path / "seen")).awaitTermination()
    assert {x for x in got() if x[2] == 99} == {(1, 0, 99, "DEL", "A", "", 1, 900)}


def test_first_and_last_rows_and_what_a_batch_stores(spark, tmp_path):
    """A merged batch stores what it is named by and the least variant_id alone, nulls giving way."""
    rows = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("a", None, 3), ("b", None, 4), ("c", 5, 5)], "k string, n int, x int")
    of = lambda df: {tuple(r) for r in df.collect()}
    assert of(tables.last_of(rows, ["k"], ["n"], first=True)) == {("a", 1, 2), ("b", None, 4), ("c", 5, 5)}
    assert of(tables.last_of(rows, ["k"], ["n"])) == {("a", 3, 1), ("b", None, 4), ("c", 5, 5)}
    alone = rows.select("k", "n")
    assert of(tables.last_of(alone, ["k"], ["n"], first=True)) == {("a", 1), ("b", None), ("c", 5)}
    assert of(tables.last_of(alone, ["k"], ["n"])) == {("a", 3), ("b", None), ("c", 5)}
    batch = spark.createDataFrame([(1, 0, 5, "SNP", "A", "C", 7, v) for v in (9, 4, None)], "sample_id long, reference_id long, ref_pos long, variant_type string, ref_base string, alt_base string, alignment_id long, variant_id long")
    for _ in range(2):
        spectra.merge_batch(str(tmp_path / "t"), batch)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert set(got.columns) == {*spectra.CARRIED, "variant_id", "bucket"} and [r.variant_id for r in got.collect()] == [4]
