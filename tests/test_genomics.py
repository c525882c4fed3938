"""Each genomic query against its SQL in DuckDB, and operators on small fixtures."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandwise.functions import bases
from strandwise.operators import cohort, rules, signatures, spectrum
from strandwise.plans import genomics
from strandwise.sources.text import read_annotations, read_fasta

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rounded(rows, names):
    return sorted((tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(genomics.SQL))
def test_query_is_its_sql(spark, duck, name):
    df = genomics.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = duck.execute(genomics.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    assert rounded([r.asDict() for r in df.collect()], names) == rounded([dict(zip(columns, r, strict=True)) for r in got.fetchall()], names)


def test_entry(spark):
    assert "density" in entry.entry(spark).columns


def test_haplotype_blocks_need_all_pairs(spark):
    near = {(100, 200), (100, 300), (200, 300), (400, 500), (400, 600), (500, 600)}
    pos = [100, 200, 300, 400, 500, 600]
    rows = [(i, j, 0.95 if (i, j) in near else 0.1) for k, i in enumerate(pos) for j in pos[k + 1 :]]
    got = cohort.haplotype_blocks(spark.createDataFrame(rows, "i bigint, j bigint, r2 double"), 0.8).collect()
    assert sorted(map(tuple, got)) == [(100, 300, 3), (400, 600, 3)]
    chain = [(100, 200, 0.95), (200, 300, 0.95), (300, 400, 0.95), (100, 300, 0.1), (100, 400, 0.1), (200, 400, 0.1)]
    got = cohort.haplotype_blocks(spark.createDataFrame(chain, "i bigint, j bigint, r2 double"), 0.8).collect()
    assert sorted(map(tuple, got)) == [(100, 200, 2), (300, 400, 2)]


def test_context_is_pyrimidine_based(spark):
    row = spark.range(1).select(signatures.context_type(*map(F.lit, ("C", "G", "A", "A"))), signatures.context_type(*map(F.lit, ("A", "C", "G", "T")))).first()
    assert tuple(row) == ("T[C>T]G", "A[C>T]G")


def test_reduced_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "source int, target int")
    assert sorted(map(tuple, cohort.reduced(edges).collect())) == [(1, 2), (2, 3)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>r1 first\nacg\n\nTT\n>r2\nggg\n")
    (tmp_path / "a.gff").write_text("# no\nr1 1 5 exon G1\nr1 7 9 intron\n")
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("r1", "ACGTT"), ("r2", "GGG")]
    assert [tuple(r) for r in read_annotations(spark, str(tmp_path / "a.gff")).collect()] == [("r1", 1, 5, "exon", "G1")]


def test_fasta_headers_start_a_line(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\nACGT\n>r1 a>b\nacg\n\nTT\n>r2\n")
    (tmp_path / "b.fa").write_bytes(b">x y\r\nac\r\n>z\r\nGG")
    got = sorted(map(tuple, read_fasta(spark, str(tmp_path)).collect()))
    assert got == [("r1", "ACGTT"), ("r2", ""), ("x", "AC"), ("z", "GG")]


def test_score_of_equal_rows_and_without_rules(spark):
    rows = spark.createDataFrame([("1", 7), ("1", 7), (None, None)], "kind string, pos int")
    some = spark.createDataFrame(
        [("kind", "eq", "1.0", 100), ("kind", "eq", "1", 2), ("kind", "gt", "0", 100), ("pos", "eq", "7.0", 3), ("pos", "gte", "x", 100)],
        "field string, op string, value string, weight int",
    )
    assert sorted(r.score for r in rules.score_variants(rows, some, ["kind", "pos"]).collect()) == [0, 105, 105]  # text that is a number is above another
    assert [r.score for r in rules.score_variants(rows, some.limit(0), ["kind", "pos"]).collect()] == [0, 0, 0]


def test_codons_dates_and_sites(spark):
    codons = spark.createDataFrame([("atg",), ("TAA",), ("TTT",), ("GGG",), ("ANG",), ("AT",), ("CAGT",)], "c string")
    assert [r[0] for r in codons.select(bases.translate_codon(F.col("c"))).collect()] == ["M", "*", "F", "G", "X", "X", "X"]
    year = spark.sql("SELECT DATE'2023-07-16' AS d").select(bases.decimal_year(F.col("d"))).first()[0]
    assert abs(year - (2023 + 6 / 12 + 15 / 365.25)) < 1e-9
    changes = {"AG", "GA", "CT", "TC"}

    def by_hand(x, y):
        a, b = bases.CODES.get(x), bases.CODES.get(y)
        if not a or not b:
            return None
        if a == b and len(a) == 1:
            return "same"
        kinds = {"transition" if p + q in changes else "transversion" for p in a for q in b if p != q}
        return "transversion" if "transversion" in kinds else "transition"

    pairs = [(x, y) for x in [*bases.CODES, "-", "Z"] for y in [*bases.CODES, "-", "Z"]]
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", bases.site_class(F.col("x"), F.col("y")).alias("k")).collect()
    assert all(r.k == by_hand(r.x, r.y) for r in got)


def test_quality_control_at_the_ends(spark):
    """The start's distance is the position, the end's is counted from 1; position 0 falls into the last bucket."""
    row = lambda p: (1, 1, p, "SNP", "A", "C", 1, 50.0)
    schema = "sample_id int, reference_id int, ref_pos int, variant_type string, ref_base string, alt_base string, depth int, best_score double"
    table = spark.createDataFrame([row(p) for p in (0, 50, 51, 500, 501, 1150, 1151, 1199)], schema)
    length = spark.createDataFrame([(1200,)], "length int")
    out = rules.qc(table, 30, 1, 50, length)
    assert {r.ref_pos for r in out.where("qc_status = 'FAIL'").collect()} == {0, 50, 1151, 1199}
    assert sorted((r.bucket, r.passed, r.failed) for r in rules.qc_buckets(out, length).collect()) == [(0, 2, 1), (1, 1, 0), (2, 1, 3)]


def test_annotations_of_another_reference_are_no_hit(spark):
    v = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 3, 10)], "variant_id int, reference_id int, ref_pos bigint")
    a = spark.createDataFrame([(7, 2, 0, 20, "exon", "g"), (5, 1, 5, 15, "UTR", "h"), (6, 1, 0, 20, "exon", "g")], "annotation_id int, reference_id int, start_pos bigint, end_pos bigint, feature_type string, gene_name string")
    got = {r.variant_id: (r.annotation_id, r.feature_type) for r in spectrum.annotate_first(v, a).collect()}
    assert got == {1: (5, "UTR"), 2: (7, "exon"), 3: (None, "intergenic")}
