"""The driver's tables seen as genomic ones; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark")

#: name -> (driver tables it reads, query)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sample": (("customer", "orders"), """
SELECT c_custkey AS sample_id, c_name AS name, c_mktsegment AS species, d.collection_date
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS collection_date FROM orders GROUP BY o_custkey) d ON o_custkey = c_custkey"""),
    "variant": (("lineitem",), """
SELECT l_orderkey AS alignment_id, l_orderkey * 10 + l_linenumber AS variant_id, l_partkey % 5 AS reference_id, l_partkey AS ref_pos,
  CASE l_returnflag WHEN 'R' THEN 'SNP' WHEN 'A' THEN 'INS' ELSE 'DEL' END AS variant_type,
  substr('ACGT', CAST(1 + l_partkey % 4 AS int), 1) AS ref_base,
  substr('ACGT', CAST(1 + (l_partkey + 1 + l_linenumber % 3) % 4 AS int), 1) AS alt_base
FROM lineitem"""),
    "alignment": (("lineitem",), "SELECT l_orderkey AS alignment_id, max(l_quantity) AS score FROM lineitem GROUP BY l_orderkey"),
    "link": (("orders",), "SELECT o_custkey AS sample_id, o_orderkey AS alignment_id FROM orders"),
    "cohort_link": (("orders", "customer"), "SELECT CAST(c_nationkey AS bigint) AS sample_id, o_orderkey AS alignment_id FROM orders JOIN customer ON o_custkey = c_custkey"),
    "cohort": (("nation", "customer", "orders"), """
SELECT CAST(n_nationkey AS bigint) AS sample_id, n_name AS name, min(o_orderdate) AS collection_date
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name"""),
    "annotation": (("part",), """
SELECT p_partkey AS annotation_id, p_partkey % 5 AS reference_id, 50 * p_partkey AS start_pos, 50 * p_partkey + 39 AS end_pos,
  CASE p_partkey % 4 WHEN 0 THEN 'exon' WHEN 1 THEN 'intron' WHEN 2 THEN 'UTR' ELSE 'exon' END AS feature_type, p_brand AS gene_name
FROM part"""),
    "reference": (("lineitem",), """
SELECT l_partkey % 5 AS reference_id, repeat('ACGT', CAST(floor((max(l_partkey) + 1) / 4) AS int)) AS bases FROM lineitem GROUP BY l_partkey % 5"""),
    "probe": (("benchmark",), "SELECT item_id AS query_id, regexp_replace(upper(text), '[^ACGT]', ''{g}) AS query FROM benchmark"),
    "genome": (("orders",), """
SELECT o_custkey AS genome_id, string_agg(piece, '' ORDER BY o_orderkey) AS bases FROM (
  SELECT o_custkey, o_orderkey, {piece} AS piece FROM orders) AS p GROUP BY o_custkey"""),
    "strain": (("orders",), """
SELECT o_custkey AS genome_id, 1 AS strain, string_agg(piece, '' ORDER BY place) AS bases FROM (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place,
    replace(CASE WHEN o_orderpriority = '1-URGENT' THEN reverse(translate({piece}, 'ACGT', 'TGCA')) ELSE {piece} END, 'GATC', 'GTTC') AS piece FROM orders) AS p GROUP BY o_custkey
UNION ALL
SELECT o_custkey AS genome_id, 2 AS strain, string_agg(piece, '' ORDER BY o_orderkey) AS bases FROM (
  SELECT o_custkey, o_orderkey, replace(CASE WHEN o_orderpriority = '2-HIGH' THEN reverse(translate({piece}, 'ACGT', 'TGCA')) ELSE {piece} END, 'CCGG', 'CCG') AS piece
  FROM orders WHERE o_orderstatus <> 'P') AS p GROUP BY o_custkey"""),
    "strand_annotation": (("part",), """
SELECT p_partkey AS annotation_id, 50 * p_partkey AS start_pos, 50 * p_partkey + 39 AS end_pos, CASE WHEN p_brand < 'Brand#2' THEN '-' WHEN p_brand < 'Brand#4' THEN '+' END AS strand,
  CASE p_partkey % 4 WHEN 0 THEN 'exon' WHEN 1 THEN 'intron' WHEN 2 THEN 'UTR' ELSE 'exon' END AS feature_type, p_brand AS gene_name FROM part"""),
    "protein_domain": (("supplier",), """
SELECT s_suppkey AS domain_id, concat('Brand#', s_nationkey) AS gene_name, s_name AS domain_name, s_suppkey * 7 % 60 AS start_codon, s_suppkey * 7 % 60 + 15 AS end_codon,
  CASE s_suppkey % 5 WHEN 0 THEN 'catalytic' WHEN 1 THEN 'binding' WHEN 2 THEN 'structural' WHEN 3 THEN 'regulatory' ELSE 'linker' END AS domain_type FROM supplier"""),
    "synteny_block": (("lineitem",), """
SELECT l_orderkey AS pair, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS block, 100 * l_linenumber AS a_start,
  100 * l_linenumber + 60 + l_partkey % 90 AS a_end, l_suppkey * 37 % 1000 AS b_start, l_suppkey * 37 % 1000 + 60 + l_partkey % 90 AS b_end,
  1 + l_partkey % 7 AS anchor_count, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS direction FROM lineitem"""),
    "series": (("orders",), """
SELECT o_custkey * 10000 + year(o_orderdate) AS sample_id, max(o_orderdate) AS collection_date FROM orders GROUP BY o_custkey * 10000 + year(o_orderdate)"""),
    "series_link": (("orders",), """
SELECT t.series_id AS sample_id, o_orderkey AS alignment_id FROM orders JOIN (
  SELECT DISTINCT o_custkey AS owner, year(o_orderdate) AS upto, o_custkey * 10000 + year(o_orderdate) AS series_id FROM orders) t ON owner = o_custkey AND year(o_orderdate) <= upto"""),
    "qc_rule_set": (("region",), "SELECT CAST(r_regionkey AS bigint) AS rule_set_id, r_regionkey = 1 AS is_active FROM region"),
    "qc_rule": (("nation",), """
SELECT CAST(n_regionkey AS bigint) AS rule_set_id, CAST(n_nationkey AS bigint) AS rule_id, n_nationkey AS rule_index,
  CASE n_nationkey % 3 WHEN 0 THEN 'alignment_score' WHEN 1 THEN 'coverage_depth' ELSE 'edge_position' END AS rule_type,
  n_nationkey + 14 AS min_alignment_score, 1 + n_nationkey % 2 AS min_coverage_depth, 10 * n_nationkey AS edge_margin FROM nation"""),
    "exposure": (("events",), "SELECT user_id AS sample_id, event_type AS signature, value AS exposure, ts AS taken FROM events"),
    "sequence": (("documents",), "SELECT doc_id AS sequence_id, regexp_replace(upper(text), '[^ACGT]', ''{g}) AS bases FROM documents"),
}


#: A stretch of 128 bases for each order: the digits of checksums of its key.
PIECE = "translate(concat(md5(concat(o_orderkey, 'a')), md5(concat(o_orderkey, 'b')), md5(concat(o_orderkey, 'c')), md5(concat(o_orderkey, 'd'))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:  # named arguments stand for the tables
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} {t} ")
    text = re.sub(r"string_agg\((\w+), '' ORDER BY (\w+)\)", r"listagg(\1, '') WITHIN GROUP (ORDER BY \2)", text.replace("{piece}", PIECE))
    return spark.sql(text.replace("{g}", "").replace("{" + name + "}", name), **frames)


def duckdb_views(*names: str) -> str:
    """WITH clauses that define the views in DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].replace('{g}', ", 'g'").replace('{piece}', PIECE)})" for n in names)
