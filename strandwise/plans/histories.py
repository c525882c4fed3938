"""Queries on chains of samples in time, distances within cohorts, extracted exposures, dated trees, batches of queries, and stored rules of quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, cohort, control, factors, rules, signatures, spectrum, trees
from ..sources.projection import view
from .genomics import (  # noqa: F401  its queries join those of genomics
    BASE, EDGES, EVIDENCE, FIVE, QUERIES, SPEC, SQL, WITH_ALIGNMENT, cohort_trees, context_spectrum, coverage_and_score, query, spec,
)

CHAIN = EDGES.replace("FROM link", "FROM series_link").replace("JOIN sample ", "JOIN series ")
REDUCED = CHAIN + ", reduced AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x JOIN edges y ON x.target = y.source WHERE x.source = e.source AND y.target = e.target))"
SERIES = ("series_link", "variant", "series")


def chain(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The coded variants of each customer's orders up to a year, their keys, and the reduced edges between them."""
    held, known = cohort.coded_sets(view(spark, d, "series_link"), view(spark, d, "variant"))
    return held, known, cohort.reduced(cohort.stored(cohort.set_edges(held, view(spark, d, "series"))))


@query(REDUCED + "SELECT * FROM reduced", SERIES)
def chain_edges(spark, d):
    return chain(spark, d)[2]


@query(REDUCED + f"SELECT source, target, {FIVE} FROM reduced JOIN k ON k.sample_id = target WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.sample_id = source AND "
       + " AND ".join(f"o.{c} = k.{c}" for c in spectrum.KEY) + ")", SERIES)
def chain_new_variants(spark, d):
    return cohort.set_edge_variants(*chain(spark, d))


@query(CHAIN + "SELECT sample_id, collection_date, coalesce(n, 0) AS variant_count, collection_date IS NULL AS date_unknown FROM series LEFT JOIN size USING (sample_id)", SERIES)
def chain_nodes(spark, d):
    return cohort.chain_nodes(view(spark, d, "series"), spec(spark, d, "series_link"))


@query(SPEC + """, snp AS (SELECT (sample_id - 1) // 200 AS cohort_id, sample_id, reference_id, ref_pos, min(alt_base) AS x, min(ref_base) AS r FROM spectrum WHERE variant_type = 'SNP' GROUP BY 1, 2, 3, 4),
ref AS (SELECT cohort_id, reference_id, ref_pos, min(r) AS ref FROM snp GROUP BY ALL), m AS (SELECT DISTINCT cohort_id, sample_id FROM snp), n AS (SELECT cohort_id, count(*) AS n FROM ref GROUP BY 1),
d AS (SELECT s.cohort_id, s.sample_id AS p, m.sample_id AS q, s.x, coalesce(o.x, ref) AS y, o.x IS NOT NULL AS met FROM snp s JOIN ref USING (cohort_id, reference_id, ref_pos)
  JOIN m ON m.cohort_id = s.cohort_id AND m.sample_id <> s.sample_id LEFT JOIN snp o ON o.sample_id = m.sample_id AND o.reference_id = s.reference_id AND o.ref_pos = s.ref_pos),
c AS (SELECT cohort_id, least(p, q) AS a, greatest(p, q) AS b, count(*) FILTER (x || y IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) AS other FROM d WHERE x <> y AND (NOT met OR p < q) GROUP BY ALL),
z AS (SELECT x.cohort_id, x.sample_id AS a, y.sample_id AS b, coalesce(ti, 0) AS ti, coalesce(other - ti, 0) AS tv, n FROM m x JOIN m y ON x.cohort_id = y.cohort_id AND x.sample_id < y.sample_id
  JOIN n ON n.cohort_id = x.cohort_id LEFT JOIN c ON c.a = x.sample_id AND c.b = y.sample_id)
SELECT cohort_id, a, b, ti, tv, round(-0.5 * ln((1 - 2 * ti / n - tv / n) * sqrt(1 - 2 * tv / n)), 6) + 0.0::DOUBLE AS distance FROM z""", BASE)
def k2p_cohorts(spark, d):
    """Distances within every cohort of 200 customers."""
    return cohort.k2p_cohorts(spec(spark, d).withColumn("cohort_id", F.expr("(sample_id - 1) div 200")))


@query()
def sample_exposures(spark, d):
    return factors.exposures(factors.extraction(context_spectrum(spark, d), 3))


@query()
def extracted_trends(spark, d):
    """The trend of each extracted signature's exposure over its samples' dates."""
    dates = view(spark, d, "cohort").where("collection_date is not null").select("sample_id", F.expr("cast(datediff(collection_date, '1970-01-01') as double)").alias("day"))
    return signatures.exposure_trends(sample_exposures(spark, d).join(dates, "sample_id"), ["signature"], "day", "exposure")


@query("""SELECT signature, round(f, 6) AS first, round(l, 6) AS last, CASE WHEN abs(f) >= 1e-15 THEN round((l - f) / f * 100, 4) END AS percent FROM
(SELECT signature, median(exposure) FILTER (taken <= TIMESTAMP '2024-01-10') AS f, median(exposure) FILTER (taken >= TIMESTAMP '2024-01-20') AS l FROM exposure GROUP BY signature)""", ("exposure",))
def exposure_change_median(spark, d):
    return signatures.exposure_change(view(spark, d, "exposure"), "2024-01-10", "2024-01-20", "median")


@query()
def inconsistent_branches(spark, d):
    return trees.inconsistent_branches(*cohort_trees(spark, d, "nj", "upgma"))


@query()
def dated_tree(spark, d):
    """The nodes of both trees of the cohort, with a year where the tree's clock is good."""
    nj, upgma = cohort_trees(spark, d, "nj", "upgma")
    both = nj.unionByName(upgma)
    dates = view(spark, d, "cohort").select(F.col("sample_id").cast("string").alias("name"), "collection_date")
    return trees.divergence_times(both, trees.molecular_clock(both, dates), dates).drop("leaves")


@query()
def batch_alignments(spark, d):
    """All probes in batches of growing size, up to what a batch may hold, with the best alignment of each."""
    batch = F.expr("if(query_id < 625, floor(sqrt(query_id)), 25 + (query_id - 625) div 50)")  # 49 probes from 576 to 624, then 50 each: none is rejected for its batch
    items = view(spark, d, "probe").select(batch.alias("batch_id"), F.col("query_id").alias("order_index"), "query")
    return alignment.batch_results(items, view(spark, d, "reference"))


LOW = """CASE rule_type WHEN 'alignment_score' THEN best_score IS NULL OR best_score < threshold WHEN 'coverage_depth' THEN depth < threshold ELSE edge <= threshold END"""
JUDGED = EVIDENCE + f""", reach AS (SELECT reference_id, max(ref_pos) + 1 AS length FROM variant GROUP BY reference_id),
bound AS (SELECT rule_set_id, rule_id, rule_type, CASE rule_type WHEN 'alignment_score' THEN min_alignment_score WHEN 'coverage_depth' THEN min_coverage_depth ELSE edge_margin END::DOUBLE AS threshold FROM qc_rule),
met AS (SELECT e.*, rule_set_id, rule_id, rule_type, threshold, {LOW} AS failed, CASE rule_type WHEN 'alignment_score' THEN best_score WHEN 'coverage_depth' THEN depth ELSE edge END::DOUBLE AS actual_value
FROM (SELECT evidence.*, least(ref_pos, length - ref_pos + 1) AS edge FROM evidence JOIN reach USING (reference_id)) e CROSS JOIN bound WHERE rule_set_id IN (0, 1)),
judged AS (SELECT rule_set_id, sample_id, {FIVE}, CASE WHEN bool_or(failed) THEN 'FAIL' ELSE 'PASS' END AS qc_status FROM met GROUP BY ALL),
mixed AS (SELECT *, rule_set_id <> 1 AS is_stale FROM judged WHERE sample_id % 3 = rule_set_id)"""
RULED = (*WITH_ALIGNMENT, "qc_rule")


def results(spark, d, active: int = 1) -> DataFrame:
    """Results of the set that is active, or of an earlier one."""
    sets = view(spark, d, "qc_rule_set").withColumn("is_active", F.col("rule_set_id") == active)
    lengths = view(spark, d, "variant").groupBy("reference_id").agg((F.max("ref_pos") + 1).alias("length"))
    return control.judged(coverage_and_score(spark, d), control.active_rules(sets, view(spark, d, "qc_rule")), lengths)


def mixed(spark, d) -> DataFrame:
    """A third of the samples has results of the active set, one of a set that was active before, one has none."""
    both = [results(spark, d, k).where(F.col("sample_id") % 3 == k) for k in (1, 0)]
    return control.marked(both[0].unionByName(both[1]), view(spark, d, "qc_rule_set"))


@query(JUDGED + f"SELECT sample_id, {FIVE}, rule_id, rule_type, actual_value, threshold FROM met WHERE failed AND rule_set_id = 1", RULED)
def qc_failures(spark, d):
    return control.failures(results(spark, d))


@query(JUDGED + f""", {SPEC.replace('WITH ', '', 1)}, t AS (SELECT sample_id, count(*) AS n FROM spectrum GROUP BY 1),
c AS (SELECT sample_id, count(*) FILTER (NOT is_stale AND qc_status = 'PASS') AS ok, count(*) FILTER (NOT is_stale AND qc_status = 'FAIL') AS bad, count(*) FILTER (is_stale) AS stale FROM mixed GROUP BY 1)
SELECT DISTINCT sample_id, ok IS NOT NULL AS has_qc_results, coalesce(stale, 0) > 0 AS is_stale, coalesce(n, 0) AS total_variants, coalesce(ok, 0) AS pass_count, coalesce(bad, 0) AS fail_count,
coalesce(stale, 0) AS stale_count FROM sample LEFT JOIN t USING (sample_id) LEFT JOIN c USING (sample_id)""", (*RULED, "sample"))
def qc_sample_summary(spark, d):
    return control.sample_summary(view(spark, d, "sample"), spec(spark, d), mixed(spark, d))


@query(JUDGED + f""", {SPEC.replace('WITH ', '', 1)} SELECT sample_id, {FIVE} FROM spectrum s WHERE sample_id NOT IN (SELECT sample_id FROM mixed WHERE NOT is_stale) OR EXISTS
(SELECT 1 FROM mixed q WHERE NOT is_stale AND qc_status = 'PASS' AND q.sample_id = s.sample_id AND {' AND '.join(f'q.{k} = s.{k}' for k in spectrum.KEY)})""", RULED)
def qc_visible(spark, d):
    return control.visible(spec(spark, d).select("sample_id", *spectrum.KEY), mixed(spark, d))


ASKED = f""", {SPEC.replace('WITH ', '', 1)}, asked AS (SELECT sample_id, true AS known FROM sample UNION ALL SELECT -CAST(s_suppkey AS bigint), false FROM supplier),
t AS (SELECT sample_id, count(*) AS n FROM spectrum GROUP BY 1), c AS (SELECT sample_id, count(*) FILTER (qc_status = 'PASS') AS ok, count(*) FILTER (qc_status = 'FAIL') AS bad FROM judged WHERE rule_set_id = 1 GROUP BY 1),
runs AS (SELECT a.sample_id, coalesce(n, 0) AS total_variants, coalesce(ok, 0) AS pass_count, coalesce(bad, 0) AS fail_count, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(ok, 0) / n, 4) END AS pass_rate,
CASE WHEN NOT known THEN 'sample not found' END AS error FROM asked a LEFT JOIN t ON t.sample_id = a.sample_id LEFT JOIN c ON c.sample_id = a.sample_id)"""


@query(JUDGED + ASKED + "SELECT * FROM runs", (*RULED, "sample"))
def qc_batch_runs(spark, d):
    """All samples are asked for, and as many unknown ones as there are suppliers."""
    unknown = spark.read.parquet(f"{d}/supplier.parquet").select((-F.col("s_suppkey").cast("bigint")).alias("sample_id"), F.lit(False).alias("known"))
    asked = view(spark, d, "sample").select("sample_id", F.lit(True).alias("known")).unionByName(unknown)
    return control.batch_run(asked, spec(spark, d), results(spark, d))


@query(JUDGED + ASKED + """SELECT count(*) AS total_samples, count(*) FILTER (error IS NULL) AS processed_samples, count(*) FILTER (error IS NOT NULL) AS failed_samples,
coalesce(round(avg(CASE WHEN total_variants = 0 THEN 0 ELSE pass_count / total_variants END) FILTER (error IS NULL), 4), 0) AS average_pass_rate FROM runs""", (*RULED, "sample"))
def qc_batch_totals(spark, d):
    return control.batch_totals(qc_batch_runs(spark, d))
