"""Queries from called variants over effects to rules and scores of samples, filters of annotated spectra, and the report of quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, rules, spectrum
from ..sources.projection import view
from .genomics import BASE, EFFECT, FIVE, FREQ, QC, QUERIES, SPEC, SQL, WITH_ALIGNMENT, called_variants, judged_spectrum, qc_results, query, spec  # noqa: F401  its queries join those of genomics

CTES = EFFECT[: EFFECT.rindex("\nSELECT variant_id")]
IMPACT = EFFECT[EFFECT.rindex("CASE WHEN consequence IN") : EFFECT.rindex(" AS impact")]
TUPLE = f"""change AS (SELECT DISTINCT {', '.join(f'g.{k}' for k in spectrum.KEY)}, g.feature_type, a.gene_name, consequence, {IMPACT} AS impact
FROM g LEFT JOIN hit h ON h.reference_id = g.reference_id AND h.ref_pos = g.ref_pos LEFT JOIN annotation a ON a.annotation_id = h.annotation_id)"""
ANNOTATED = f"{CTES}, {SPEC.replace('WITH ', '', 1)}, {TUPLE}"
#: The default rules: by consequence, by feature, by frequency.
WEIGHTS = {f: [(r, v, w) for r, field, _, v, w in rules.DEFAULT_RULES if field == f] for f in ("consequence", "feature_type", "population_frequency")}
MET = [(f"{f} = '{v}'", r, w) for f in ("consequence", "feature_type") for r, v, w in WEIGHTS[f]]
MET += [(f"population_frequency > {v}", r, w) for r, v, w in WEIGHTS["population_frequency"]]
SCORE = " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, _, w in MET)
NAMES = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r, _ in sorted(MET, key=lambda m: m[1]))
CLASS = "CASE WHEN {s} >= 6 THEN 'pathogenic' WHEN {s} >= 3 THEN 'likely_pathogenic' WHEN {s} >= -2 THEN 'uncertain_significance' WHEN {s} > -6 THEN 'likely_benign' ELSE 'benign' END"
DETAIL = f"""{CTES}, {FREQ.replace('WITH ', '', 1)}, {TUPLE}, {QC.replace('WITH ', '', 1)},
scored AS (SELECT *, concat_ws(',', {NAMES}) AS matched_rules, {SCORE} AS variant_score FROM (SELECT c.*, f.frequency AS population_frequency FROM change c JOIN frequency f USING ({FIVE}))),
detail AS (SELECT s.sample_id, c.*, {CLASS.format(s='variant_score')} AS variant_classification FROM spectrum s JOIN scored c USING ({FIVE})
WHERE s.sample_id NOT IN (SELECT sample_id FROM qc) OR EXISTS (SELECT 1 FROM qc q WHERE q.qc_status = 'PASS' AND q.sample_id = s.sample_id AND {' AND '.join(f'q.{k} = s.{k}' for k in spectrum.KEY)}))"""
ALL = ("link", "variant", "sample", "alignment", "annotation", "reference")
NOTED = ("sample_id", *spectrum.KEY, "feature_type", "gene_name", "consequence", "impact")


def sites(spark, d) -> DataFrame:
    """Each site of a variant with the first feature over it and its codon: they are the same for all alleles there, and for all who carry one."""
    noted = alignment.with_codon(spectrum.first_features(view(spark, d, "variant"), view(spark, d, "annotation")), view(spark, d, "reference"))
    return noted.select("ref_pos", "reference_id", "start_pos", "feature_type", "gene_name", "codon_ref")


def changes(spark, d, carriers: DataFrame) -> DataFrame:
    """carriers (sample_id, KEY and more) with feature, gene, consequence and impact.

    The two are generated, as a filter on what follows from them would repeat their long expressions for each place that names them.
    """
    noted = alignment.consequences(carriers.join(sites(spark, d), ["ref_pos", "reference_id"]))
    effect = F.inline(F.array(F.struct("consequence", "impact")))
    return noted.select(*carriers.columns, "feature_type", "gene_name", effect)


def annotated(spark, d) -> DataFrame:
    return changes(spark, d, spec(spark, d).na.drop(subset=spectrum.KEY)).select(*NOTED)


@query(ANNOTATED + f"SELECT s.sample_id, c.* FROM spectrum s JOIN change c USING ({FIVE}) WHERE variant_type = 'SNP' AND impact = 'MODERATE'", ("link", "variant", "annotation", "reference"))
def spectrum_filtered(spark, d):
    return spectrum.filtered(annotated(spark, d), impact="MODERATE", variant_type="SNP")


@query(SPEC + """, v AS (SELECT DISTINCT sample_id, reference_id, ref_pos, concat_ws(':', variant_type, ref_base, alt_base) AS change FROM spectrum)
SELECT sample_id, reference_id, ref_pos, string_agg(change, ',' ORDER BY change) AS changes, count(*) AS n FROM v GROUP BY ALL""", BASE)
def spectrum_by_site(spark, d):
    return spectrum.by_site(spec(spark, d))


def details(spark, d) -> DataFrame:
    """The sample's variants that passed, scored by the default rules. Frequencies are of all carriers, passed or not."""
    table = spark.createDataFrame(rules.DEFAULT_RULES, rules.RULE)
    dealt = spectrum.tasks(view(spark, d, "link"), view(spark, d, "variant"))
    carriers = rules.marked(judged_spectrum(spark, d, dealt, counted=False)).select("sample_id", *spectrum.KEY, "passed")
    passed = spectrum.with_frequency(carriers, view(spark, d, "sample"), dealt[1]).where("passed").drop("passed")
    return rules.detailed(changes(spark, d, passed).select(*NOTED, "population_frequency"), table)


@query(DETAIL + "SELECT * FROM detail", ALL)
def score_details(spark, d):
    return details(spark, d).withColumn("matched_rules", F.array_join("matched_rules", ","))


@query(DETAIL + "SELECT * FROM detail WHERE variant_classification = 'likely_pathogenic' AND gene_name = 'Brand#13'", ALL)
def score_detail_filter(spark, d):
    return rules.detail_filter(details(spark, d), "likely_pathogenic", "Brand#13").withColumn("matched_rules", F.array_join("matched_rules", ","))


@query(DETAIL + f""", t AS (SELECT sample_id, sum(variant_score) AS total_score, count(*) AS total_variants FROM detail GROUP BY sample_id),
u AS (SELECT DISTINCT p.sample_id, coalesce(total_score, 0) AS total_score, coalesce(total_variants, 0) AS total_variants FROM sample p LEFT JOIN t USING (sample_id))
SELECT sample_id, total_score, {CLASS.format(s='total_score')} AS classification, total_variants FROM u""", ALL)
def sample_scores(spark, d):
    return rules.sample_scores(details(spark, d), view(spark, d, "sample"))


@query(QC + """SELECT reference_id, count(DISTINCT sample_id) AS total_samples, count(*) AS total_variants, count(*) FILTER (qc_status = 'PASS') AS total_pass,
count(*) FILTER (qc_status = 'FAIL') AS total_fail, round(count(*) FILTER (qc_status = 'PASS') / count(*), 4) AS overall_pass_rate FROM qc GROUP BY reference_id""", WITH_ALIGNMENT)
def qc_report_totals(spark, d):
    return rules.report_totals(qc_results(spark, d))


@query(QC + """, l AS (SELECT reference_id, max(ref_pos) + 1 AS length FROM variant GROUP BY reference_id),
b AS (SELECT reference_id, length, CASE WHEN ref_pos = 0 THEN (length + 499) // 500 - 1 ELSE least((ref_pos - 1) // 500, (length + 499) // 500 - 1) END AS bucket, count(*) AS fail_count
FROM qc JOIN l USING (reference_id) WHERE qc_status = 'FAIL' GROUP BY ALL)
SELECT reference_id, row_number() OVER (PARTITION BY reference_id ORDER BY fail_count DESC, bucket) AS rank, bucket * 500 + 1 AS bucket_start,
least((bucket + 1) * 500, length) AS bucket_end, fail_count, round(fail_count / 500, 6) AS fail_density FROM b QUALIFY rank <= 10""", WITH_ALIGNMENT)
def qc_hot_buckets(spark, d):
    lengths = view(spark, d, "variant").groupBy("reference_id").agg((F.max("ref_pos") + 1).alias("length"))
    return rules.hot_buckets(qc_results(spark, d), lengths)


@query(QC + """, r AS (SELECT reference_id, unnest(string_split(failed_rules, ',')) AS rule_type FROM qc WHERE failed_rules <> ''),
n AS (SELECT reference_id, rule_type, count(*) AS fail_count FROM r GROUP BY ALL)
SELECT *, round(fail_count / sum(fail_count) OVER (PARTITION BY reference_id) * 100, 2) AS fail_percentage FROM n""", WITH_ALIGNMENT)
def qc_rule_shares(spark, d):
    return rules.rule_shares(qc_results(spark, d))


@query()
def called_effects(spark, d):
    """What the called variants of each query do: the first feature over each, its consequence and impact."""
    noted = spectrum.annotate_first(called_variants(spark, d), view(spark, d, "annotation"))
    return alignment.effects(noted, view(spark, d, "reference")).drop("start_pos", "annotation_id")
