"""Queries on protein domains, clusters of samples, and the signature catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue, clusters, domains, spectrum
from ..sources.projection import view
from .genomics import COHORT, FIVE, QUERIES, SQL, context_spectrum, extracted_signatures, query, spec  # noqa: F401  its queries join those of genomics

EXON = ("variant", "annotation", "strand_annotation", "protein_domain", "link")
CONSEQUENCE = """CASE variant_type WHEN 'INS' THEN 'frameshift_variant' WHEN 'DEL' THEN 'stop_gained' ELSE CASE WHEN alt_base IN ('A', 'C') THEN 'missense_variant' ELSE 'synonymous_variant' END END"""


def exon_variants(spark, d) -> DataFrame:
    """Each sample's variants in exons, with a consequence by their kind and bases in the place of amino acids."""
    at = spectrum.annotate_first(view(spark, d, "variant"), view(spark, d, "annotation")).where("feature_type = 'exon'")
    at = at.withColumns({"consequence": F.expr(CONSEQUENCE), "aa_ref": F.col("ref_base"), "aa_alt": F.col("alt_base")})
    return at.join(view(spark, d, "link"), "alignment_id").select("sample_id", "variant_id", *spectrum.KEY, "gene_name", "consequence", "aa_ref", "aa_alt")


def impact(spark, d) -> DataFrame:
    return domains.domain_impact(exon_variants(spark, d), domains.coding_exons(view(spark, d, "strand_annotation")), view(spark, d, "protein_domain"))


IMPACT = f"""WITH hit AS (SELECT v.reference_id, ref_pos, min(annotation_id) AS annotation_id FROM (SELECT DISTINCT reference_id, ref_pos FROM variant) v
JOIN annotation a ON a.reference_id = v.reference_id AND ref_pos BETWEEN start_pos AND end_pos GROUP BY v.reference_id, ref_pos),
exon_variant AS (SELECT sample_id, variant_id, {FIVE}, a.gene_name, {CONSEQUENCE} AS consequence FROM variant v JOIN hit USING (reference_id, ref_pos)
  JOIN annotation a USING (annotation_id, reference_id) JOIN link USING (alignment_id) WHERE feature_type = 'exon'),
exon AS (SELECT *, coalesce(sum((end_pos - start_pos + 1) // 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER w AS place
  FROM (SELECT *, first(strand ORDER BY annotation_id) OVER (PARTITION BY gene_name) AS s FROM strand_annotation) WHERE feature_type = 'exon'
  WINDOW w AS (PARTITION BY gene_name ORDER BY CASE WHEN s = '-' THEN -end_pos ELSE start_pos END, annotation_id)),
codon AS (SELECT v.gene_name, ref_pos, (before + (CASE WHEN s = '-' THEN end_pos - ref_pos ELSE ref_pos - start_pos END) // 3 + 1)::BIGINT AS codon_position
  FROM (SELECT DISTINCT gene_name, ref_pos FROM exon_variant) v JOIN exon e ON e.gene_name = v.gene_name AND ref_pos BETWEEN start_pos AND end_pos
  QUALIFY row_number() OVER (PARTITION BY v.gene_name, ref_pos ORDER BY place) = 1),
placed AS (SELECT * FROM exon_variant JOIN codon USING (gene_name, ref_pos)),
met AS (SELECT gene_name, codon_position, string_agg(domain_name || '(' || domain_type || ')', ', ' ORDER BY domain_id) AS names, count(*) AS n,
  max(CASE domain_type WHEN 'catalytic' THEN 3 WHEN 'binding' THEN 2 WHEN 'regulatory' THEN 2 WHEN 'structural' THEN 1 ELSE 0 END) AS rank
  FROM (SELECT DISTINCT gene_name, codon_position FROM placed) JOIN protein_domain USING (gene_name) WHERE codon_position BETWEEN start_codon AND end_codon GROUP BY 1, 2),
impact AS (SELECT p.*, coalesce(n, 0) AS n_hits, names, consequence <> 'synonymous_variant' AND consequence <> 'frameshift_variant' AS changes,
  CASE WHEN n IS NOT NULL AND changes THEN rank ELSE 0 END AS level FROM placed p LEFT JOIN met USING (gene_name, codon_position))"""


@query(IMPACT + f"""SELECT sample_id, variant_id, gene_name, codon_position, n_hits, CASE WHEN changes THEN ref_base || codon_position || alt_base END AS amino_acid_change,
{[*domains.LEVELS]}[level + 1] AS risk_level, CASE WHEN n_hits = 0 THEN CASE WHEN gene_name IN (SELECT gene_name FROM protein_domain) THEN '{domains.OUTSIDE}' ELSE '{domains.NO_DOMAINS}' END
WHEN NOT changes THEN '{domains.UNCHANGED}' ELSE consequence || '{domains.HIT}' || names END AS risk_reason FROM impact""", EXON)
def domain_impact(spark, d):
    return impact(spark, d).select("sample_id", "variant_id", "gene_name", "codon_position", F.size("hit_domains").cast("bigint").alias("n_hits"), "amino_acid_change", "risk_level", "risk_reason")


COUNTS = "count(*) FILTER (level = 0) AS unknown_risk_count, count(*) FILTER (level = 1) AS low_risk_count, count(*) FILTER (level = 2) AS medium_risk_count, count(*) FILTER (level = 3) AS high_risk_count"


@query(IMPACT + f"""SELECT sample_id, (SELECT count(*) FROM exon_variant e WHERE e.sample_id = i.sample_id) AS total_exon_variants, count(*) AS mapped_variants,
count(*) FILTER (n_hits > 0) AS variants_with_domain_hit, {COUNTS} FROM impact i GROUP BY sample_id
UNION ALL SELECT sample_id, count(*), 0, 0, 0, 0, 0, 0 FROM exon_variant WHERE sample_id NOT IN (SELECT sample_id FROM placed) GROUP BY sample_id""", EXON)
def sample_domain_risks(spark, d):
    return domains.sample_risks(exon_variants(spark, d), impact(spark, d))


@query(IMPACT + f""", each AS (SELECT i.*, domain_id, domain_name, domain_type FROM impact i JOIN protein_domain p ON p.gene_name = i.gene_name AND codon_position BETWEEN start_codon AND end_codon)
SELECT gene_name, domain_id, domain_name, domain_type, count(*) AS total_variants, {COUNTS}, max(carriers) AS unique_samples
FROM (SELECT DISTINCT gene_name, domain_id, domain_name, domain_type, {FIVE}, consequence, level FROM each)
JOIN (SELECT domain_id, count(DISTINCT sample_id) AS carriers FROM each GROUP BY 1) USING (domain_id) GROUP BY 1, 2, 3, 4""", EXON)
def domain_summary(spark, d):
    return domains.domain_summary(impact(spark, d), spectrum.KEY)


def found_clusters(spark, d):
    return clusters.shared_variant_clusters(spec(spark, d, "cohort_link"), 0.06)


@query()
def shared_variant_clusters(spark, d):
    return found_clusters(spark, d)[0].withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query()
def cluster_shared_variants(spark, d):
    return found_clusters(spark, d)[1]


@query()
def catalogue_matches(spark, d):
    """Of each sample's contexts, and of the signatures that are extracted from them."""
    contexts = context_spectrum(spark, d).select(F.concat(F.lit("sample "), F.col("sample_id").cast("string")).alias("id"), "mutation_type", F.col("n").cast("double").alias("p"))
    extracted = extracted_signatures(spark, d).select(F.concat(F.lit("signature "), F.col("signature").cast("string")).alias("id"), "mutation_type", "p")
    return catalogue.matches(contexts.unionByName(extracted), catalogue.reference_signatures(spark))
