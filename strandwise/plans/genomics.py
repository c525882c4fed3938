"""The genomic queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..operators import alignment, cohort, factors, linkage, primers, rules, signatures, spectrum, trees
from ..sources.projection import duckdb_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FIVE = ", ".join(spectrum.KEY)
RULES = [("variant_type", "eq", "DEL", 4), ("variant_type", "eq", "INS", 3), ("ref_pos", "lt", "500", 2), ("alt_base", "ne", "A", -1), ("carriers", "gte", "3", -3), ("ref_base", "gt", "B", 100)]


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (duckdb_views(*views) + ("," if sql.lstrip().startswith("WITH") else "") + sql.replace("WITH", "", 1) if sql.lstrip().startswith("WITH") else duckdb_views(*views) + sql) if views else sql
        return f

    return add


def spec(spark: SparkSession, d: str, links: str = "link") -> DataFrame:
    return spectrum.variant_spectrum(view(spark, d, links), view(spark, d, "variant"))


SPEC = f"""WITH spectrum AS (SELECT sample_id, {FIVE}, count(DISTINCT alignment_id) AS n_alignments, min(variant_id) AS first_variant
FROM link JOIN variant USING (alignment_id) GROUP BY sample_id, {FIVE})"""
COHORT = SPEC.replace("FROM link", "FROM cohort_link")
FREQ = SPEC + f""", frequency AS (SELECT {FIVE}, count(DISTINCT sample_id) AS carriers, (SELECT count(DISTINCT sample_id) FROM sample) AS n_samples,
count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM sample) AS frequency FROM spectrum GROUP BY {FIVE})"""
BASE = ("link", "variant")


@query(SPEC + "SELECT * FROM spectrum", BASE)
def variant_spectrum(spark, d):
    return spec(spark, d)


@query(FREQ + "SELECT * FROM frequency", (*BASE, "sample"))
def population_frequency(spark, d):
    return spectrum.population_frequency(spec(spark, d), view(spark, d, "sample"))


@query(FREQ + "SELECT * FROM frequency WHERE frequency BETWEEN 0.002 AND 0.01", (*BASE, "sample"))
def frequency_range(spark, d):
    return spectrum.frequency_range(population_frequency(spark, d), 0.002, 0.01)


@query("""WITH t AS (SELECT max(ref_pos) + 1 AS length FROM variant), r AS (SELECT length, unnest(range((length - 1) // 100 + 1)) AS k FROM t)
SELECT k AS bucket, k * 100 AS start_pos, least(k * 100 + 99, length - 1) AS end_pos, count(ref_pos) AS n
FROM r LEFT JOIN variant ON ref_pos // 100 = k GROUP BY k, length""", ("variant",))
def variant_density_buckets(spark, d):
    return spectrum.density_buckets(view(spark, d, "variant"), 100)


@query("SELECT coalesce(variant_type, 'UNKNOWN') AS variant_type, count(*) AS n FROM variant GROUP BY 1", ("variant",))
def type_counts(spark, d):
    return spectrum.counts_by(view(spark, d, "variant"), "variant_type")


MAF = SPEC + """, maf AS (SELECT reference_id, ref_pos, least(f, 1 - f) AS maf FROM (SELECT reference_id, ref_pos, count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM sample) AS f
FROM spectrum WHERE variant_type = 'SNP' GROUP BY reference_id, ref_pos))"""


@query(MAF + "SELECT * FROM maf WHERE ref_pos BETWEEN 100 AND 900 AND maf >= 0.004", (*BASE, "sample"))
def maf_filter(spark, d):
    return spectrum.maf_filter(spectrum.minor_allele_frequency(spec(spark, d), view(spark, d, "sample")), 100, 900, 0.004)


@query(COHORT + f""", a AS (SELECT DISTINCT {FIVE}, true AS in_a FROM spectrum WHERE sample_id = 1), b AS (SELECT DISTINCT {FIVE}, true AS in_b FROM spectrum WHERE sample_id = 2)
SELECT {FIVE}, CASE WHEN in_a AND in_b THEN 'shared' WHEN in_a THEN 'only_a' ELSE 'only_b' END AS found FROM a FULL JOIN b USING ({FIVE})""", ("cohort_link", "variant"))
def compare_samples(spark, d):
    return spectrum.compare(spec(spark, d, "cohort_link"), 1, 2)


@query(COHORT + f""", a AS (SELECT DISTINCT {FIVE} FROM spectrum WHERE sample_id = 1), b AS (SELECT DISTINCT {FIVE} FROM spectrum WHERE sample_id = 2),
n AS (SELECT (SELECT count(*) FROM a JOIN b USING ({FIVE})) AS shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS total)
SELECT shared, total, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE round(shared / total, 6) END AS jaccard FROM n""", ("cohort_link", "variant"))
def compare_jaccard(spark, d):
    return spectrum.compared_jaccard(compare_samples(spark, d))


@query(COHORT + """SELECT reference_id, ref_pos, count(DISTINCT alt_base) AS alleles FROM spectrum WHERE sample_id IN (1, 2) GROUP BY reference_id, ref_pos
HAVING count(DISTINCT sample_id) = 2 AND count(DISTINCT alt_base) = count(DISTINCT (alt_base, sample_id))""", ("cohort_link", "variant"))
def same_site_other_allele(spark, d):
    return spectrum.same_site_other_allele(spec(spark, d, "cohort_link"), 1, 2)


FIRST = """WITH hit AS (SELECT v.reference_id, ref_pos, min(annotation_id) AS annotation_id FROM (SELECT DISTINCT reference_id, ref_pos FROM variant) v
JOIN annotation a ON a.reference_id = v.reference_id AND ref_pos BETWEEN start_pos AND end_pos GROUP BY v.reference_id, ref_pos)
SELECT v.variant_id, v.ref_pos, v.variant_type, h.annotation_id, coalesce(a.feature_type, 'intergenic') AS feature_type, a.gene_name
FROM variant v LEFT JOIN hit h USING (reference_id, ref_pos) LEFT JOIN annotation a ON a.annotation_id = h.annotation_id"""


@query(FIRST, ("variant", "annotation"))
def annotate_first_match(spark, d):
    out = spectrum.annotate_first(view(spark, d, "variant"), view(spark, d, "annotation"))
    return out.select("variant_id", "ref_pos", "variant_type", "annotation_id", "feature_type", "gene_name")


@query(FREQ + """, p AS (SELECT annotation_id, count(DISTINCT ref_pos) AS positions, max(frequency) AS top_frequency, count(DISTINCT ref_pos) * 100 / (max(end_pos) - max(start_pos) + 1) AS density
FROM frequency f JOIN annotation a ON a.reference_id = f.reference_id AND ref_pos BETWEEN start_pos AND end_pos GROUP BY annotation_id),
c AS (SELECT annotation_id, count(DISTINCT sample_id) AS carriers FROM spectrum s JOIN annotation a ON a.reference_id = s.reference_id AND ref_pos BETWEEN start_pos AND end_pos GROUP BY annotation_id)
SELECT annotation_id, positions, carriers, top_frequency, round(density, 4) AS density FROM p JOIN c USING (annotation_id) WHERE density >= 2.5""", (*BASE, "sample", "annotation"))
def hotspots(spark, d):
    s = spec(spark, d)
    return spectrum.hotspots(spectrum.population_frequency(s, view(spark, d, "sample")), s, view(spark, d, "annotation"), 2.5)


@query(SPEC + f"""SELECT {FIVE}, sample_id, collection_date, coalesce(collection_date = min(collection_date) OVER (PARTITION BY {FIVE}), false) AS earliest
FROM spectrum JOIN sample USING (sample_id)""", (*BASE, "sample"))
def variant_tracing(spark, d):
    return spectrum.earliest_carriers(spec(spark, d), view(spark, d, "sample"))


@query("SELECT sample_id, name FROM sample ORDER BY collection_date DESC NULLS LAST, sample_id DESC LIMIT 50 OFFSET 20", ("sample",))
def list_page(spark, d):
    return spectrum.page(view(spark, d, "sample"), [F.col("collection_date").desc_nulls_last(), F.col("sample_id").desc()], 20, 50).select("sample_id", "name")


EVIDENCE = f"""WITH evidence AS (SELECT sample_id, {FIVE}, count(DISTINCT alignment_id) AS depth, max(score) AS best_score
FROM link JOIN variant USING (alignment_id) JOIN alignment USING (alignment_id) GROUP BY sample_id, {FIVE})"""
QC = EVIDENCE + """, qc AS (SELECT *, CASE WHEN failed_rules = '' THEN 'PASS' ELSE 'FAIL' END AS qc_status FROM (SELECT *,
concat_ws(',', CASE WHEN best_score IS NULL OR best_score < 30 THEN 'alignment_score' END, CASE WHEN depth < 1 THEN 'coverage_depth' END,
CASE WHEN least(ref_pos, (SELECT max(ref_pos) + 1 FROM variant) - ref_pos + 1) <= 50 THEN 'edge_position' END) AS failed_rules FROM evidence))"""
WITH_ALIGNMENT = (*BASE, "alignment")


def qc_results(spark, d):
    e = rules.evidence(view(spark, d, "link"), view(spark, d, "variant"), view(spark, d, "alignment"))
    return rules.qc(e, 30, 1, 50, spectrum.table_length(view(spark, d, "variant")))


def judged_spectrum(spark, d, dealt=None, counted=True):
    """The spectrum with the results of its quality control beside it, from one pass over the tables. The least depth is 1, so that depths need not be counted."""
    e = rules.with_evidence(view(spark, d, "link"), view(spark, d, "variant"), view(spark, d, "alignment"), dealt, counted)
    return rules.qc(e, 30, 1, 50, spectrum.table_length(view(spark, d, "variant")))


@query(EVIDENCE + "SELECT * FROM evidence", WITH_ALIGNMENT)
def coverage_and_score(spark, d):
    return rules.evidence(view(spark, d, "link"), view(spark, d, "variant"), view(spark, d, "alignment"))


@query(QC + "SELECT * FROM qc", WITH_ALIGNMENT)
def qc_run(spark, d):
    return qc_results(spark, d)


@query(QC + """SELECT sample_id, count(*) FILTER (qc_status = 'PASS') AS passed, count(*) FILTER (qc_status = 'FAIL') AS failed,
round(count(*) FILTER (qc_status = 'PASS') / count(*), 6) AS pass_rate FROM qc GROUP BY sample_id""", WITH_ALIGNMENT)
def qc_batch(spark, d):
    return rules.qc_summary(qc_results(spark, d))


@query(QC + "SELECT unnest(string_split(failed_rules, ',')) AS rule_type, count(*) AS failures FROM qc WHERE failed_rules <> '' GROUP BY 1", WITH_ALIGNMENT)
def qc_rule_failures(spark, d):
    return rules.qc_rule_failures(qc_results(spark, d))


@query(QC + """, t AS (SELECT (max(ref_pos) + 500) // 500 - 1 AS last FROM variant)
SELECT CASE WHEN ref_pos = 0 THEN last ELSE least((ref_pos - 1) // 500, last) END AS bucket, count(*) FILTER (qc_status = 'PASS') AS passed, count(*) FILTER (qc_status = 'FAIL') AS failed,
count(*) FILTER (qc_status = 'FAIL') / 500 AS fail_density FROM qc, t GROUP BY 1""", WITH_ALIGNMENT)
def qc_report_buckets(spark, d):
    return rules.qc_buckets(qc_results(spark, d), spectrum.table_length(view(spark, d, "variant")))


@query(QC + f""", spectrum AS (SELECT sample_id, {FIVE}, count(DISTINCT alignment_id) AS n_alignments FROM link JOIN variant USING (alignment_id) GROUP BY sample_id, {FIVE})
SELECT s.* FROM spectrum s WHERE sample_id NOT IN (SELECT sample_id FROM qc) OR EXISTS (SELECT 1 FROM qc q WHERE q.qc_status = 'PASS' AND q.sample_id = s.sample_id AND
{' AND '.join(f'q.{k} = s.{k}' for k in spectrum.KEY)})""", WITH_ALIGNMENT)
def qc_pass_filter(spark, d):
    return rules.passed_of(judged_spectrum(spark, d)).select("sample_id", *spectrum.KEY, "n_alignments")


SCORED = FREQ + f""", scored AS (SELECT {FIVE}, carriers, CAST((CASE WHEN variant_type = 'DEL' THEN 4 ELSE 0 END) + (CASE WHEN variant_type = 'INS' THEN 3 ELSE 0 END)
+ (CASE WHEN ref_pos < 500 THEN 2 ELSE 0 END) - (CASE WHEN alt_base <> 'A' THEN 1 ELSE 0 END) - (CASE WHEN carriers >= 3 THEN 3 ELSE 0 END) AS bigint) AS score FROM frequency)"""


def scored(spark, d):
    table = spark.createDataFrame(RULES, "field string, op string, value string, weight int")
    return rules.score_variants(population_frequency(spark, d).select(*spectrum.KEY, "carriers"), table, ["variant_type", "ref_pos", "ref_base", "alt_base", "carriers"])


@query(SCORED + "SELECT * FROM scored", (*BASE, "sample"))
def score_variants(spark, d):
    return scored(spark, d)


@query(SCORED + """, c AS (SELECT CASE WHEN score >= 6 THEN 'pathogenic' WHEN score >= 3 THEN 'likely_pathogenic' WHEN score >= -2 THEN 'uncertain_significance' WHEN score > -6 THEN 'likely_benign' ELSE 'benign' END AS c FROM scored)
SELECT n.c AS classification, count(c.c) AS n FROM (VALUES ('pathogenic'), ('likely_pathogenic'), ('uncertain_significance'), ('likely_benign'), ('benign')) n(c) LEFT JOIN c ON c.c = n.c GROUP BY n.c""", (*BASE, "sample"))
def class_distribution(spark, d):
    return rules.class_distribution(scored(spark, d))


OVERLAP = COHORT + f""", k AS (SELECT DISTINCT sample_id, {FIVE} FROM spectrum), size AS (SELECT sample_id, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT x.sample_id AS a, y.sample_id AS b, count(*) AS shared FROM k x JOIN k y USING ({FIVE}) WHERE x.sample_id <> y.sample_id GROUP BY 1, 2),
pairs AS (SELECT s.sample_id AS a, t.sample_id AS b, coalesce(shared, 0) AS shared, s.n AS size_a, t.n AS size_b FROM size s JOIN size t ON s.sample_id <> t.sample_id LEFT JOIN o ON o.a = s.sample_id AND o.b = t.sample_id)"""
WITH_COHORT = ("cohort_link", "variant", "cohort")


@query(OVERLAP + "SELECT a, b, shared / (size_a + size_b - shared) AS jaccard FROM pairs WHERE a < b", WITH_COHORT)
def jaccard_matrix(spark, d):
    return cohort.jaccard_matrix(spec(spark, d, "cohort_link"))


EDGES = f"""WITH k AS (SELECT DISTINCT sample_id, {FIVE} FROM link JOIN variant USING (alignment_id)), size AS (SELECT sample_id, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT x.sample_id AS source, y.sample_id AS target, count(*) AS shared FROM k x JOIN k y USING ({FIVE}) WHERE x.sample_id <> y.sample_id GROUP BY 1, 2),
edges AS (SELECT source, target FROM o JOIN size s ON s.sample_id = source JOIN size t ON t.sample_id = target JOIN sample p ON p.sample_id = source JOIN sample q ON q.sample_id = target
WHERE shared = s.n AND s.n < t.n AND p.collection_date < q.collection_date)"""


def edges(spark, d):
    return cohort.transmission_edges(spec(spark, d), view(spark, d, "sample"))


@query(EDGES + "SELECT * FROM edges", (*BASE, "sample"))
def transmission_edges(spark, d):
    return edges(spark, d)


@query(EDGES + "SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x JOIN edges y ON x.target = y.source WHERE x.source = e.source AND y.target = e.target)", (*BASE, "sample"))
def transmission_reduced(spark, d):
    return cohort.reduced(edges(spark, d))


@query(COHORT + """, n AS (SELECT count(DISTINCT sample_id) AS n FROM cohort), c AS (SELECT DISTINCT reference_id, sample_id, ref_pos FROM spectrum WHERE variant_type = 'SNP'),
o AS (SELECT reference_id AS r, ref_pos, count(*) AS c FROM c GROUP BY 1, 2),
aa AS (SELECT reference_id AS r, x.ref_pos AS i, y.ref_pos AS j, count(*) AS aa FROM c x JOIN c y USING (reference_id, sample_id) WHERE x.ref_pos < y.ref_pos GROUP BY 1, 2, 3),
p AS (SELECT x.ref_pos AS i, y.ref_pos AS j, x.c / n.n AS pi, y.c / n.n AS pj, coalesce(aa, 0) / n.n AS pij FROM o x JOIN o y ON x.r = y.r AND x.ref_pos < y.ref_pos
CROSS JOIN n LEFT JOIN aa ON aa.r = x.r AND aa.i = x.ref_pos AND aa.j = y.ref_pos),
q AS (SELECT *, pij - pi * pj AS d, pi * (1 - pi) * pj * (1 - pj) AS v, CASE WHEN pij - pi * pj >= 0 THEN least(pi * (1 - pj), (1 - pi) * pj) ELSE least(pi * pj, (1 - pi) * (1 - pj)) END AS m FROM p)
SELECT i, j, round(d, 6) + 0.0 AS d, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE round(abs(d / m), 6) END AS d_prime, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE round(d * d / v, 6) END AS r2 FROM q""", WITH_COHORT)
def ld_matrix(spark, d):
    return linkage.ld_pairs(cohort_loci(spark, d)).drop("reference_id")


def cohort_loci(spark, d):
    return linkage.loci(spec(spark, d, "cohort_link"), view(spark, d, "cohort"))


@query()
def haplotype_blocks(spark, d):
    return linkage.haplotype_blocks(cohort_loci(spark, d), 0.05)


@query(COHORT + """, snp AS (SELECT sample_id, reference_id, ref_pos, min(alt_base) AS alt FROM spectrum WHERE variant_type = 'SNP' GROUP BY 1, 2, 3),
r AS (SELECT reference_id, ref_pos, min(ref_base) AS ref FROM spectrum WHERE variant_type = 'SNP' GROUP BY 1, 2),
f AS (SELECT s.sample_id, r.reference_id, r.ref_pos, coalesce(alt, ref) AS b FROM (SELECT DISTINCT sample_id FROM snp) s CROSS JOIN r
  LEFT JOIN snp ON snp.sample_id = s.sample_id AND snp.ref_pos = r.ref_pos AND snp.reference_id = r.reference_id),
c AS (SELECT x.sample_id AS a, y.sample_id AS b, count(*) AS n, count(*) FILTER (x.b || y.b IN ('AG', 'GA', 'CT', 'TC')) AS ti,
  count(*) FILTER (x.b <> y.b AND x.b || y.b NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM f x JOIN f y USING (reference_id, ref_pos) WHERE x.sample_id < y.sample_id GROUP BY 1, 2)
SELECT a, b, ti, tv, round(-0.5 * ln((1 - 2 * ti / n - tv / n) * sqrt(1 - 2 * tv / n)), 6) AS distance FROM c""", ("cohort_link", "variant"))
def k2p_distance(spark, d):
    return cohort.k2p(spec(spark, d, "cohort_link"))


AT = "substr('ACGT', CAST(1 + (ref_pos + {k}) % 4 AS int), 1)"
SUBS = "(SELECT unnest(['C>A', 'C>G', 'C>T', 'T>A', 'T>C', 'T>G']) AS s)"


@query(f"""WITH v AS (SELECT sample_id, {AT.format(k=7)} AS l, ref_base AS r, alt_base AS a, {AT.format(k=1)} AS x FROM cohort_link JOIN variant USING (alignment_id) WHERE variant_type = 'SNP'),
t AS (SELECT sample_id, CASE WHEN r IN ('C', 'T') THEN l || '[' || r || '>' || a || ']' || x ELSE translate(x, 'ACGT', 'TGCA') || '[' || translate(r, 'ACGT', 'TGCA') || '>' || translate(a, 'ACGT', 'TGCA') || ']' || translate(l, 'ACGT', 'TGCA') END AS m FROM v),
g AS (SELECT l.l || '[' || s.s || ']' || x.x AS m FROM {SUBS} s, (SELECT unnest(['A', 'C', 'G', 'T']) AS l) l, (SELECT unnest(['A', 'C', 'G', 'T']) AS x) x)
SELECT s.sample_id, g.m AS mutation_type, count(t.m) AS n FROM (SELECT DISTINCT sample_id FROM t) s CROSS JOIN g LEFT JOIN t ON t.sample_id = s.sample_id AND t.m = g.m GROUP BY 1, 2""", ("cohort_link", "variant"))
def context_spectrum(spark, d):
    snp = view(spark, d, "cohort_link").join(view(spark, d, "variant").where("variant_type = 'SNP'"), "alignment_id")
    label = signatures.context_type(F.expr(AT.format(k=7)), F.col("ref_base"), F.expr(AT.format(k=1)), F.col("alt_base"))
    return signatures.context_spectrum(snp.select("sample_id", label.alias("mutation_type")))


@query("""SELECT signature, count(*) AS n, round(coalesce(regr_slope(exposure, x), 0), 4) AS slope, round(coalesce(regr_intercept(exposure, x), 0), 4) AS intercept, round(coalesce(regr_r2(exposure, x), 0), 4) AS r2
FROM (SELECT *, (epoch(taken)::BIGINT // 86400 - 19000)::DOUBLE AS x FROM exposure) GROUP BY signature""", ("exposure",))
def linear_trend(spark, d):
    e = view(spark, d, "exposure").withColumn("x", (F.expr("unix_seconds(cast(taken as timestamp)) div 86400") - 19000).cast("double"))
    return signatures.linear_trend(e, ["signature"], "x", "exposure")


@query("""SELECT sample_id, signature, total FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY total DESC, signature) AS k FROM
(SELECT sample_id, signature, round(sum(exposure), 6) AS total FROM exposure GROUP BY 1, 2)) WHERE k = 1""", ("exposure",))
def strongest_signature(spark, d):
    return signatures.strongest(view(spark, d, "exposure"))


@query("""WITH e AS (SELECT * FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS ref_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM e a, e b)
SELECT id, rank, ref_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, ref_id) AS rank FROM p) WHERE rank <= 3""")
def signature_match(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    refs = e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref_vector"))
    return signatures.best_matches(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), refs)


@query("""SELECT sequence_id, length(bases) AS n, CASE WHEN length(bases) = 0 THEN 0.0::DOUBLE ELSE round((length(bases) - length(translate(bases, 'GC', ''))) * 100 / length(bases), 2) END AS gc,
sha256(reverse(translate(bases, 'ACGT', 'TGCA'))) AS reverse_sha256 FROM sequence""", ("sequence",))
def sequence_features(spark, d):
    s = view(spark, d, "sequence")
    return s.select("sequence_id", F.length("bases").alias("n"), signatures.gc_percent(F.col("bases")).alias("gc"), F.sha2(signatures.reverse_complement(F.col("bases")), 256).alias("reverse_sha256"))


@query("""SELECT signature, round(f, 6) AS first, round(l, 6) AS last, CASE WHEN abs(f) >= 1e-15 THEN round((l - f) / f * 100, 4) END AS percent FROM
(SELECT signature, avg(exposure) FILTER (taken <= TIMESTAMP '2024-01-10') AS f, avg(exposure) FILTER (taken >= TIMESTAMP '2024-01-20') AS l FROM exposure GROUP BY signature)""", ("exposure",))
def exposure_change(spark, d):
    return signatures.exposure_change(view(spark, d, "exposure"), "2024-01-10", "2024-01-20")


@query(f"""WITH step(pair, dh, ds) AS (VALUES {", ".join(f"('{k}', {h}, {s})" for k, (h, s) in primers.STEPS.items())}), tip(base, th, ts) AS (VALUES {", ".join(f"('{k}', {h}, {s})" for k, (h, s) in primers.ENDS.items())}),
s AS (SELECT sequence_id, bases, length(bases) AS n, least(length(bases), 24) AS size FROM sequence),
letter AS (SELECT sequence_id, bases, n, size, i, substr(bases, i::INT, 1) AS base, substr(bases, i::INT, 2) AS pair FROM s, unnest(range(1, n + 1)) AS r(i)),
summed AS (SELECT sequence_id, bases, n, size, i, base, sum(coalesce(dh, 0)) OVER w AS h, sum(coalesce(ds, 0)) OVER w AS s FROM letter LEFT JOIN step USING (pair)
  WINDOW w AS (PARTITION BY sequence_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 22 FOLLOWING))
SELECT sequence_id, 1 AS place, bases AS primer, 0.0::DOUBLE AS tm FROM s WHERE n < 2
UNION ALL SELECT sequence_id, i, substr(bases, i::INT, size::INT), round((h + a.th + z.th) * 100.0::DOUBLE / ((s + a.ts + z.ts) / 10.0::DOUBLE + {primers.GAS}::DOUBLE * ln({primers.CONCENTRATION:.10f}::DOUBLE / 4)) - 273.15::DOUBLE, 2)
FROM summed JOIN tip a USING (base) JOIN tip z ON z.base = substr(bases, (i + size - 1)::INT, 1) WHERE i <= n - size + 1 AND n >= 2""", ("sequence",))
def melting_temperature(spark, d):
    return primers.window_temperatures(view(spark, d, "sequence"), 24)



@query("""WITH o AS (SELECT l_orderkey AS id, l_linenumber AS place, CASE l_returnflag WHEN 'R' THEN 'M' WHEN 'A' THEN 'I' ELSE 'D' END AS op FROM lineitem),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY place, op) AS run FROM (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY id ORDER BY place, op) = op THEN 0 ELSE 1 END AS new FROM o))
SELECT id, string_agg(t, '' ORDER BY run) AS cigar FROM (SELECT id, run, count(*)::VARCHAR || op AS t FROM r GROUP BY id, run, op) GROUP BY id""")
def cigar_runs(spark, d):
    o = spark.read.parquet(f"{d}/lineitem.parquet")
    op = F.when(F.col("l_returnflag") == "R", "M").when(F.col("l_returnflag") == "A", "I").otherwise("D")
    return signatures.cigar_runs(o.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), op.alias("op")))


@query(f"""WITH p AS (SELECT sequence_id, array_to_string(list_transform(regexp_extract_all(bases, '...'), lambda c:
substr('{bases.AMINO}', 16 * instr('TCAG', c[1]) + 4 * instr('TCAG', c[2]) + instr('TCAG', c[3]) - 20, 1)), '') AS peptide FROM sequence)
SELECT sequence_id, length(peptide) AS n_codons, length(peptide) - length(replace(peptide, '*', '')) AS n_stops, sha256(peptide) AS peptide_sha256 FROM p""", ("sequence",))
def codon_translation(spark, d):
    p = view(spark, d, "sequence").select("sequence_id", bases.translate(F.col("bases")).alias("peptide"))
    stops = F.length("peptide") - F.length(F.replace("peptide", F.lit("*"), F.lit("")))
    return p.select("sequence_id", F.length("peptide").alias("n_codons"), stops.alias("n_stops"), F.sha2("peptide", 256).alias("peptide_sha256"))


@query("""SELECT sample_id, round(year(collection_date) + (month(collection_date) - 1) / 12.0 + (day(collection_date) - 1) / 365.25, 9) AS collected
FROM sample""", ("sample",))
def collection_years(spark, d):
    return view(spark, d, "sample").select("sample_id", F.round(bases.decimal_year(F.col("collection_date")), 9).alias("collected"))


@query("""SELECT reference_id, CASE WHEN ref_base = alt_base THEN 'same' WHEN ref_base || alt_base IN ('AG', 'GA', 'CT', 'TC') THEN 'transition'
ELSE 'transversion' END AS site_class, count(*) AS n FROM variant WHERE variant_type = 'SNP' GROUP BY 1, 2""", ("variant",))
def site_classes(spark, d):
    snp = view(spark, d, "variant").where("variant_type = 'SNP'")
    return snp.groupBy("reference_id", bases.site_class(F.col("ref_base"), F.col("alt_base")).alias("site_class")).agg(F.count("*").alias("n"))


@query(QC + f""", spectrum AS (SELECT sample_id, {FIVE}, count(DISTINCT alignment_id) AS n_alignments FROM link JOIN variant USING (alignment_id) GROUP BY sample_id, {FIVE})
SELECT s.*, q.qc_status, q.failed_rules FROM spectrum s LEFT JOIN qc q ON q.sample_id = s.sample_id AND
{' AND '.join(f'q.{k} = s.{k}' for k in spectrum.KEY)}""", WITH_ALIGNMENT)
def spectrum_with_qc(spark, d):
    return rules.status_of(judged_spectrum(spark, d)).select("sample_id", *spectrum.KEY, "n_alignments", "qc_status", "failed_rules")


@query(QC + """SELECT sample_id, ref_pos, variant_type, failed_rules FROM qc WHERE qc_status = 'FAIL'""", WITH_ALIGNMENT)
def spectrum_failed(spark, d):
    rows = rules.status_of(judged_spectrum(spark, d)).where("qc_status = 'FAIL'")
    return rows.select("sample_id", "ref_pos", "variant_type", "failed_rules")


EFFECT = FIRST[: FIRST.index("\nSELECT")] + """, f AS (SELECT v.*, a.start_pos, coalesce(a.feature_type, 'intergenic') AS feature_type, r.bases, ref_pos - (ref_pos - a.start_pos) % 3 AS s
FROM variant v LEFT JOIN hit h USING (reference_id, ref_pos) LEFT JOIN annotation a ON a.annotation_id = h.annotation_id LEFT JOIN reference r USING (reference_id)),
c AS (SELECT *, CASE WHEN start_pos IS NOT NULL AND feature_type = 'exon' AND variant_type = 'SNP' AND s + 3 <= length(bases) THEN substr(bases, s + 1, 3) END AS codon_ref FROM f),
d AS (SELECT *, substr(codon_ref, 1, ref_pos - s) || alt_base || substr(codon_ref, ref_pos - s + 2) AS codon_alt FROM c),
e AS (SELECT *, {ref} AS aa_ref, {alt} AS aa_alt FROM d),
g AS (SELECT *, CASE WHEN start_pos IS NULL THEN NULL WHEN feature_type <> 'exon' THEN feature_type || '_variant' WHEN variant_type = 'INS' THEN
CASE WHEN length(alt_base) % 3 <> 0 THEN 'frameshift_variant' ELSE 'inframe_insertion' END WHEN variant_type = 'DEL' THEN
CASE WHEN length(ref_base) % 3 <> 0 THEN 'frameshift_variant' ELSE 'inframe_deletion' END WHEN aa_ref = aa_alt THEN 'synonymous_variant'
WHEN aa_ref <> aa_alt AND aa_alt = '*' THEN 'stop_gained' WHEN aa_ref <> aa_alt AND aa_ref = '*' THEN 'stop_lost' ELSE 'missense_variant' END AS consequence FROM e)
SELECT variant_id, feature_type, consequence, codon_ref, codon_alt, aa_ref, aa_alt, CASE WHEN consequence IN ('frameshift_variant', 'stop_gained', 'stop_lost') THEN 'HIGH'
WHEN consequence IN ('missense_variant', 'inframe_insertion', 'inframe_deletion') THEN 'MODERATE' WHEN consequence IN ('synonymous_variant', 'intron_variant', 'UTR_variant') THEN 'LOW' ELSE 'MODIFIER' END AS impact FROM g"""
for side in ("ref", "alt"):
    amino = "substr('{a}', 16 * instr('TCAG', c[1]) + 4 * instr('TCAG', c[2]) + instr('TCAG', c[3]) - 20, 1)".replace("{a}", bases.AMINO).replace("c[", f"codon_{side}[")
    EFFECT = EFFECT.replace("{" + side + "}", amino)


def effects(spark, d):
    return alignment.effects(spectrum.annotate_first(view(spark, d, "variant"), view(spark, d, "annotation")), view(spark, d, "reference"))


@query(EFFECT, ("variant", "annotation", "reference"))
def variant_effects(spark, d):
    return effects(spark, d).select("variant_id", "feature_type", "consequence", "codon_ref", "codon_alt", "aa_ref", "aa_alt", "impact")


@query(EFFECT.replace("SELECT variant_id, feature_type, consequence, codon_ref, codon_alt, aa_ref, aa_alt, CASE", "SELECT impact, count(*) AS n FROM (SELECT CASE") + ") GROUP BY impact",
       ("variant", "annotation", "reference"))
def impact_counts(spark, d):
    return spectrum.counts_by(effects(spark, d), "impact")


def aligned(spark, d):
    return alignment.align(view(spark, d, "probe"), view(spark, d, "reference"))


@query()
def local_alignments(spark, d):
    return alignment.kept(aligned(spark, d))


@query()
def called_variants(spark, d):
    return alignment.called_variants(alignment.kept(aligned(spark, d)))


def cohort_trees(spark, d, *methods):
    """The tree of each method over the cohort's distances, which are computed once."""
    distances = cohort.stored(k2p_distance(spark, d))
    return [cohort.stored(trees.build_trees(distances.withColumn("tree_id", F.lit(m)), m)) for m in methods]


@query()
def cohort_newick(spark, d):
    nj, upgma = cohort_trees(spark, d, "nj", "upgma")
    return trees.newick(nj.unionByName(upgma))


@query()
def tree_comparison(spark, d):
    return trees.compare_trees(*cohort_trees(spark, d, "nj", "upgma"))


@query()
def bootstrap_support(spark, d):
    snp = cohort.stored(spec(spark, d, "cohort_link").where("variant_type = 'SNP'").select("sample_id", *spectrum.KEY))
    tree = trees.build_trees(cohort.k2p(snp).withColumn("tree_id", F.lit("nj")), "nj")
    return trees.support(tree, trees.build_trees(cohort.bootstrap_k2p(snp, 20)), 20)


@query()
def molecular_clock(spark, d):
    dates = view(spark, d, "cohort").select(F.col("sample_id").cast("string").alias("name"), "collection_date")
    return trees.molecular_clock(cohort_trees(spark, d, "nj")[0], dates)


@query()
def extracted_signatures(spark, d):
    return factors.extract_signatures(context_spectrum(spark, d), 3)


@query()
def optimal_factors(spark, d):
    return factors.optimal_k(context_spectrum(spark, d))


@query("""WITH g AS (SELECT signature, count(*) AS n, regr_slope(exposure, x) AS slope, regr_intercept(exposure, x) AS intercept, regr_r2(exposure, x) AS r2
FROM (SELECT *, (epoch(taken)::BIGINT // 86400 - 19000)::DOUBLE AS x FROM exposure) GROUP BY signature),
t AS (SELECT *, CASE WHEN n % 2 = 1 THEN 2 / pi() * (asin(sqrt(r2)) + CASE WHEN n > 3 THEN sqrt(r2 * (1 - r2)) * list_sum(list_transform(range((n - 3) // 2), lambda k: exp(k * ln(4 * (1 - r2)) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)))) ELSE 0 END)
ELSE sqrt(r2) * list_sum(list_transform(range((n - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) + k * ln((1 - r2) / 4)))) END AS within FROM g WHERE n >= 3)
SELECT signature, n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2, round(1 - within, 4) AS p_value,
CASE WHEN 1 - within >= 0.05 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend FROM t""", ("exposure",))
def exposure_trends(spark, d):
    e = view(spark, d, "exposure").withColumn("x", (F.expr("unix_seconds(cast(taken as timestamp)) div 86400") - 19000).cast("double"))
    return signatures.exposure_trends(e, ["signature"], "x", "exposure")
