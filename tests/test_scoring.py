"""Default rules, sample scores, filters and the report on small fixtures, and called variants to effects."""

from strandwise.operators import alignment, rules, spectrum


def test_default_rules_and_sample_scores(spark):
    fields = "sample_id long, consequence string, feature_type string, impact string, variant_type string, population_frequency double, gene_name string"
    rows = [
        (1, "stop_gained", "exon", "HIGH", "SNP", 0.01, "A"),
        (1, "missense_variant", "exon", "MODERATE", "SNP", 0.5, "B"),
        (2, "intron_variant", "intron", "LOW", "DEL", 0.05, "A"),
        (2, None, "intergenic", "MODIFIER", "SNP", None, None),
        (3, "synonymous_variant", "exon", "LOW", "SNP", 0.051, "A"),
    ]
    details = rules.detailed(spark.createDataFrame(rows, fields), spark.createDataFrame(rules.DEFAULT_RULES, rules.RULE))
    got = {(r.sample_id, r.feature_type, r.consequence): (r.variant_score, r.variant_classification, r.matched_rules) for r in details.collect()}
    assert got == {
        (1, "exon", "stop_gained"): (8.0, "pathogenic", ["nonsense_mutation"]),
        (1, "exon", "missense_variant"): (-2.0, "uncertain_significance", ["high_population_frequency", "missense_mutation"]),
        (2, "intron", "intron_variant"): (-2.0, "uncertain_significance", ["intron_variant"]),
        (2, "intergenic", None): (-4.0, "likely_benign", ["intergenic_variant"]),
        (3, "exon", "synonymous_variant"): (-9.0, "benign", ["high_population_frequency", "synonymous_mutation"]),
    }
    samples = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "sample_id long")
    assert sorted(map(tuple, rules.sample_scores(details, samples).collect())) == [
        (1, 6.0, "pathogenic", 2), (2, -6.0, "benign", 2), (3, -9.0, "benign", 1), (4, 0.0, "uncertain_significance", 0),
    ]
    assert rules.detail_filter(details, gene="A").count() == 3 and rules.detail_filter(details, "pathogenic", "A").count() == 1
    half = rules.detailed(spark.createDataFrame(rows[:1], fields), spark.createDataFrame([("h", "impact", "eq", "HIGH", 0.5)], rules.RULE))
    assert half.first().variant_score == 0.5
    bare = rules.detailed(spark.createDataFrame(rows[:1], fields), spark.createDataFrame([], rules.RULE)).first()
    assert bare.variant_score == 0.0 and bare.matched_rules == []


def test_report(spark):
    rows = [(1, 0, 0, "FAIL", "edge_position"), (1, 0, 500, "FAIL", "edge_position,alignment_score"), (2, 0, 501, "PASS", ""), (2, 0, 1200, "FAIL", "coverage_depth"), (2, 1, 3, "PASS", "")]
    results = spark.createDataFrame(rows, "sample_id long, reference_id int, ref_pos long, qc_status string, failed_rules string")
    assert sorted(map(tuple, rules.report_totals(results).collect())) == [(0, 2, 4, 1, 3, 0.25), (1, 1, 1, 1, 0, 1.0)]
    lengths = spark.createDataFrame([(0, 1201), (1, 900)], "reference_id int, length long")
    assert sorted(map(tuple, rules.hot_buckets(results, lengths).collect())) == [(0, 1, 1001, 1201, 2, 0.004), (0, 2, 1, 500, 1, 0.002)]
    assert sorted(map(tuple, rules.rule_shares(results).collect())) == [(0, "alignment_score", 1, 25.0), (0, "coverage_depth", 1, 25.0), (0, "edge_position", 2, 50.0)]
    assert rules.report_totals(results.limit(0)).count() == rules.hot_buckets(results.limit(0), lengths).count() == rules.rule_shares(results.limit(0)).count() == 0


def test_filters_and_sites(spark):
    rows = [(1, 0, 9, "SNP", "A", "C", "LOW", "g"), (1, 0, 9, "SNP", "A", "G", "HIGH", "g"), (1, 1, 9, "DEL", "A", "", "HIGH", None), (2, 0, 3, "SNP", "A", "G", "HIGH", "h")]
    table = spark.createDataFrame(rows, "sample_id long, reference_id int, ref_pos long, variant_type string, ref_base string, alt_base string, impact string, gene_name string")
    assert [r.sample_id for r in spectrum.filtered(table, reference_id=0, impact="HIGH").collect()] == [2, 1]
    assert spectrum.filtered(table, gene="g", variant_type="SNP").count() == 2 and spectrum.filtered(table, gene="").count() == 4
    assert sorted(map(tuple, spectrum.by_site(table.union(table)).collect())) == [(1, 0, 9, "SNP:A:C,SNP:A:G", 2), (1, 1, 9, "DEL:A:", 1), (2, 0, 3, "SNP:A:G", 1)]


def test_called_variants_to_effects(spark):
    """A query with one other base within an exon: called, placed and translated in one chain."""
    bases = "GATTACAGCATGCCGTTAGCATTGACCGATACGGATCCATTGACGAT"
    query = bases[:20] + "C" + bases[21:]
    references = spark.createDataFrame([(7, bases)], "reference_id int, bases string")
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    annotations = spark.createDataFrame([(5, 7, 18, 40, "exon", "g")], "annotation_id long, reference_id int, start_pos long, end_pos long, feature_type string, gene_name string")
    called = alignment.called_variants(alignment.kept(alignment.align(queries, references)))
    row = alignment.effects(spectrum.annotate_first(called, annotations), references).first()
    assert (row.ref_pos, row.variant_type, row.ref_base, row.alt_base) == (20, "SNP", bases[20], "C")
    assert (row.codon_ref, row.codon_alt, row.gene_name) == (bases[18:21], bases[18:20] + "C", "g")
    assert row.consequence == ("synonymous_variant" if row.aa_ref == row.aa_alt else "missense_variant")


def carried_rows(spark):
    """Links with repeats and an alignment of two samples, variants with repeats and nulls, alignments that lack some and repeat one."""
    import random

    rng = random.Random(4)
    links = [(rng.randrange(12), a) for a in range(80)] + [(3, 7), (3, 7), (11, 79), (None, 5), (4, None)]
    variants = [(rng.choice([*range(80), None]), n, 1, rng.choice([rng.randrange(9), None]), rng.choice(["SNP", "INS"]), "A", rng.choice("CG")) for n in range(600)]
    variants += [(a, 900 + n, r, p, t, x, y) for a, n, r, p, t, x, y in variants[:90]]
    lost = {a for s, a in links if s in (2, 3)}
    alignments = [(a, rng.choice([10.0, 50.0])) for a in range(80) if a not in lost and a % 5] + [(11, 60.0), (12, None)]
    kind = "alignment_id int, variant_id int, reference_id int, ref_pos int, variant_type string, ref_base string, alt_base string"
    return spark.createDataFrame(links, "sample_id int, alignment_id int"), spark.createDataFrame(variants, kind), spark.createDataFrame(alignments, "alignment_id int, score double"), links, variants, alignments


def test_spectra_and_evidence_are_dealt_by_their_rows(spark, monkeypatch):
    """A task's rows stay when there are more of them, and each five-tuple counts an alignment once."""
    from strandwise.operators import rules, spectrum

    links, variants, alignments, ls, vs, al = carried_rows(spark)
    monkeypatch.setattr(spectrum, "TASK_ROWS", 25)
    seen, best = {}, {}
    for a, n, *key in vs:
        for s, b in ls:
            if a is not None and a == b:
                seen.setdefault((s, *key), {}).setdefault(a, []).append(n)
    for key, by in seen.items():
        scores = [x for a in by for b, x in al if a == b]
        if scores:
            best[key] = len([a for a in by if any(a == b for b, _ in al)]), max((x for x in scores if x is not None), default=None)
    got = spectrum.variant_spectrum(links, variants)
    assert {tuple(r)[:6]: tuple(r)[6:] for r in got.collect()} == {k: (len(by), min(n for ns in by.values() for n in ns)) for k, by in seen.items()}
    assert got.rdd.getNumPartitions() >= 690 // 25
    found = rules.evidence(links, variants, alignments)
    assert {tuple(r)[:6]: tuple(r)[6:] for r in found.collect()} == best and found.rdd.getNumPartitions() >= 690 // 25
    both = rules.with_evidence(links, variants, alignments)
    assert {tuple(r)[:6]: tuple(r)[6:] for r in both.collect()} == {k: (len(by), *best.get(k, (0, None))) for k, by in seen.items()}


def test_a_spectrum_beside_its_results_equals_one_that_meets_them(spark):
    from strandwise.operators import rules, spectrum

    links, variants, alignments, *_ = carried_rows(spark)
    variants = variants.where("ref_pos is not null")
    length = spectrum.table_length(variants)
    judge = lambda e: rules.qc(e, 30, 1, 1, length)
    plain, results = spectrum.variant_spectrum(links.where("sample_id is not null"), variants).drop("first_variant"), judge(rules.evidence(links, variants, alignments))
    judged = judge(rules.with_evidence(links.where("sample_id is not null"), variants, alignments))
    rows = lambda df: sorted((tuple(str(r[c]) for c in sorted(r.asDict())) for r in df.collect()))
    assert rows(rules.passed_of(judged).select(plain.columns)) == rows(rules.passed_only(plain, results))
    assert rows(rules.status_of(judged).select(*plain.columns, "qc_status", "failed_rules")) == rows(rules.with_status(plain, results))
    assert {r.qc_status for r in rules.status_of(judged).collect()} == {"PASS", "FAIL", None}


def test_frequencies_stay_with_their_carriers(spark):
    """Each row of a spectrum gets what population_frequency gives its five-tuple, without being met by it; null keys have none."""
    links, variants, alignments, *_ = carried_rows(spark)
    carriers = rules.with_evidence(links, variants, alignments).select("sample_id", *spectrum.KEY)
    samples = spark.createDataFrame([(k,) for k in range(20)], "sample_id int")
    plain = carriers.join(spectrum.population_frequency(carriers, samples), spectrum.KEY).select("sample_id", *spectrum.KEY, "frequency")
    got = spectrum.with_frequency(carriers, samples, 5)
    assert sorted(map(str, got.select("sample_id", *spectrum.KEY, "population_frequency").collect())) == sorted(map(str, plain.withColumnRenamed("frequency", "population_frequency").collect()))
    assert got.rdd.getNumPartitions() == 5


def test_any_depth_is_found_without_counting(spark):
    """Repeats on all sides: the same five-tuples and best scores as those that are counted, and depth 1 where that is more than 0."""
    links, variants, alignments, *_ = carried_rows(spark)
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    counted = rules.with_evidence(links, variants, alignments)
    got = rules.with_evidence(links, variants, alignments, counted=False)
    assert counted.where("depth > 1").count() and counted.where("depth = 0").count()
    assert rows(got) == rows(counted.selectExpr("sample_id", *spectrum.KEY, "least(depth, 1) as depth", "best_score"))


def test_first_features_of_sites(spark):
    """Each site once, with what annotate_first gives it: features that overlap or reach over bins, of other references, none, and null positions."""
    variants = spark.createDataFrame([(r, p) for r in (0, 1) for p in (*range(0, 300, 7), 49, 50, None)] * 2, "reference_id int, ref_pos int")
    annotations = [(5, 0, 10, 130, "exon", "a"), (3, 0, 100, 110, "intron", "b"), (4, 1, 50, 50, "UTR", None), (9, 0, 105, 299, "exon", "c"), (1, 2, 0, 300, "exon", "d")]
    annotations = spark.createDataFrame(annotations, "annotation_id int, reference_id int, start_pos int, end_pos int, feature_type string, gene_name string")
    columns = ["reference_id", "ref_pos", "annotation_id", "start_pos", "feature_type", "gene_name"]
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(columns).collect())
    got = spectrum.first_features(variants, annotations)
    assert rows(got) == rows(spectrum.annotate_first(variants.distinct(), annotations)) and got.where("feature_type = 'intron'").count() == 1
    assert plan_of(got).count("Aggregate [ref_pos") + plan_of(got).count("Aggregate [reference_id") <= 2


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_read_the_variants_of_samples_once(spark):
    """The carriers, their frequencies and their judgement come from one pass, and a filter of classes doesn't repeat the consequences."""
    from strandwise.plans import scoring

    for name in ("sample_scores", "score_details", "score_detail_filter"):
        plan = plan_of(scoring.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("l_linenumber#") and sum("Relation" not in line and "AS alt_base#" in line for line in plan.splitlines()) == 1
        assert len(plan) < 60_000


def test_conditions_of_rules_are_those_of_their_texts(spark):
    """Numbers and texts by each operator, null fields, null weights and names, rules on fields that are passed over."""
    fields = "k int, consequence string, feature_type string, impact string, variant_type string, population_frequency double"
    rows = [(1, "7", "exon", None, "SNP", 0.1), (2, "07", "x", "HIGH", None, None), (3, None, "-3", "LOW", "DEL", float("inf"))]
    table = [
        ("a", "consequence", "eq", "7", 1.0), ("b", "consequence", "ne", "7", 2.0), ("c", "consequence", "gte", "7.0", 4.0), ("d", "feature_type", "lt", "0", 8.0), (None, "population_frequency", "eq", "1e-1", 16.0),
        ("f", "population_frequency", "gt", "5", 32.0), ("g", "population_frequency", "gt", "none", 64.0), ("h", "gene_name", "ne", "g", 128.0), ("a", "impact", "eq", "HIGH", 256.0), ("z", "impact", "like", "LOW", 512.0),
    ]
    got = rules.detailed(spark.createDataFrame(rows, fields), spark.createDataFrame(table, rules.RULE))
    assert {r.k: (r.variant_score, r.matched_rules) for r in got.collect()} == {1: (21.0, [None, "a", "c"]), 2: (262.0, ["a", "b", "c"]), 3: (40.0, ["d", "f"])}
    assert got.where("variant_score > 30").count() == 2
