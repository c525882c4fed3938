"""Chains, cohorts, exposures, branches, dated trees, batches and stored rules on small fixtures, against plain loops."""

import datetime
import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import alignment, cohort, control, factors, signatures, trees
from strandwise.plans import histories

SPECTRUM = "sample_id bigint, reference_id bigint, ref_pos bigint, variant_type string, ref_base string, alt_base string"


def test_new_variants_and_nodes_of_a_chain(spark):
    rng = random.Random(3)
    sets = {s: {(rng.randrange(2), rng.randrange(9), "SNP", "A", rng.choice("CG")) for _ in range(rng.randrange(1, 12))} for s in range(12)}
    rows = [(s, *k) for s, of in sets.items() for k in of]
    table = spark.createDataFrame(rows + rows[:5], SPECTRUM)
    edges = [(a, b) for a in sets for b in sets if a != b]
    got = cohort.edge_variants(table, spark.createDataFrame(edges, "source bigint, target bigint"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b, *k) for a, b in edges for k in sets[b] - sets[a])
    samples = spark.createDataFrame([(s, datetime.date(2024, 1, 1 + s) if s % 4 else None) for s in range(13)], "sample_id bigint, collection_date date")
    nodes = {r.sample_id: (r.variant_count, r.date_unknown) for r in cohort.chain_nodes(samples, table).collect()}
    assert nodes == {s: (len(sets.get(s, ())), s % 4 == 0) for s in range(13)}


def test_distances_within_cohorts(spark, monkeypatch):
    """Equal to k2p of each cohort by itself and to counts by loops, over several blocks and two references."""
    monkeypatch.setattr(cohort, "BLOCK", 5)
    rng = random.Random(8)
    refs = {(r, p): rng.choice("ACGT") for r in (0, 1) for p in range(18)}
    rows = []
    for c, s in itertools.product((4, 5), range(7)):
        for (r, p), base in refs.items():
            if rng.random() < 0.3:
                rows.append((c, 10 * c + s, r, p, "SNP", base, rng.choice([x for x in "ACGT" if x != base])))
        rows.append((c, 10 * c + s, 0, 3, "DEL", "A", ""))
    table = spark.createDataFrame(rows, "cohort_id bigint, " + SPECTRUM)
    got = {(r.cohort_id, r.a, r.b): (r.ti, r.tv, r.distance) for r in cohort.k2p_cohorts(table).collect()}
    for c in (4, 5):
        alone = cohort.k2p(table.where(F.col("cohort_id") == c).drop("cohort_id")).collect()
        assert {k[1:]: v for k, v in got.items() if k[0] == c} == {(r.a, r.b): (r.ti, r.tv, r.distance + 0.0) for r in alone}
        snp = {}
        for row in rows:
            if row[0] == c and row[4] == "SNP":
                snp[row[1], row[2], row[3]] = min(row[6], snp.get((row[1], row[2], row[3]), "Z"))
        sites, ids = {k[1:] for k in snp}, sorted({k[0] for k in snp})
        for a, b in itertools.combinations(ids, 2):
            pairs = [snp.get((a, *k), refs[k]) + snp.get((b, *k), refs[k]) for k in sites]
            ti = sum(p in ("AG", "GA", "CT", "TC") for p in pairs)
            assert got[c, a, b][:2] == (ti, sum(p[0] != p[1] for p in pairs) - ti)
    assert cohort.k2p_cohorts(table.limit(0)).count() == 0


def test_exposures_are_those_of_the_best_run(spark):
    v = np.random.default_rng(4).integers(0, 20, (8, 5)).astype(float)
    cells = spark.createDataFrame([(f"t{i}", j, int(v[i, j])) for i in range(8) for j in range(5)], "mutation_type string, sample_id bigint, n bigint")
    runs = [factors.factored(v, 2, 42 + 1000 * r) for r in range(3)]
    w, h, error, steps = min(runs, key=lambda r: r[2])
    got = factors.exposures(factors.extraction(cells, 2, 3)).collect()
    assert {(r.sample_id, r.signature): r.exposure for r in got} == pytest.approx({(j, k): h[k, j] for j in range(5) for k in range(2)})
    assert {(r.error, r.steps) for r in got} == {(round(error, 6), steps)}
    for j in range(5):  # signatures sum to 1, so that exposures are counts
        assert sum(r.exposure for r in got if r.sample_id == j) == pytest.approx(v[:, j].sum(), rel=0.05)


@pytest.mark.parametrize("whole", [100_000, 0])
def test_median_is_exact(spark, monkeypatch, whole):
    """Also where a sketch bounds the middle: many ties, even and odd numbers, one value, and a hot group."""
    monkeypatch.setattr(signatures, "WHOLE", whole)
    monkeypatch.setattr(signatures, "AROUND", 0.1)
    rng = random.Random(6)
    groups = {"ties": [1.0] * 30 + [2.0] * 31, "even": [rng.random() for _ in range(400)], "odd": [rng.gauss(0, 9) for _ in range(401)], "hot": [rng.random() for _ in range(5000)]}
    groups |= {"one": [7.0], "two": [1.0, 4.0]} if whole else {}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("ties", None), ("none", None)]
    got = signatures.exact_median(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x").collect()
    assert {r.g: r["median"] for r in got} == pytest.approx({g: statistics.median(xs) for g, xs in groups.items()})


def leaves(spark, distances):
    return trees.build_trees(spark.createDataFrame([("t", a, b, float(d)) for (a, b), d in distances.items()], "tree_id string, a bigint, b bigint, distance double"))


def test_inconsistent_branches(spark):
    """Two trees of six leaves: ((0,1),2,(3,(4,5))) and ((0,2),1,(3,(4,5)))."""

    def distances(first):
        pairs, at = {}, {**dict.fromkeys(first, 0), 3: 2, 4: 3, 5: 3}
        for a, b in itertools.combinations(range(6), 2):
            side = lambda x: at.get(x, 1)
            pairs[a, b] = 2 + abs(side(a) - side(b)) if side(a) != side(b) else 2
        return pairs

    one, other = leaves(spark, distances((0, 1))), leaves(spark, distances((0, 2)))
    stored = lambda t: {tuple(r.split) for r in trees.splits(t).collect()}
    x, y = stored(one), stored(other)
    everyone = {str(k) for k in range(6)}
    rest = lambda s: tuple(sorted(everyone - set(s)))
    want = {("a", rest(s), s) for s in x - y} | {("b", s, rest(s)) for s in y - x}  # what is kept of a split is what lies below the node
    got = {(r.found_in, tuple(r.split_a), tuple(r.split_b)) for r in trees.inconsistent_branches(one, other).collect()}
    assert got == want and len(want) >= 2
    assert len(want) == trees.compare_trees(one, other).first().rf
    assert trees.inconsistent_branches(one, one).count() == 0
    two = one.where("node < 2").limit(0)
    assert trees.inconsistent_branches(one, two).count() == 0


def test_years_of_a_good_clock(spark):
    """Depth grows by 0.01 a year from 2000 on: inner nodes get the year of their depth, dated leaves their own."""
    rows = [("t", 10, None, None, None, 0.0), ("t", 9, 10, None, 0.05, 0.05)] + [("t", k, 9, f"s{k}", 0.05, 0.01 * (10 + k)) for k in range(6)] + [("t", 6, 9, "undated", 0.1, 0.15)]
    t = spark.createDataFrame(rows, "tree_id string, node int, parent int, name string, length double, depth double")
    dates = spark.createDataFrame([(f"s{k}", datetime.date(2010 + k, 1, 1)) for k in range(6)] + [("undated", None)], "name string, collection_date date")
    clock = trees.molecular_clock(t, dates)
    assert not clock.first().poor and clock.first().rate == pytest.approx(0.01)
    years = {r.node: r.year for r in trees.divergence_times(t, clock, dates).collect()}
    assert years == pytest.approx({10: 2000, 9: 2005, 6: 2015} | {k: 2010 + k for k in range(6)})


def test_batches(spark):
    bases = "GATTACAGCATGCCGTTAGCATTGACCGATACGGATCCATTGACGAT"
    references = spark.createDataFrame([(1, bases), (2, bases[10:]), (3, bases)], "reference_id int, bases string")
    items = [(0, 0, bases[3:30]), (0, 1, bases[22:40]), (0, 2, None), (0, 3, ""), (0, 4, "N")]
    items += [(1, k, bases[:9]) for k in range(51)] + [(2, 0, "A" * 1001), (2, 1, bases)] + [(3, k, bases[12:30]) for k in range(50)] + [(4, 0, "ACGT" * 250)]
    table = spark.createDataFrame([*items, items[0]], "batch_id int, order_index int, query string")
    got = {(r.batch_id, r.order_index): r for r in alignment.batch_results(table, references).collect()}
    assert set(got) == {i[:2] for i in items}
    for b, k, q in items:
        r = got[b, k]
        if b in (1, 2):
            assert r.status == "rejected" and r.error and r.score is None
        elif q is None:
            assert (r.status, r.error, r.score) == ("failed", "no query", None)
        else:
            best = min((-alignment.local_alignment(q, ref)[0], i) for i, ref in ((1, bases), (2, bases[10:]), (3, bases)))
            assert (r.status, r.error) == ("completed", None)
            assert (r.score, r.reference_id) == ((-best[0], best[1]) if best[0] else (None, None))


def test_failures_of_a_batch_are_told_from_results(spark, tmp_path):
    """Items without a place and places with several queries fail and are there; what has no alignment isn't aligned; no probe is left out for the size of its batch."""
    bases = "GATTACAGCATGCCGTTAGCATTGACCGATACGGATCCATTGACGAT"
    references = spark.createDataFrame([(1, bases)], "reference_id int, bases string")
    items = [(0, 0, bases[:9]), (0, 0, bases[5:20]), (0, None, bases[:9]), (None, 3, bases[:9]), (0, 4, bases[:9]), (0, 4, None), (0, 5, "N"), (0, 6, bases[:9]), (0, 6, bases[:9])]
    got = {(r.batch_id, r.order_index): (r.status, r.error, r.score, r.aligned) for r in alignment.batch_results(spark.createDataFrame(items, "batch_id int, order_index int, query string"), references).collect()}
    several, nowhere = ("failed", "several queries for one place", None, False), ("failed", "no batch or place", None, False)
    assert got == {(0, 0): several, (0, None): nowhere, (None, 3): nowhere, (0, 4): several, (0, 5): ("completed", None, None, False), (0, 6): ("completed", None, 18, True)}

    spark.range(1500).selectExpr("id as item_id", "substr('acgtacgtta', cast(id % 5 + 1 as int), 6) as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(20).selectExpr("id as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = histories.batch_alignments(spark, str(tmp_path)).collect()
    assert len(rows) == 1500 and {r.status for r in rows} == {"completed"} and all(r.aligned for r in rows)


RULES = "rule_set_id bigint, rule_id bigint, rule_index int, rule_type string, min_alignment_score int, min_coverage_depth int, edge_margin int"


def test_stored_rules(spark):
    sets = spark.createDataFrame([(1, False), (2, True), (3, False)], "rule_set_id bigint, is_active boolean")
    rules = spark.createDataFrame(
        [(1, 10, 0, "coverage_depth", None, 1, None), (2, 20, 1, "edge_position", None, None, 5), (2, 21, 0, "alignment_score", 30, None, None),
         (2, 22, 2, "coverage_depth", None, 2, None), (2, 23, 3, "unknown", 1, 1, 1), (2, 24, 4, "edge_position", 9, 9, None)], RULES)
    evidence = spark.createDataFrame(
        [(1, 0, 50, "SNP", "A", "C", 2, 30.0), (1, 0, 5, "SNP", "A", "C", 2, 30.0), (1, 0, 96, "SNP", "A", "C", 1, None), (2, 0, 95, "SNP", "A", "C", 2, 29.5), (2, 7, 6, "SNP", "A", "C", 2, 99.0)],
        SPECTRUM + ", depth bigint, best_score double")
    lengths = spark.createDataFrame([(0, 100)], "reference_id bigint, length bigint")
    results = control.judged(evidence, control.active_rules(sets, rules), lengths)
    got = {(r.sample_id, r.ref_pos): ([tuple(f) for f in r.failed], r.qc_status, r.rule_set_id) for r in results.collect()}
    edge = (1, 20, "edge_position", 5.0)
    assert got == {
        (1, 50): ([], "PASS", 2), (1, 5): ([(*edge, 5.0)], "FAIL", 2), (2, 95): ([(0, 21, "alignment_score", 30.0, 29.5)], "FAIL", 2), (2, 6): ([], "PASS", 2),
        (1, 96): ([(0, 21, "alignment_score", 30.0, None), (*edge, 5.0), (2, 22, "coverage_depth", 2.0, 1.0)], "FAIL", 2),
    }
    assert control.failures(results).count() == 5
    none = control.judged(evidence, control.active_rules(sets.where("not is_active"), rules), lengths)
    assert none.count() == 0

    early = control.judged(evidence.where("sample_id = 2"), control.active_rules(sets.withColumn("is_active", F.col("rule_set_id") == 1), rules), lengths)
    marked = control.marked(results.where("sample_id = 1").unionByName(early), sets)
    spectrum = evidence.drop("depth", "best_score").union(spark.createDataFrame([(1, 0, 77, "SNP", "A", "C"), (3, 0, 1, "SNP", "A", "C")], SPECTRUM))
    samples = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "sample_id bigint")
    summary = {r[0]: tuple(r)[1:] for r in control.sample_summary(samples, spectrum, marked).collect()}
    assert summary == {1: (True, False, 4, 1, 2, 0), 2: (True, True, 2, 0, 0, 2), 3: (False, False, 1, 0, 0, 0), 4: (False, False, 0, 0, 0, 0)}
    assert sorted((r.sample_id, r.ref_pos) for r in control.visible(spectrum, marked).collect()) == [(1, 50), (2, 6), (2, 95), (3, 1)]
    # without an active set every result is stale, and all variants show
    assert control.visible(spectrum, control.marked(results, sets.where("not is_active"))).count() == spectrum.count()

    asked = spark.createDataFrame([(1, True), (2, True), (4, True), (9, False)], "sample_id bigint, known boolean")
    runs = control.batch_run(asked, spectrum, results)
    assert {r.sample_id: (r.total_variants, r.pass_count, r.fail_count, r.pass_rate, r.error) for r in runs.collect()} == {
        1: (4, 1, 2, 0.25, None), 2: (2, 1, 1, 0.5, None), 4: (0, 0, 0, 0.0, None), 9: (0, 0, 0, 0.0, "sample not found"),
    }
    assert tuple(control.batch_totals(runs).first()) == (4, 3, 1, 0.25)
    assert tuple(control.batch_totals(runs.limit(0)).first()) == (0, 0, 0, 0.0)


def test_coded_variants_of_edges_equal_sets(spark):
    """Edges and their new variants by codes are those of sets of keys; a key with a null is no other sample's; candidate pairs ship codes, not keys."""
    from strandwise.operators import cohort

    kind = "sample_id long, reference_id long, ref_pos long, variant_type string, ref_base string, alt_base string"
    rng = __import__("random").Random(4)
    keys = [(0, p, "SNP", "A", b) for p in range(6) for b in "CG"]
    have = {s: set(rng.sample(keys, rng.randint(1, 9))) for s in range(30)}
    have[31] = {(0, 1, "SNP", "A", None)}
    have[32] = {(0, 1, "SNP", "A", None), (0, 2, "SNP", "A", "C")}
    rows = [(s, *k) for s, of in have.items() for k in of]
    df = spark.createDataFrame(rows + rows, kind)
    samples = spark.sql("select id sample_id, date_add(date'2020-01-01', cast(id as int)) collection_date from range(40)")
    want = {(a, b) for a in have for b in have if a < b and have[a] < have[b] and a < 31}
    edges = cohort.transmission_edges(df, samples)
    assert {tuple(r) for r in edges.collect()} == want and want
    own, known = cohort.coded(df, df)
    assert own.columns == ["sample_id", "variant", "apart"] and own.count() == len(rows)
    assert known.count() == len({k for of in have.values() for k in of})
    pairs = spark.createDataFrame([*want, (31, 32)], "source long, target long")
    got = {tuple(r) for r in cohort.edge_variants(df, pairs).collect()}
    assert got == {(a, b, *k) for a, b in want for k in have[b] - have[a]} | {(31, 32, *k) for k in have[32]}


def shuffled_rows(spark):
    """Rows that all stages so far have shuffled."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_of_a_chain_bring_arrays_not_rows(spark):
    """Nested samples, each pair of which shares many variants: a variant is shuffled for its sample, not for every pair that has it."""
    rows = [(s, 0, p, "SNP", "A", "C") for s in range(40) for p in range(10 * (s + 1))]
    df = spark.createDataFrame(rows, SPECTRUM)
    samples = spark.sql("select id sample_id, date_add(date'2020-01-01', cast(id as int)) collection_date from range(40)")
    own, known = cohort.coded(df, df)
    before = shuffled_rows(spark)
    edges = cohort.coded_edges(own, samples)
    assert {tuple(r) for r in edges.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert shuffled_rows(spark) - before < 3 * len(rows)  # all pairs share 106,600 variants
    few = spark.createDataFrame([(0, 39), (38, 39), (50, 1)], "source long, target long")
    assert sorted(r.ref_pos for r in cohort.coded_edge_variants(own, known, few).collect()) == sorted([*range(10, 400), *range(390, 400), *range(20)])
