"""Alignment, effects, trees, clocks, factors and trends against plain loops and hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import alignment, cohort, factors, signatures, trees


def plain_alignment(q, r):
    """Local alignment cell by cell: score, ends and both texts."""
    h = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
    best, end = 0, (0, 0)
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if q[i - 1] == r[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
            if h[i][j] > best:
                best, end = h[i][j], (i, j)
    i, j = end
    x = y = ""
    while i and j and h[i][j]:
        if h[i][j] == h[i - 1][j - 1] + (2 if q[i - 1] == r[j - 1] else -1):
            i, j, x, y = i - 1, j - 1, q[i - 1] + x, r[j - 1] + y
        elif h[i][j] == h[i - 1][j] - 2:
            i, x, y = i - 1, q[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, r[j - 1] + y
    return (best, i, end[0] - 1, j, end[1] - 1, x, y) if best else (0, 0, 0, 0, 0, "", "")


def test_local_alignment_equals_plain_loops():
    rng = random.Random(1)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for _ in range(150):
        q, r = bases(rng.randrange(12)), bases(rng.randrange(30))
        assert alignment.local_alignment(q, r) == plain_alignment(q, r), (q, r)


def test_large_pairs_align_around_seeds(monkeypatch):
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(4000))
    q = ref[2500:2560] + ref[2563:2620]  # three bases deleted
    whole = alignment.local_alignment(q, ref)
    monkeypatch.setattr(alignment, "CELLS", 10)
    assert alignment.local_alignment(q, ref) == whole
    assert alignment.local_alignment("ACGT" * 5, "T" * 50) == plain_alignment("ACGT" * 5, "T" * 50)


def test_large_pairs_align_as_small_ones_do(monkeypatch):
    """The best alignment shares no whole word with its query where a worse one does: a pair's size must not decide which is found."""
    rng = random.Random(14)
    q = "".join(rng.choice("ACGT") for _ in range(220))
    best = "".join("ACGT"["ACGT".index(b) - 1] if k % 7 == 3 else b for k, b in enumerate(q))
    ref = q[:30] + "".join(rng.choice("ACGT") for _ in range(700)) + best + "".join(rng.choice("ACGT") for _ in range(100))
    want = plain_alignment(q, ref)
    assert want[3] > 700
    assert alignment.local_alignment(q, ref) == want
    monkeypatch.setattr(alignment, "CELLS", 1000)  # a few rows at a time, and scored as more cells than these
    assert alignment.local_alignment(q, ref) == want
    monkeypatch.undo()
    far = "".join(rng.choice("ACGT") for _ in range(30_000))
    score, *_, start, end, x, y = alignment.local_alignment(q, far + ref)
    assert len(q) * len(far + ref) > alignment.CELLS and (score, start, end, x, y) == (want[0], want[3] + 30_000, want[4] + 30_000, *want[5:])


def test_align_and_call(spark):
    ref = "ACGTTGCAAGGCTTAACCGGATATCGCGTTAAGCCTAGGA"
    cases = {1: ref[:10] + "T" + ref[11:], 2: ref[:20] + "GGG" + ref[20:], 3: ref[:20] + ref[23:], 4: None, 5: "", 6: ref.lower()}
    q = spark.createDataFrame(list(cases.items()), "query_id bigint, query string")
    refs = spark.createDataFrame([(7, ref), (8, None), (9, "TTTT")], "reference_id bigint, bases string")
    done = alignment.align(q, refs).cache()
    rows = {(r.query_id, r.reference_id): r for r in done.collect()}
    assert len(rows) == 18 and rows[4, 7].score == rows[1, 8].score == rows[5, 9].score == 0 and rows[4, 7].cigar == rows[4, 7].match == ""
    assert rows[6, 7].score == 2 * len(ref) and rows[6, 7].cigar == f"{len(ref)}M" and rows[6, 7].match == "|" * len(ref)
    for (k, r), row in rows.items():
        plain = plain_alignment((cases[k] or "").upper(), {7: ref, 8: "", 9: "TTTT"}[r])
        assert (row.score, row.query_start, row.query_end, row.ref_start, row.ref_end, row.aligned_query, row.aligned_ref) == plain
    assert {(r.query_id, r.reference_id) for r in alignment.kept(done).collect()} == {(k, 7) for k in (1, 2, 3, 6)}
    got = {r.query_id: (r.variant_type, r.ref_pos, r.ref_base, r.alt_base, r.ref_pos_end) for r in alignment.called_variants(alignment.kept(done)).collect()}
    assert got[1] == ("SNP", 10, ref[10], "T", 10)
    assert got[2][0] == "INS" and len(got[2][3]) == 3 and got[2][2] == "" and got[2][1] == got[2][4]
    assert got[3][0] == "DEL" and len(got[3][2]) == 3 and got[3][3] == "" and got[3][4] == got[3][1] + 2
    assert ref[: got[3][1]] + ref[got[3][1] + 3 :] == cases[3] and 6 not in got
    assert alignment.called_variants(done.limit(0)).count() == 0


def test_effects_by_hand(spark):
    ref = "CCATGTGGTAACC"  # exon from 2: ATG TGG TAA, then CC is cut
    rows = [
        (1, "SNP", 5, "T", "C", 2, "exon"), (2, "SNP", 7, "G", "A", 2, "exon"), (3, "SNP", 8, "T", "C", 2, "exon"), (4, "SNP", 10, "A", "G", 2, "exon"),
        (5, "SNP", 12, "C", "T", 2, "exon"), (6, "INS", 5, "", "A", 2, "exon"), (7, "INS", 5, "", "ACG", 2, "exon"), (8, "DEL", 5, "TG", "", 2, "exon"),
        (9, "SNP", 5, "T", "C", 2, "intron"), (10, "SNP", 5, "T", "C", 2, "UTR"), (11, "SNP", 0, "C", "T", None, "intergenic"), (12, "SNP", 0, "C", "T", 0, "repeat"),
    ]
    v = spark.createDataFrame(rows, "id int, variant_type string, ref_pos bigint, ref_base string, alt_base string, start_pos bigint, feature_type string").withColumn("reference_id", F.lit(1))
    refs = spark.createDataFrame([(1, ref)], "reference_id int, bases string")
    got = {r.id: (r.consequence, r.impact, r.codon_ref, r.codon_alt, r.aa_ref, r.aa_alt) for r in alignment.effects(v, refs).collect()}
    none = (None,) * 4
    assert got == {
        1: ("missense_variant", "MODERATE", "TGG", "CGG", "W", "R"), 2: ("stop_gained", "HIGH", "TGG", "TGA", "W", "*"), 3: ("stop_lost", "HIGH", "TAA", "CAA", "*", "Q"),
        4: ("synonymous_variant", "LOW", "TAA", "TAG", "*", "*"), 5: ("missense_variant", "MODERATE", *none), 6: ("frameshift_variant", "HIGH", *none),
        7: ("inframe_insertion", "MODERATE", *none), 8: ("frameshift_variant", "HIGH", *none), 9: ("intron_variant", "LOW", *none), 10: ("UTR_variant", "LOW", *none),
        11: (None, "MODIFIER", *none), 12: (None, "MODIFIER", *none),
    }
    narrow = alignment.with_codon(v.where("id < 6"), refs, 4).select("id", "codon_ref").collect()  # codons across blocks
    assert dict(map(tuple, narrow)) == {1: "TGG", 2: "TGG", 3: "TAA", 4: "TAA", 5: None}


def distances(spark, d, tree="t"):
    n = len(d)
    return spark.createDataFrame([(tree, a, b, float(d[a][b])) for a in range(n) for b in range(a + 1, n)], "tree_id string, a bigint, b bigint, distance double")


FOUR = [[0, 2, 6, 10], [2, 0, 6, 10], [6, 6, 0, 10], [10, 10, 10, 0]]


def test_trees_by_hand(spark):
    up = trees.build_trees(distances(spark, FOUR), "upgma").cache()
    assert trees.newick(up).first().newick == "(3:5.000000,(2:3.000000,(0:1.000000,1:1.000000):2.000000):2.000000);"
    additive = [[0, 5, 9, 9], [5, 0, 10, 10], [9, 10, 0, 8], [9, 10, 8, 0]]
    nj = trees.build_trees(distances(spark, additive)).cache()
    leaf = {r.name: r for r in nj.where("name is not null").collect()}
    for a in range(4):
        for b in range(a + 1, 4):  # path lengths give an additive matrix back
            paths = nj.where(F.array_contains("leaves", str(a)) & F.array_contains("leaves", str(b))).agg(F.max("depth")).first()[0]
            assert leaf[str(a)].depth + leaf[str(b)].depth - 2 * paths == pytest.approx(additive[a][b])
    assert sorted(tuple(r.split) for r in trees.splits(up).collect()) == [("2", "3")]
    same = trees.compare_trees(up, up).first()
    assert (same.rf, same.normalized_rf, same.weight_dist) == (0, 0.0, 0.0) and same.matching == same.total == 1
    few = trees.compare_trees(up, trees.build_trees(distances(spark, [[0, 1], [1, 0]]))).first()
    assert (few.rf, few.normalized_rf, few.total) == (-1, 1.0, 0)
    known = distances(spark, FOUR).withColumn("distance", F.when(F.col("b") != 3, F.col("distance")))
    assert trees.build_trees(known, "upgma").where("parent is null").first().leaves in (["0", "1", "2"], ["3"])


def test_support_of_equal_replicates_is_whole(spark):
    tree = trees.build_trees(distances(spark, FOUR), "upgma")
    same = distances(spark, FOUR, "x").unionByName(distances(spark, FOUR, "y"))
    got = trees.support(tree, trees.build_trees(same, "upgma"), 2).collect()
    assert [r.support for r in got] == [100.0]
    assert "(0:1.000000,1:1.000000)100:2.000000" in trees.newick(tree, trees.support(tree, trees.build_trees(same, "upgma"), 2)).first().newick


def test_bootstrap_equals_resampled_sequences(spark):
    rng = random.Random(3)
    ref = [rng.choice("ACGT") for _ in range(30)]
    snp = [(s, p, ref[p], rng.choice([x for x in "ACGT" if x != ref[p]])) for s in range(4) for p in range(30) if rng.random() < 0.3]
    table = spark.createDataFrame(snp, "sample_id bigint, ref_pos bigint, ref_base string, alt_base string")
    sites = sorted({p for _, p, _, _ in snp})
    seqs = {s: [next((a for t, q, _, a in snp if (t, q) == (s, p)), ref[p]) for p in sites] for s in range(4)}
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "a bigint, b bigint")
    got = {(r.tree_id, r.a, r.b): r.distance for r in trees.bootstrap_distances(cohort.site_differences(table), pairs, table, 3, 9).collect()}
    draws = spark.range(3).selectExpr("cast(id as int) t").selectExpr("t", f"explode(sequence(1L, {len(sites)}L)) k").selectExpr("t", f"pmod(xxhash64(9, t, k), {len(sites)}L) at").collect()
    assert len(got) == 18
    for (t, a, b), d in got.items():
        at = [r.at for r in draws if r.t == t]
        both = [seqs[a][i] + seqs[b][i] for i in at]
        p, q = (sum(x in kinds for x in both) / len(at) for kinds in ({"AG", "GA", "CT", "TC"}, {x + y for x in "AG" for y in "CT"} | {y + x for x in "AG" for y in "CT"}))
        s, u = 1 - 2 * p - q, 1 - 2 * q
        want = -0.5 * math.log(s * math.sqrt(u)) if s > 0 and u > 0 else (p + q) * (1 + 0.5 * (p + q)) + p * p / (2 * q * q) if q > 0 else -math.log(1 - p)
        assert d == pytest.approx(want)


def test_clock(spark):
    rows = [("t", k, 9, f"s{k}", 1.0, 0.01 * k + (0.5 if k == 7 else 0.0)) for k in range(12)]
    t = spark.createDataFrame(rows, "tree_id string, node int, parent int, name string, length double, depth double")
    dates = spark.createDataFrame([(f"s{k}", f"{2010 + k}-01-01") for k in range(12)] + [("s99", None)], "name string, d string").select("name", F.to_date("d").alias("collection_date"))
    r = trees.molecular_clock(t, dates).first()
    x, y = np.arange(2010.0, 2022.0), np.array([r[5] for r in rows])
    slope, intercept = np.polyfit(x, y, 1)
    off = y - slope * x - intercept
    size = np.abs(off).mean()
    out = [f"s{k}" for k in range(12) if abs(off[k]) > 2 * (np.sqrt(((off - size) ** 2).mean()) + size)]
    assert r.slope == pytest.approx(slope, rel=1e-6) and r.intercept == pytest.approx(intercept, rel=1e-6) and sorted(out) == r.outliers
    assert r.r2 == pytest.approx(1 - (off**2).sum() / ((y - y.mean()) ** 2).sum()) and r.poor
    assert trees.molecular_clock(t.limit(2), dates).count() == 0
    times = trees.divergence_times(t, trees.molecular_clock(t, dates), dates)
    assert times.where("year is not null").count() == 0  # a poor clock dates nothing


def plain_factors(v, k, seed, steps):
    m, n = len(v), len(v[0])
    rng = random.Random(seed)
    w = [[rng.random() for _ in range(k)] for _ in range(m)]
    rng = random.Random(seed + 1)
    h = [[rng.random() for _ in range(n)] for _ in range(k)]
    mul = lambda a, b: [[sum(x * y for x, y in zip(r, c, strict=True)) for c in zip(*b, strict=True)] for r in a]
    flip = lambda a: [list(c) for c in zip(*a, strict=True)]
    step = lambda a, p, q: [[x * y / (z + 1e-10) for x, y, z in zip(*rows, strict=True)] for rows in zip(a, p, q, strict=True)]
    for _ in range(steps):
        h = step(h, mul(flip(w), v), mul(mul(flip(w), w), h))
        w = step(w, mul(v, flip(h)), mul(mul(w, h), flip(h)))
    return w, h


def test_factors(spark, monkeypatch):
    v = np.random.default_rng(1).integers(0, 20, (6, 5)).astype(float)
    monkeypatch.setattr(factors, "STEPS", 30)
    w, h, error, steps = factors.factored(v, 2, 7)
    pw, ph = plain_factors(v.tolist(), 2, 7, 30)
    assert steps == 30 and np.allclose(w.sum(axis=0), 1) and np.allclose(w @ h, np.array(pw) @ np.array(ph))
    monkeypatch.undo()  # tasks see no patches
    cells = spark.createDataFrame([(f"t{i}", j, int(v[i, j])) for i in range(6) for j in range(5)], "mutation_type string, sample_id bigint, n bigint")
    done = factors.factor_runs(cells, factors.starts(spark, range(2, 3), 3, 42)).collect()
    want = {r: factors.factored(v, 2, 42 + 1000 * r)[2] for r in range(3)}
    assert {r.run: r.error for r in done} == pytest.approx(want)
    best = factors.extract_signatures(cells, 2, 3).groupBy("signature").agg(F.sum("p").alias("p")).collect()
    assert [r.p for r in best] == pytest.approx([1, 1])


def test_cophenetic_and_recommended(spark):
    pairs = [(2, a, b, float((a < 2) == (b < 2))) for a in range(4) for b in range(a + 1, 4)] + [(3, a, b, 0.5) for a in range(3) for b in range(a + 1, 3)]
    got = dict(map(tuple, factors.cophenetic(spark.createDataFrame(pairs, "k int, a bigint, b bigint, together double")).collect()))
    assert got[2] == pytest.approx(1) and got[3] == 0
    mark = lambda cs: [r.k for r in factors.recommended(spark.createDataFrame(list(enumerate(cs, 2)), "k int, correlation double")).where("recommended").collect()]
    assert mark([0.9, 0.95, 0.7, 0.99]) == [3] and mark([0.5, 0.45, 0.85]) == [4] and mark([0.9]) == [2]


def test_trends_against_integration(spark):
    rng = np.random.default_rng(4)
    for n in (3, 4, 5, 8, 15):
        x, y = np.arange(n, dtype=float), np.arange(n) * 0.3 + rng.normal(0, 1, n)
        df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("s", None, 1.0)], "signature string, x double, y double")
        r = signatures.exposure_trends(df, ["signature"], "x", "y").first()
        r2 = np.corrcoef(x, y)[0, 1] ** 2
        t, f = math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2
        u = (np.arange(200_000) + 0.5) / 200_000 * t
        density = math.gamma((f + 1) / 2) / (math.sqrt(f * math.pi) * math.gamma(f / 2)) * (1 + u**2 / f) ** (-(f + 1) / 2)
        p = 1 - 2 * density.sum() * t / 200_000
        assert r.p_value == pytest.approx(p, abs=1e-4)
        assert r.trend == ("stable" if p >= 0.05 else "rising" if r.slope > 0 else "falling")
    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0), ("level", 1.0, 2.0), ("level", 2.0, 2.0), ("level", 3.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 3.0)]
    got = {r.signature: (r.n, r.slope, r.r2, r.p_value, r.trend) for r in signatures.exposure_trends(spark.createDataFrame(rows, "signature string, x double, y double"), ["signature"], "x", "y").collect()}
    assert got == {"flat": (3, 0.0, 0.0, 1.0, "stable"), "level": (3, 0.0, 1.0, 1.0, "stable")}


def test_letters_beyond_latin_1_are_apart():
    assert alignment.local_alignment("ДЖ", "ЩЫ") == (0, 0, 0, 0, 0, "", "")
    assert alignment.local_alignment("ДЖ", "xДЖ")[0] == 4


def test_equal_alignments_each_show_their_variants(spark):
    row = (1, 7, 10, 0, "ACGT-A", "ATG-CA")
    df = spark.createDataFrame([row, row, (2, 7, 10, 0, "A", "A")], "query_id int, reference_id int, score int, ref_start int, aligned_query string, aligned_ref string")
    got = sorted(map(tuple, alignment.called_variants(df).collect()))
    assert len(got) == 6 and got[::2] == got[1::2]
    assert {(r[2], r[3], r[4], r[5]) for r in got} == {("SNP", 1, "T", "C"), ("INS", 3, "", "T"), ("DEL", 3, "C", "")}


def test_positions_of_two_references_are_two_sites(spark):
    """Sample 1 and 2 differ at position 5 of reference 0, sample 1 and 3 at position 5 of reference 1."""
    kind = "sample_id long, reference_id long, ref_pos long, variant_type string, ref_base string, alt_base string"
    rows = [(1, 0, 5, "SNP", "A", "G"), (2, 1, 5, "SNP", "C", "G"), (3, 0, 5, "SNP", "A", "G"), (3, 0, 9, "SNP", "T", "C"), (4, 1, 7, "DEL", "A", "")]
    df = spark.createDataFrame(rows, kind)
    from strandwise.operators import spectrum

    samples = spark.createDataFrame([(i,) for i in range(1, 5)], "sample_id long")
    maf = {(r.reference_id, r.ref_pos): r.maf for r in spectrum.minor_allele_frequency(df, samples).collect()}
    assert maf == {(0, 5): 0.5, (1, 5): 0.25, (0, 9): 0.25}
    seqs = {1: "GCT", 2: "AGT", 3: "GCC"}  # reference 0 at 5, reference 1 at 5, reference 0 at 9
    got = {(r.a, r.b): (r.ti, r.tv, r.distance) for r in cohort.k2p(df).collect()}
    for (a, b), (ti, tv, d) in got.items():
        both = [x + y for x, y in zip(seqs[a], seqs[b], strict=True)]
        assert ti == sum(x in ("AG", "GA", "CT", "TC") for x in both) and ti + tv == sum(x[0] != x[1] for x in both)
        p, q = ti / 3, tv / 3
        s, t = 1 - 2 * p - q, 1 - 2 * q
        want = -0.5 * math.log(s * math.sqrt(t)) if s > 0 and t > 0 else (p + q) * (1 + 0.5 * (p + q)) + p * p / (2 * q * q) if q > 0 else -math.log(1 - p)
        assert d == pytest.approx(want, abs=1e-6)
    assert set(got) == {(1, 2), (1, 3), (2, 3)}
    pairs = df.sparkSession.createDataFrame(list(got), "a long, b long")
    drawn = trees.bootstrap_distances(cohort.site_differences(df.where("variant_type = 'SNP'")), pairs, df.where("variant_type = 'SNP'"), 4)
    assert drawn.count() == 12


def test_text_that_is_a_number_compares_as_one(spark):
    from strandwise.operators import rules

    row = spark.range(1)
    held = lambda actual, op, value, numeric=False: row.select(rules.condition(F.lit(actual), F.lit(op), F.lit(value), numeric)).first()[0]
    assert held("5", "gt", "3") and not held("5", "lt", "3") and held("10", "gte", "9") and held("2", "lte", "2.0")
    assert not held("A", "gt", "B") and not held("5", "gt", "x") and held("5", "ne", "5.0") and not held(None, "ne", "a")
    assert held(5, "eq", "5.0", True) and held(5, "gt", "3", True) and not held(5, "ne", "x", True)


def test_blocks_of_sites_give_the_same_replicates(spark, monkeypatch):
    """Distances and bootstraps of a cohort by blocks of sites equal those of a table of differences, also over several stretches of positions."""
    monkeypatch.setattr(cohort, "BLOCK", 7)
    monkeypatch.setattr(trees, "STRETCH", 8)
    rng = random.Random(5)
    ref = {(r, p): rng.choice("ACGT") for r in range(2) for p in range(40)}
    rows = [(s, r, p, "SNP", b, rng.choice([x for x in "ACGT" if x != b])) for s in range(5) for (r, p), b in ref.items() if rng.random() < 0.3]
    df = spark.createDataFrame(rows, "sample_id long, reference_id long, ref_pos long, variant_type string, ref_base string, alt_base string")
    pairs = cohort.k2p(df)
    assert pairs.count() == 10
    want = trees.bootstrap_distances(cohort.site_differences(df), pairs, df, 6, 2)
    key = lambda t: {(r.tree_id, r.a, r.b): r.distance for r in t.collect()}
    got = key(cohort.bootstrap_k2p(df, 6, 2))
    assert len(got) == 60 and got == key(want)
    sites = sorted({r[1:3] for r in rows})
    draws = [r.drawn for r in trees.drawn_sites(df, 6, 2).collect()]
    assert sum(map(len, draws)) == 6 * len(sites) and {t for d in draws for t in d} == set(range(6))
    plan = cohort.bootstrap_k2p(df, 6, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "transition" not in plan  # no row for a site of a pair


def test_long_references_align_by_tiles(monkeypatch):
    """Tiles give what the whole matrix gives, in memory of a tile, and those of equal letters are scored once."""
    rng = random.Random(11)
    whole = alignment._local
    cases = []
    for _ in range(60):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 14)))
        r = "".join(rng.choice("ACGT") for _ in range(rng.randrange(200, 400)))
        cases += [(q, r), (q, "ACGT" * 90), (q, r[:50] + q + r[50:] + q + r[:30]), (q, q[: len(q) // 2] + "T" * 300 + q)]
    q = "".join(rng.choice("ACGT") for _ in range(60))  # tiles widen with the query
    cases += [(q, "".join(rng.choice("ACGT") for _ in range(600)) + q[:30] + "GG" + q[30:] + "A" * 90), ("", "ACGT" * 80), ("A", "C" * 300)]
    want = [whole(alignment.letters(q), alignment.letters(r)) for q, r in cases]
    monkeypatch.setattr(alignment, "TILE", 16)
    assert [alignment.local_alignment(q, r) for q, r in cases] == want
    monkeypatch.setattr(alignment, "TILE", 1024)
    scored = []
    tile_end = alignment._tile_end
    monkeypatch.setattr(alignment, "_tile_end", lambda q, t, skip: scored.append(len(t)) or tile_end(q, t, skip))
    assert alignment.local_alignment("GATTACA", "ACGT" * 50_000)[0] > 0
    assert len(scored) <= 4 and max(scored) <= 1024 + 14


def test_codons_of_a_long_reference_take_one_pass(spark):
    """Each block brings its two letters of the next one, and one of ten million letters is cut in seconds."""
    import time

    rng = random.Random(12)
    ref = "".join(rng.choice("ACGTé𝄞") for _ in range(100))
    refs = spark.createDataFrame([(1, ref), (2, ""), (3, None)], "reference_id int, bases string")
    v = spark.createDataFrame([(r, p, 1) for r in (1, 2, 3, 4) for p in range(1, 105)], "reference_id int, ref_pos int, start_pos int")
    for width in (3, 7, 1200):
        for r in alignment.with_codon(v, refs, width).collect():
            start = r.ref_pos - (r.ref_pos - 1) % 3
            assert r.codon_ref == (ref[start : start + 3].upper() if r.reference_id == 1 and start + 3 <= len(ref) else None)
    long = spark.range(1).selectExpr("1 as reference_id", "repeat('ACGT', 2500000) as bases")
    began = time.perf_counter()
    assert alignment.with_codon(v.where("ref_pos = 1 and reference_id = 1"), long).where("codon_ref = 'CGT'").count() == 1
    assert time.perf_counter() - began < 20
