"""Whole results: queries and operators over all rows, against brute force. The registered SQL of some of them takes a subset."""

import datetime
import hashlib
import random

import pytest

from strandwise.operators import cohort, linkage, spectrum
from strandwise.plans import genomics
from strandwise.sources.projection import view

SPECTRUM = "sample_id bigint, reference_id bigint, ref_pos bigint, variant_type string, ref_base string, alt_base string"


def brute_edges(keys, dates):
    sets = {}
    for s, k in keys:
        sets.setdefault(s, set()).add(k)
    dated = {s: x for s, x in sets.items() if dates.get(s)}
    return sorted((a, b) for a in dated for b in dated if sets[a] < sets[b] and dates[a] < dates[b])


def test_transmission_edges_take_all_variants_and_samples(spark):
    rng = random.Random(5)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 8))} for i in range(380, 420)}
    dates = {i: datetime.date(2024, 1, 1 + rng.randrange(9)) if i % 7 else None for i in sets}
    rows = [(i, p % 5, p, "SNP", "A", "C") for i, s in sets.items() for p in s]
    got = cohort.transmission_edges(spark.createDataFrame(rows, SPECTRUM), spark.createDataFrame(list(dates.items()), "sample_id bigint, collection_date date"))
    want = brute_edges([(i, p) for i, s in sets.items() for p in s], dates)
    assert len(want) > 10
    assert sorted(map(tuple, got.collect())) == want


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of 30 samples from 401 on, in five nations; variants of three alignments each over positions up to 29,999."""
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("small"))
    sites = [rng.randrange(30_000) for _ in range(24)] + [29_999]
    people = range(401, 431)
    orders = [(3 * c + k, c, datetime.date(2024, 1, 1 + rng.randrange(20))) for c in people for k in range(3)]
    lines = []
    for o, c, _ in orders:
        for n, site in enumerate(rng.sample(sites[:6] if c % 3 else sites, 1 + (c % 4))):
            lines.append((o, n + 1, site, rng.choice("RRRAN"), float(rng.randrange(20, 60))))
    tables = {
        "lineitem": (lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_returnflag string, l_quantity double"),
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date"),
        "customer": ([(c, f"c{c}", "x", c % 5) for c in people], "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int"),
        "nation": ([(n, f"n{n}") for n in range(5)], "n_nationkey int, n_name string"),
        "part": ([(p, 1 + p % 50, f"b{p % 9}") for p in range(1, 700)], "p_partkey bigint, p_size int, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def carriers(spark, d, links):
    rows = view(spark, d, links).join(view(spark, d, "variant"), "alignment_id").collect()
    return {(r.sample_id, (r.reference_id, r.ref_pos, r.variant_type, r.ref_base, r.alt_base)) for r in rows}


def test_transmission_queries_take_the_whole_spectrum(spark, small):
    dates = {r.sample_id: r.collection_date for r in view(spark, small, "sample").collect()}
    want = brute_edges(carriers(spark, small, "link"), dates)
    assert want
    assert sorted(map(tuple, genomics.QUERIES["transmission_edges"](spark, small).collect())) == want
    direct = [(a, b) for a, b in want if not any((a, x) in want and (x, b) in want for x, _ in want)]
    assert sorted(map(tuple, genomics.QUERIES["transmission_reduced"](spark, small).collect())) == direct


def brute_blocks(pairs, threshold):
    """The reference's greedy walk, by reference."""
    out = []
    for ref in sorted({p[0] for p in pairs}):
        r2 = {(i, j): v for r, i, j, v in pairs if r == ref}
        pos = sorted({x for p in r2 for x in p})
        i = 0
        while i < len(pos):
            e = i
            while e + 1 < len(pos) and all(r2[pos[x], pos[e + 1]] >= threshold for x in range(i, e + 1)):
                e += 1
            out += [(ref, pos[i], pos[e], e - i + 1)] if e > i else []
            i = e + 1
    return out


def test_haplotype_blocks_of_each_reference(spark):
    """References in turn over the same stretch, one of them a single block."""
    rng = random.Random(3)
    pairs = [(r, i, j, 1.0 if r == 2 or rng.random() < 0.8 else 0.1) for r in range(3) for i in range(r, 120, 3) for j in range(i + 3, 120, 3)]
    got = cohort.haplotype_blocks(spark.createDataFrame(pairs, "reference_id int, i bigint, j bigint, r2 double"), 0.5).collect()
    want = brute_blocks(pairs, 0.5)
    assert len(want) > 10
    assert sorted(map(tuple, got)) == want


def brute_linkage(spark, d):
    n = view(spark, d, "cohort").count()
    loci = {}
    for s, k in carriers(spark, d, "cohort_link"):
        if k[2] == "SNP":
            loci.setdefault(k[:2], set()).add(s)
    out = {}
    for (r, i), x in loci.items():
        for (q, j), y in loci.items():
            if r == q and i < j:
                a, b = len(x) / n, len(y) / n
                dd, v = len(x & y) / n - a * b, a * (1 - a) * b * (1 - b)
                m = min(a * (1 - b), (1 - a) * b) if dd >= 0 else min(a * b, (1 - a) * (1 - b))
                out[r, i, j] = (dd, abs(dd / m) if m else 0.0, dd * dd / v if v else 0.0)
    return out


def test_linkage_takes_every_locus_of_a_reference(spark, small):
    want = brute_linkage(spark, small)
    got = {(r.i, r.j): (r.d, r.d_prime, r.r2) for r in genomics.QUERIES["ld_matrix"](spark, small).collect()}
    assert len(want) > 20
    assert set(got) == {k[1:] for k in want}
    assert all(got[k[1:]] == pytest.approx(v, abs=2e-6) for k, v in want.items())
    blocks = sorted(map(tuple, genomics.QUERIES["haplotype_blocks"](spark, small).collect()))
    assert [b[:4] for b in blocks] == brute_blocks([(*k, v[2]) for k, v in want.items()], 0.05)
    for ref, first, last, n, mean in blocks:
        inside = [v[2] for (r, i, j), v in want.items() if r == ref and first <= i and j <= last]
        assert len(inside) == n * (n - 1) // 2 and mean == pytest.approx(sum(inside) / len(inside), abs=2e-6)


def test_linkage_across_tiles(spark, monkeypatch):
    """Tiles of 4 loci: blocks that end within one, reach over several and to the end, over more samples than a word has bits."""
    monkeypatch.setattr(linkage, "TILE", 4)
    rng = random.Random(8)
    rows, n = [], 70
    for ref in range(3):
        for pos in range(60):
            group = set(range(pos // 23 * 9, pos // 23 * 9 + 45)) if pos % 23 else set(rng.sample(range(n), 30))
            rows += [(s, ref, pos * 7, "SNP") for s in group ^ {rng.randrange(n)}]
    spectrum_ = spark.createDataFrame(rows, "sample_id long, reference_id int, ref_pos long, variant_type string")
    samples = spark.range(n).withColumnRenamed("id", "sample_id")
    of = linkage.loci(spectrum_, samples)
    pairs = [(r.reference_id, r.i, r.j, r.r2) for r in linkage.ld_pairs(of).collect()]
    assert len(pairs) == 3 * 60 * 59 // 2
    got = sorted(map(tuple, linkage.haplotype_blocks(of, 0.7).collect()))
    assert [b[:4] for b in got] == brute_blocks(pairs, 0.7) and max(b[3] for b in got) > 12
    carried = linkage.loci(spectrum_, samples, start=7, end=70, least_maf=0.3)
    assert {r.pos for r in carried.collect()} <= set(range(7, 71)) and all(0.3 <= r.carriers / n <= 0.7 for r in carried.collect())
    with pytest.raises(ValueError):
        linkage.loci(spectrum_, samples.limit(4))
    assert linkage.haplotype_blocks(linkage.loci(spectrum_.limit(0), samples), 0.7).count() == 0


def test_pairs_of_loci_meet_as_strips(spark, monkeypatch):
    """Strips of 2 tiles of 4 loci: no row is joined for a pair, and statistics that are looked up are those that are computed; for one word of samples and for two."""
    monkeypatch.setattr(linkage, "TILE", 4)
    monkeypatch.setattr(linkage, "STRIP", 2)
    monkeypatch.setattr(linkage, "TASK_PAIRS", 200)
    rng = random.Random(9)
    for n in (30, 70):
        held = {(ref, pos * 3): set(rng.sample(range(n), rng.randrange(1, n + 1))) for ref in range(2) for pos in range(41 - 30 * ref)}
        rows = [(s, ref, pos, "SNP") for (ref, pos), group in held.items() for s in group] + [(1, 0, None, "SNP"), (2, None, 5, "SNP")]
        of = linkage.loci(spark.createDataFrame(rows, "sample_id long, reference_id int, ref_pos long, variant_type string"), spark.range(n).withColumnRenamed("id", "sample_id"))
        pairs = linkage.ld_pairs(of)
        got = {(r.reference_id, r.i, r.j): (r.d, r.d_prime, r.r2) for r in pairs.collect()}
        want = {}
        for (ref, i), x in held.items():
            for (other, j), y in held.items():
                if ref == other and i < j:
                    a, b, both = len(x) / n, len(y) / n, len(x & y) / n
                    d, v = both - a * b, a * (1 - a) * b * (1 - b)
                    m = min(a * (1 - b), (1 - a) * b) if d >= 0 else min(a * b, (1 - a) * (1 - b))
                    want[ref, i, j] = (d, abs(d / m) if m else 0.0, d * d / v if v else 0.0)
        assert pairs.count() == len(got) == 41 * 40 // 2 + 11 * 10 // 2
        assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate inline" in plan[: plan.index("Join Inner")]
        monkeypatch.setattr(linkage, "MEMO", 0 if n == 30 else 70)
        assert {(r.reference_id, r.i, r.j): (r.d, r.d_prime, r.r2) for r in linkage.ld_pairs(of).collect()} == got
        monkeypatch.setattr(linkage, "MEMO", 64)
    assert linkage.ld_pairs(of.limit(0)).count() == 0


def test_density_and_quality_control_take_the_length_from_the_table(spark, small):
    pos = [r.ref_pos for r in view(spark, small, "variant").collect()]
    got = sorted(map(tuple, genomics.QUERIES["variant_density_buckets"](spark, small).collect()))
    assert max(pos) == 29_999
    assert got == [(b, b * 100, b * 100 + 99, sum(p // 100 == b for p in pos)) for b in range(300)]
    for r in genomics.QUERIES["qc_run"](spark, small).collect():
        assert ("edge_position" in r.failed_rules) == (min(r.ref_pos, 30_000 - r.ref_pos + 1) <= 50)
    bare = view(spark, small, "variant").where("false")
    assert spectrum.density_buckets(bare, 100).count() == 0


def test_annotations_of_their_reference_beyond_the_first_400(spark, small):
    within = lambda p: p // 50 if p >= 50 and p % 50 < 40 and p // 50 % 5 == p % 5 else None
    got = genomics.QUERIES["annotate_first_match"](spark, small).collect()
    assert all(r.annotation_id == within(r.ref_pos) for r in got)
    positions = {}
    for _, k in carriers(spark, small, "link"):
        positions.setdefault(within(k[1]), set()).add(k[1])
    want = {a: len(p) for a, p in positions.items() if a and len(p) * 100 / 40 >= 2.5}
    assert max(want) > 400
    assert {r.annotation_id: r.positions for r in genomics.QUERIES["hotspots"](spark, small).collect()} == want


def test_quality_control_filters_every_sample(spark, small):
    key = ("sample_id", "reference_id", "ref_pos", "variant_type", "ref_base", "alt_base")
    passed = {tuple(r[k] for k in key) for r in genomics.QUERIES["qc_run"](spark, small).where("qc_status = 'PASS'").collect()}
    got = [tuple(r[k] for k in key) for r in genomics.QUERIES["qc_pass_filter"](spark, small).collect()]
    assert len(got) == len(passed) < len(carriers(spark, small, "link"))
    assert set(got) == passed


def test_matches_and_sequences_are_whole(spark, tmp_path):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(70)] + [(70, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    norm = lambda a: sum(x * x for x in a) ** 0.5
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)), 6) if norm(a) * norm(b) else 0.0
    want = {(i, k + 1, -m[1]) for i, a in vectors for k, m in enumerate(sorted(((cosine(a, b), -j) for j, b in vectors), reverse=True)[:3])}
    assert {(r.id, r.rank, r.ref_id) for r in genomics.QUERIES["signature_match"](spark, str(tmp_path)).collect()} == want
    texts = ["", "A", "GATTACA", "".join(rng.choice("ACGT") for _ in range(24)), "".join(rng.choice("ACGT") for _ in range(90))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    flip = [t.translate(str.maketrans("ACGT", "TGCA"))[::-1] for t in texts]
    assert {r.sequence_id: r.reverse_sha256 for r in genomics.QUERIES["sequence_features"](spark, str(tmp_path)).collect()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in enumerate(flip)}
    tm = genomics.QUERIES["melting_temperature"](spark, str(tmp_path)).collect()
    assert {(r.sequence_id, r.place, r.primer) for r in tm} == {(i, p + 1, t[p : p + 24]) for i, t in enumerate(texts) for p in range(max(1, len(t) - 23))}
    assert all(r.tm is not None for r in tm)


def test_loci_are_shuffled_a_bounded_number_of_times(spark, monkeypatch):
    """A reference with twice the loci sends each of them as often: strips get wider, not more."""
    monkeypatch.setattr(linkage, "TILE", 2)
    monkeypatch.setattr(linkage, "STRIP", 1)
    monkeypatch.setattr(linkage, "STRIPS", 4)
    samples = spark.range(6).withColumnRenamed("id", "sample_id")
    for n in (40, 80):
        rows = [(s, ref, pos, "SNP") for ref in range(2) for pos in range(n >> ref) for s in range(6) if s < 1 + pos % 5]
        of = linkage.loci(spark.createDataFrame(rows, "sample_id long, reference_id int, ref_pos long, variant_type string"), samples)
        assert linkage._met(of, 1).count() <= 3 * (n + n // 2)  # a strip of every tile would send 5 or more
        pairs = {(r.reference_id, r.i, r.j) for r in linkage.ld_pairs(of).collect()}
        assert pairs == {(ref, i, j) for ref in range(2) for i in range(n >> ref) for j in range(i + 1, n >> ref)}


def test_blocks_send_no_loci_through_the_driver(spark):
    """Tables of loci and of blocks are merged, not broadcast, in the steps as in the result."""
    rng = random.Random(10)
    rows = [(s, ref, pos, "SNP") for ref in range(2) for pos in range(50) for s in range(8) if s < 4 + pos // 9 % 2 or rng.random() < 0.1]
    of = linkage.loci(spark.createDataFrame(rows, "sample_id long, reference_id int, ref_pos long, variant_type string"), spark.range(8).withColumnRenamed("id", "sample_id"))
    jobs = spark.sparkContext._jsc.sc().statusStore().jobsList(None)
    seen = max(jobs.apply(k).jobId() for k in range(jobs.size()))
    assert linkage.haplotype_blocks(of, 0.5).count() > 2
    jobs = spark.sparkContext._jsc.sc().statusStore().jobsList(None)
    made = [j.jobTags().mkString(" ") + j.name() for j in (jobs.apply(k) for k in range(jobs.size())) if j.jobId() > seen]
    assert len(made) > 5 and not any("broadcast" in text.lower() for text in made)
