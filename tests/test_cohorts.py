"""Domains, clusters and the catalogue against plain loops and hand-made cases."""

import math
import random

import pytest

from strandwise.operators import catalogue, clusters, domains

EXONS = "annotation_id long, gene_name string, feature_type string, start_pos long, end_pos long, strand string"
ROWS = [
    (1, "fwd", "exon", 200, 210, None), (2, "fwd", "UTR", 100, 199, "-"), (3, "fwd", "exon", 20, 30, "-"), (4, "fwd", "exon", 205, 260, None),
    (5, "rev", "intron", 0, 9, "-"), (6, "rev", "exon", 10, 29, "+"), (7, "rev", "exon", 50, 70, "-"), (8, "bare", "exon", 5, 9, ""), (9, None, "exon", 0, 99, "+"), (10, "none", "UTR", 0, 99, "+"),
]


def plain_codon(gene, pos):
    mine = [r for r in ROWS if r[1] == gene]
    strand = mine[0][5] or "+"
    exons = sorted((r for r in mine if r[2] == "exon"), key=lambda r: (-r[4] if strand == "-" else r[3], r[0]))
    before = 0
    for r in exons:
        if r[3] <= pos <= r[4]:
            return before + (r[4] - pos if strand == "-" else pos - r[3]) // 3 + 1
        before += (r[4] - r[3] + 1) // 3
    return None


def test_domain_impact_equals_plain_loops(spark):
    rng = random.Random(4)
    kinds = ["catalytic", "binding", "structural", "regulatory", "linker"]
    found = [(k, rng.choice(["fwd", "rev"]), f"d{k}", a := rng.randrange(1, 22), a + rng.randrange(8), kinds[k % 5]) for k in range(12)]
    effects = [*domains.CHANGES, "synonymous_variant", None]
    rows = [(k % 3, k, rng.choice(["fwd", "rev", "bare", "none", "other"]), rng.randrange(270), effects[k % 5], "A" if k % 7 else "", "C") for k in range(1600)]
    v = spark.createDataFrame(rows, "sample_id int, variant_id int, gene_name string, ref_pos long, consequence string, aa_ref string, aa_alt string")
    d = spark.createDataFrame(found, "domain_id int, gene_name string, domain_name string, start_codon long, end_codon long, domain_type string")
    impact = domains.domain_impact(v, domains.coding_exons(spark.createDataFrame(ROWS, EXONS)), d)
    rank = {"catalytic": 3, "binding": 2, "regulatory": 2, "structural": 1, "linker": 0}
    want = {}
    for _, i, gene, pos, effect, x, y in rows:
        codon = plain_codon(gene, pos) if gene in ("fwd", "rev", "bare") else None
        if codon is None:
            continue
        hits = [h for h in found if h[1] == gene and h[3] <= codon <= h[4]]
        changes = effect in domains.CHANGES
        level = max((rank[h[5]] for h in hits), default=0) if changes else 0
        reason = ("不在任何结构域内" if any(h[1] == gene for h in found) else "无结构域信息") if not hits else "命中结构域但非错义/无义突变" if not changes else f"{effect}, 命中结构域: {', '.join(f'{h[2]}({h[5]})' for h in hits)}"
        want[i] = (codon, [h[2] for h in hits], f"{x}{codon}{y}" if changes and x else None, ["未知风险", "低风险", "中风险", "高风险"][level], reason)
    got = {r.variant_id: (r.codon_position, [h.domain_name for h in r.hit_domains], r.amino_acid_change, r.risk_level, r.risk_reason) for r in impact.collect()}
    assert got == want and len({x[3] for x in want.values()}) == 4
    risks = {r.sample_id: r for r in domains.sample_risks(v, impact).collect()}
    for s in range(3):
        mine = [want[r[1]] for r in rows if r[0] == s and r[1] in want]
        assert (risks[s].total_exon_variants, risks[s].mapped_variants, risks[s].variants_with_domain_hit) == (sum(r[0] == s for r in rows), len(mine), sum(bool(x[1]) for x in mine))
        assert risks[s].high_risk_count == sum(x[3] == "高风险" for x in mine)
    for r in domains.domain_summary(impact, ["ref_pos"]).collect():
        mine = [x for x in rows if x[1] in want and r.domain_name in want[x[1]][1]]
        assert (r.total_variants, r.unique_samples) == (len({(x[3], x[4]) for x in mine}), len({x[0] for x in mine}))


def plain_clusters(sets, similarity):
    """Mean linkage by hand; parts whose height is within half of the distance stay whole."""
    names = sorted(sets)
    dist = lambda x, y: 1 - len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    parts = [((n,), 0.0, None) for n in names]
    mean = lambda p, q: sum(dist(x, y) for x in p[0] for y in q[0]) / (len(p[0]) * len(q[0]))
    while len(parts) > 1:
        _, i, j = min((round(mean(parts[i], parts[j]), 12), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)))
        new = (parts[i][0] + parts[j][0], max(mean(parts[i], parts[j]) / 2, parts[i][1], parts[j][1]), (parts[i], parts[j]))
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [new]

    def cut(p):
        return [p[0]] if p[1] <= (1 - similarity) / 2 + 1e-12 or not p[2] else cut(p[2][0]) + cut(p[2][1])

    return sorted(tuple(sorted(c)) for c in cut(parts[0]))


@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.9, 0.0, 1.0])
def test_clusters_equal_plain_linkage(spark, similarity):
    rng = random.Random(15)
    sets = {}
    for ref in (1, 2):
        cores = [set(rng.sample(range(100), 14)) for _ in range(3)]
        sets[ref] = {10 * ref + k: {x for x in cores[k % 3] if rng.random() < 0.85} | set(rng.sample(range(100), k % 4)) for k in range(11)}
    sets[3], sets[4] = {99: {5}}, {7: {1, 2}, 8: {1, 2}}
    rows = [(s, ref, p, "SNP", "A", "C") for ref, per in sets.items() for s, ps in per.items() for p in ps]
    found, shared = clusters.shared_variant_clusters(spark.createDataFrame(rows * 2, "sample_id long, reference_id long, ref_pos long, variant_type string, ref_base string, alt_base string"), similarity)
    got = {(r.reference_id, tuple(r.members)): r for r in found.collect()}
    assert set(got) == {(ref, c) for ref, per in sets.items() for c in plain_clusters(per, similarity)}
    held = {}
    for r in shared.collect():
        held.setdefault((r.reference_id, r.cluster), set()).add(r.ref_pos)
    for (ref, members), r in got.items():
        both = set.intersection(*(sets[ref][m] for m in members)) if ref != 3 else set()
        pairs = [len(sets[ref][a] & sets[ref][b]) / len(sets[ref][a] | sets[ref][b]) for k, a in enumerate(members) for b in members[k + 1 :]]
        assert held.get((ref, members[0]), set()) == both and r.shared_variants == len(both)
        assert r.avg_jaccard == pytest.approx(sum(pairs) / len(pairs) if pairs else 1.0, abs=1e-6) and r.cluster == members[0] and r.member_count == len(members)


def test_catalogue(spark):
    rows = catalogue.reference_signatures(spark).collect()
    by = {}
    for r in rows:
        by.setdefault(r.signature_id, {})[r.mutation_type] = r.p
    assert len(by) == 30 and all(len(v) == 96 and math.isclose(sum(v.values()), 1) for v in by.values())
    assert catalogue.CONTEXTS[0] == "A[C>A]A" and len(set(catalogue.CONTEXTS)) == 96
    first = [random.Random(0).uniform(0.001, 0.01)]
    drawn = random.Random(0)
    raw = [drawn.uniform(0.02, 0.05) if c[1:6] == "[C>T]" and c[6] in "GT" else drawn.uniform(0.001, 0.01) for c in catalogue.CONTEXTS]
    assert first[0] == raw[0] and [by["SBS1"][c] for c in catalogue.CONTEXTS] == pytest.approx([x / sum(raw) for x in raw])
    peaks = sorted(by["SBS11"], key=by["SBS11"].get)[-16:]
    assert {c[1:6] for c in peaks} == {"[C>T]"}


def test_catalogue_matches(spark):
    rng = random.Random(8)
    refs = {name: catalogue.signature(n) for n, name in enumerate(catalogue.PEAKS)}
    profiles = {"x": [rng.random() for _ in range(96)], "SBS4": [5 * v for v in refs["SBS4"]], "zero": [0.0] * 96, "one": [0.0] * 95 + [1.0]}
    df = spark.createDataFrame([(i, c, p) for i, ps in profiles.items() for c, p in zip(catalogue.CONTEXTS, ps, strict=True) if i != "one" or p], "id string, mutation_type string, p double")
    got = {}
    for r in catalogue.matches(df, catalogue.reference_signatures(spark)).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.signature_id, r.similarity, r.reliable))
    for i, p in profiles.items():
        size = math.sqrt(sum(v * v for v in p))
        sim = {n: round(sum(a * b for a, b in zip(p, q, strict=True)) / (size * math.sqrt(sum(v * v for v in q))), 6) if size else 0.0 for n, q in refs.items()}
        want = sorted(sim.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [(n, s) for n, s, _ in got[i]] == [(n, pytest.approx(s, abs=2e-6)) for n, s in want]
        assert all(reliable == (s >= 0.8) for _, s, reliable in got[i])
    assert got["SBS4"][0] == ("SBS4", 1.0, True)
