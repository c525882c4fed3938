"""Synteny, conserved cores and primers against plain loops."""

import math
import random

import numpy as np
import pytest
from test_kernels import plain_alignment

from strandwise.operators import intervals, primers, synteny

PAIR = ["pair"]


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def other_strand(text):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(x, "N") for x in reversed(text))


def plain_blocks(a, b, length, ratio, gap_ratio):
    """Anchors by whole alignments, then blocks one anchor after the other."""
    found = []
    for at in range(0, len(a) - length + 1, length):
        anchor = a[at : at + length]
        one, two = plain_alignment(anchor, b), plain_alignment(other_strand(anchor), b)
        best, direction = (two, "-") if two[0] > one[0] else (one, "+")
        if best[0] >= length * ratio and best[0] > 0:
            found.append((at, at + length - 1, best[3], best[4], best[0], direction))
    groups = []
    for x in found:
        last = groups[-1][-1] if groups else None
        onward = last and (x[2] >= last[2] if x[5] == "+" else x[2] <= last[2])
        if last and last[5] == x[5] and onward and abs(x[2] - last[3]) <= length * gap_ratio:
            groups[-1].append(x)
        else:
            groups.append([x])
    out = []
    for k, g in enumerate(groups):
        ends = (g[0][2], g[-1][3]) if g[0][5] == "+" else (g[0][3], g[-1][2])
        out.append((k, g[0][0], g[-1][1], min(ends), max(ends), len(g), g[0][5]))
    return found, out


@pytest.fixture(scope="module")
def strains():
    """Pairs with moved, turned and changed stretches, small gaps, other letters; and pairs with nothing in common."""
    rng = random.Random(6)
    made = []
    for k in range(14):
        a = bases(rng, rng.choice([90, 160, 330]))
        parts = [a[i : i + 60] for i in range(0, len(a), 60)]
        parts = [other_strand(p) if rng.random() < 0.4 else p for p in parts]
        if k % 2:
            rng.shuffle(parts)
        b = list("".join(parts) + bases(rng, 20))
        for _ in range(k):
            i = rng.randrange(len(b))
            b[i] = rng.choice(["A", "C", "", "GT", "N"])
        made.append((k, a, "".join(b)))
    return [*made, (20, bases(rng, 64), bases(rng, 80)), (21, "ACGT", "ACGT"), (22, None, "A"), (23, "A" * 70, ""), (24, "A" * 70, "A" * 40)]


@pytest.mark.parametrize(("length", "ratio"), [(20, 1.5), (16, 1.0), (30, 1.8)])
def test_synteny_blocks_equal_a_plain_chain(spark, strains, length, ratio):
    df = spark.createDataFrame(strains, "pair int, a_bases string, b_bases string")
    anchors = synteny.anchors(df, PAIR, length, ratio)
    placed = synteny.chained(anchors, PAIR, length, 1.0)
    got = sorted(map(tuple, synteny.blocks(placed, PAIR).select("pair", "block", "a_start", "a_end", "b_start", "b_end", "anchor_count", "direction").collect()))
    want = [(k, *x) for k, a, b in strains if a and b for x in plain_blocks(a, b, length, ratio, 1.0)[1]]
    assert got == want
    assert {"+", "-"} <= {x[-1] for x in want} and any(x[-2] > 1 for x in want)
    assert sorted(map(tuple, anchors.collect())) == [(k, *x) for k, a, b in strains if a and b for x in plain_blocks(a, b, length, ratio, 1.0)[0]]


def test_pieces_of_a_long_sequence(spark, monkeypatch, strains):
    df = spark.createDataFrame(strains, "pair int, a_bases string, b_bases string")
    whole = sorted(map(tuple, synteny.anchors(df, PAIR, 20).collect()))
    monkeypatch.setattr(synteny, "PIECE", 2)
    assert sorted(map(tuple, synteny.anchors(df, PAIR, 20).collect())) == whole


BLOCK = "pair int, block int, a_start long, a_end long, b_start long, b_end long, anchor_count long, direction string"


def test_rearrangements_of_each_kind(spark):
    rows = [
        (1, 0, 0, 99, 0, 99, 2, "+"), (1, 1, 150, 249, 300, 399, 2, "-"), (1, 2, 300, 399, 150, 249, 2, "-"), (1, 3, 380, 450, 600, 650, 1, "-"),  # turned, moved, twice
        (2, 0, 0, 99, 500, 599, 2, "+"), (2, 1, 100, 199, 200, 299, 2, "+"), (2, 2, 200, 299, 0, 99, 3, "+"),  # two steps back without a gap: the first counts
        (3, 0, 0, 49, 0, 49, 1, "+"),
    ]
    got = {}
    for r in synteny.rearrangements(spark.createDataFrame(rows, BLOCK), PAIR).collect():
        got.setdefault(r.pair, set()).add(tuple(r)[1:])
    assert got == {
        1: {("inversion", 150, 249, 300, 399, 2), ("inversion", 300, 399, 150, 249, 2), ("inversion", 380, 450, 600, 650, 1), ("inversion", 100, 149, 99, 300, 0),
            ("translocation", 250, 299, 150, 399, 0), ("duplication", 380, 399, 150, 650, 3)},
        2: {("translocation", 0, 199, 200, 599, 0)},
    }
    assert sorted(map(tuple, synteny.back_steps(spark.createDataFrame(rows, BLOCK), PAIR).collect())) == [(1, 1), (2, 0), (2, 1)]


def plain_core(sets, n, length):
    """Runs of places that all sets' blocks cover, place by place, with where they are and the mean of what anchors hold."""
    at = {}
    for other, (found, made) in sets.items():
        for _, a0, a1, b0, b1, count, direction in made:
            for p in range(a0, a1 + 1):
                part = (p - a0) / max(1, a1 - a0) * (b1 - b0)
                to = max(b0, min(b1, int(b0 + part if direction == "+" else b1 - part)))
                scores = [int(x[4] * ((min(x[1], p + length - 1) - max(x[0], p) + 1) / (x[1] - x[0] + 1))) for x in found if a0 <= x[0] <= a1 and x[1] >= p and x[0] <= p + length - 1]
                at.setdefault(p, {})[other] = (to, scores)
    runs = []
    for p in sorted(p for p, x in at.items() if len(x) == n):
        if runs and runs[-1][-1] == p - 1:
            runs[-1].append(p)
        else:
            runs.append([p])
    out = []
    for k, run in enumerate(runs):
        scores = [s for p in run for x in at[p].values() for s in x[1]]
        spans = {o: (min(at[p][o][0] for p in run), max(at[p][o][0] for p in run)) for o in sets}
        out.append((k, run[0], run[-1], sum(scores) / len(scores), spans))
    return out


def test_conserved_core_equals_a_loop_over_places(spark):
    rng = random.Random(9)
    length, rows, want = 20, [], {}
    for k in range(6):
        a = bases(rng, 400)
        others = {}
        for o in ("x", "y", "z")[: 2 + (k > 1)]:
            cut = rng.randrange(100, 300)
            b = (a[cut:] + bases(rng, 15) + other_strand(a[:cut])) if o != "z" else a[:150] + bases(rng, 60) + a[220:]
            others[o] = b
            rows.append((k, o, a, b))
        want[k] = plain_core({o: plain_blocks(a, b, length, 1.5, 3.0) for o, b in others.items()}, 3, length)
    df = spark.createDataFrame(rows, "pair int, other string, a_bases string, b_bases string")
    placed = synteny.chained(synteny.anchors(df, ["pair", "other"], length), ["pair", "other"], length)
    cores, spans = synteny.conserved_core(placed, PAIR, "other", 3, length)
    got = {(r.pair, r.region): (r.start, r.end, r.avg_anchor_score) for r in cores.collect()}
    assert got == {(k, x[0]): (x[1], x[2], pytest.approx(x[3], abs=0.0051)) for k, v in want.items() for x in v} and len(got) > 4
    assert {(r.pair, r.region, r.other): (r.start, r.end) for r in spans.collect()} == {(k, x[0], o): s for k, v in want.items() for x in v for o, s in x[4].items()}


def test_overlaps_and_islands(spark):
    rng = random.Random(3)
    left, right = ([(rng.randrange(2), k, a := rng.randrange(-20, 200), a + rng.randrange(-2, 40)) for k in range(80)] for _ in range(2))
    x, y = spark.createDataFrame(left, "g int, i int, a long, b long"), spark.createDataFrame(right, "g int, j int, c long, d long")
    got = sorted((r.i, r.j) for r in intervals.overlapping(x, y, ["g"], ("a", "b"), ("c", "d"), 16).collect())
    assert got == sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3])
    rows = [(k % 3, "uv"[k % 2], a := rng.randrange(150), a + rng.randrange(12)) for k in range(60)]
    got = sorted(map(tuple, intervals.covered_by_all(spark.createDataFrame(rows, "g int, o string, a long, b long"), ["g"], "o", 2, "a", "b").collect()))
    want = []
    for g in range(3):
        places = [p for p in range(200) if all(any(r[0] == g and r[1] == o and r[2] <= p <= r[3] for r in rows) for o in "uv")]
        for p in places:
            if want and want[-1][0] == g and want[-1][2] == p - 1:
                want[-1] = (g, want[-1][1], p)
            else:
                want.append((g, p, p))
    assert got == want


H = {"AA": -7.9, "TT": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "TG": -8.5, "GT": -8.4, "AC": -8.4, "CT": -7.8, "AG": -7.8, "GA": -8.2, "TC": -8.2, "CG": -10.6, "GC": -9.8, "GG": -8.0, "CC": -8.0}
S = {"AA": -22.2, "TT": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "TG": -22.7, "GT": -22.4, "AC": -22.4, "CT": -21.0, "AG": -21.0, "GA": -22.2, "TC": -22.2, "CG": -27.2, "GC": -24.4, "GG": -19.9, "CC": -19.9}


def plain_tm(p):
    h = sum(1000 * (0.1 if x in "GC" else 2.3) for x in (p[0], p[-1])) + sum(1000 * H[p[i : i + 2]] for i in range(len(p) - 1))
    s = sum(-2.8 if x in "GC" else 4.1 for x in (p[0], p[-1])) + sum(S[p[i : i + 2]] for i in range(len(p) - 1))
    return round(h / (s + 1.987 * math.log(250e-9 / 4)) - 273.15, 2)


def test_primers_equal_direct_computation(spark):
    rng = random.Random(12)
    refs = [(k, bases(rng, n)) for k, n in enumerate([900, 500, 260, 120, 60])] + [(9, "N" * 300 + bases(rng, 200) + "N" * 100), (10, None)]
    targets = [(1, 0, 400, 500), (2, 0, 10, 880), (3, 1, 250, 251), (4, 2, 100, 150), (5, 3, 50, 70), (6, 4, 20, 30), (7, 9, 400, 450), (8, 0, 5, 5), (9, 0, 5, 900), (10, 10, 1, 2), (11, 0, -1, 5)]
    found = primers.candidates(spark.createDataFrame(targets, "target_id int, reference_id int, target_start long, target_end long"), spark.createDataFrame(refs, "reference_id int, bases string"))
    got, text = {}, dict(refs)
    for r in found.collect():
        got.setdefault((r.target_id, r.side), []).append((r["rank"], r.sequence, r.length, r.gc, r.tm, r.bind_start, r.bind_end))
    want = {}
    for t, ref, a, z in targets:
        bases_ = text[ref]
        if not bases_ or a < 0 or a >= z or z >= len(bases_):
            continue
        for side, at, region in (("forward", max(0, a - 200), bases_[max(0, a - 200) : a]), ("reverse", z + 1, bases_[z + 1 : z + 201])):
            made = []
            for n in range(18, 26):
                for i in range(len(region) - n + 1):
                    p = region[i : i + n]
                    if "N" in p:
                        continue
                    gc, tm = round(sum(x in "GC" for x in p) / n * 100, 2), plain_tm(p)
                    if 40 <= gc <= 60 and 55 <= tm <= 65:
                        made.append((round(abs(tm - 60), 2), n, i, other_strand(p) if side == "reverse" else p, gc, tm, at + i, at + i + n - 1))
            made.sort(key=lambda x: x[:3])
            if made:
                want[t, side] = [(k, x[3], x[1], *x[4:]) for k, x in enumerate(made[:30])]
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 6
    pairs = {}
    for r in primers.ranked_pairs(found).collect():
        pairs.setdefault(r.target_id, []).append((r["rank"], r.forward["rank"], r.reverse["rank"], r.amplicon_length))
    for t, mine in pairs.items():
        f, v = want[t, "forward"], want[t, "reverse"]
        points = lambda tm: round(tm * 100)
        away = lambda x, y: (abs(points(x[4]) - 6000) + abs(points(y[4]) - 6000) + 1) // 2
        best = sorted((away(x, y), abs(points(x[4]) - points(y[4])), x[0], y[0], y[6] - x[5] + 1) for x in f for y in v)[:10]
        assert sorted(mine) == [(k + 1, x[2], x[3], x[4]) for k, x in enumerate(best)]
    assert set(pairs) == {t for t, _ in want if (t, "forward") in want and (t, "reverse") in want}


def plain_sites(primer, text):
    """Alignments of the whole text, best first, each place masked after use, while one still has few errors; all other stretches are tried too."""
    out, todo = [], [(0, text)]
    while todo:
        at, part = todo.pop()
        score, _, _, a, z, x, y = plain_alignment(primer, part)
        errors = sum(p != q for p, q in zip(x, y, strict=True))
        if not score:
            continue
        if len(x) >= len(primer) - 2 and errors <= 2:
            out.append((at + a, at + z))
            part = part[: max(0, a - 2)] + "N" * (min(len(part), z + 3) - max(0, a - 2)) + part[z + 3 :]
            todo.append((at, part))
    return sorted(out)


def test_binding_sites_equal_a_scan(spark):
    rng = random.Random(21)
    refs, wanted, want = [], [], {}
    for k in range(5):
        primer = bases(rng, 18 + k)
        changed = list(primer)
        changed[7] = "A" if changed[7] != "A" else "C"
        copies = [primer, "".join(changed), primer[:9] + primer[10:], primer[:5] + "G" + primer[5:], primer[2:], primer[:-1], other_strand(primer)]
        rng.shuffle(copies)
        text = bases(rng, 40).join(["", *copies, ""])
        refs.append((k, text))
        wanted += [(k, primer), (k, primer)]
        want[k, primer] = plain_sites(primer, text)
    got = {}
    for r in primers.binding_sites(spark.createDataFrame(wanted, "reference_id int, sequence string"), spark.createDataFrame(refs, "reference_id int, bases string")).collect():
        got.setdefault((r.reference_id, r.sequence), []).append((r.ref_start, r.ref_end))
        assert r.mismatches + r.gaps <= 2
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(len(v) >= 5 for v in want.values())


def test_nonspecific_pairs_and_spread(spark):
    targets = spark.createDataFrame([(1, 7, 5000, 5100)], "target_id int, reference_id int, target_start long, target_end long")
    pairs = spark.createDataFrame([(1, 7, 1, "F", "R", 60.0, 59.0), (1, 7, 2, "F", "Q", 60.0, 61.0)], "target_id int, reference_id int, rank int, f string, r string, ft double, rt double")
    pairs = pairs.selectExpr("target_id", "reference_id", "rank", "named_struct('sequence', f, 'tm', ft) as forward", "named_struct('sequence', r, 'tm', rt) as reverse")
    rng = random.Random(2)
    rows = [(7, s, a := rng.randrange(12_000), a + 20) for s in "FRQ" for _ in range(25)] + [(7, "F", 5010, 5030), (7, "R", 5050, 5070)]
    got = sorted(map(tuple, primers.nonspecific(pairs, targets, spark.createDataFrame(rows, "reference_id int, sequence string, ref_start long, ref_end long")).collect()))
    off = [r for r in rows if not (r[2] >= 5000 and r[3] <= 5100)]
    want = [(1, 7, k, f[2], r[3]) for k, s in ((1, "R"), (2, "Q")) for f in off if f[1] == "F" for r in off if r[1] == s and f[2] < r[3] and r[3] - f[2] + 1 < 3000]
    assert got == sorted(want) and len(want) > 20
    more = pairs.withColumn("target_id", pairs["rank"]).withColumn("rank", pairs["rank"] * 0 + 1)
    assert tuple(primers.tm_consistency(more, ["reference_id"]).first()) == (7, 2, 0.0, 1.0, round(math.sqrt(0.5), 4))


def test_temperatures_of_windows(spark):
    from strandwise.operators import signatures

    rng = random.Random(17)
    rows = [(k, bases(rng, n)) for k, n in enumerate([0, 1, 2, 9, 24, 25, 80])] + [(20, "ACGTN" * 6), (21, None)]
    df = spark.createDataFrame(rows, "sequence_id int, bases string")
    got = {(r.sequence_id, r.place): (r.primer, r.tm) for r in primers.window_temperatures(df, 24, 7).collect()}
    want = {}
    for k, text in rows:
        for i in range(max(1, len(text) - 23) if text is not None else 0):
            p = text[i : i + 24]
            want[k, i + 1] = (p, 0.0 if len(p) < 2 else None if "N" in p else plain_tm(p))
    assert got == want
    known = spark.createDataFrame([(p,) for k, (p, tm) in want.items() if tm is not None], "p string")
    assert all(r.tm == pytest.approx(plain_tm(r.p) if len(r.p) > 1 else 0.0, abs=0.011) for r in known.select("p", signatures.melting_temperature(known["p"]).alias("tm")).collect())


def test_best_matches_in_blocks(spark):
    from strandwise.operators import signatures

    rng = random.Random(5)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = sorted(map(tuple, signatures.best_matches(df, df.withColumnsRenamed({"id": "ref_id", "vector": "ref_vector"}), 3, 16).collect()))
    size = lambda v: math.sqrt(sum(x * x for x in v))
    want = []
    for i, v in rows:
        sim = [(-round(sum(x * y for x, y in zip(v, u, strict=True)) / (size(v) * size(u)), 6) if size(v) * size(u) else 0.0, j) for j, u in rows]
        want += [(i, r + 1, j, pytest.approx(-s, abs=1e-9)) for r, (s, j) in enumerate(sorted(sim)[:3])]
    assert got == want


def test_best_pairs_equal_ranked_candidates(spark):
    """Pairs that are made beside their flanks are those of a table of candidates, and no candidates or pairs are shuffled for them."""
    rng = random.Random(8)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((600, 300, 90, 500))] + [(4, "ACGTN" * 80), (5, "A" * 400)]
    references = spark.createDataFrame(refs, "reference_id bigint, bases string")
    targets = spark.createDataFrame([(10 * i + k, i, s, s + 50) for i, b in refs for k, s in enumerate((0, 5, 30, len(b) // 2)) if s + 50 < len(b)],
                                    "target_id bigint, reference_id bigint, target_start bigint, target_end bigint")
    want, got = (sorted(df.collect(), key=lambda r: (r.target_id, r["rank"])) for df in (primers.ranked_pairs(primers.candidates(targets, references)), primers.best_pairs(targets, references)))
    assert got == want and len({r.target_id for r in got}) > 4
    plan = primers.best_pairs(targets, references)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_lists_of_primers_are_dealt_over_all_tasks(spark):
    """The lists go by a hash of their own, which no partitioning of the join can stand in for; a reference may have several lists."""
    rng = random.Random(9)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(400))) for i in range(40)]
    wanted = [(i, b[k : k + 20]) for i, b in refs for k in range(0, 300, 30 if i else 3)]
    references = spark.createDataFrame(refs, "reference_id int, bases string")
    sites = primers.binding_sites(spark.createDataFrame(wanted, "reference_id int, sequence string"), references)
    found = {(r.reference_id, r.sequence) for r in sites.where("mismatches = 0 and gaps = 0").collect()}
    assert found == set(wanted)
    plan = sites._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [__task" in plan


def test_anchors_placed_together_equal_those_alone(spark):
    """Ends of many alignments at a time are those of one; pairs that are placed together are those placed each by itself."""
    rng = random.Random(12)
    letters_ = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs, jobs = [], []
    for _ in range(12):
        a = letters_(320)
        b = "".join(x if rng.random() < 0.9 else rng.choice(["", "A", "GT"]) for x in a)
        b = synteny.reverse_complement(b) if rng.random() < 0.4 else b
        pairs.append(([a[i : i + 32] for i in range(0, 320, 32)], b[: rng.randint(150, len(b))]))
        jobs += [(q, pairs[-1][1][:k]) for k, q in zip((5, 60, 120), pairs[-1][0], strict=False)]
    jobs = [(q, t) for q, t in jobs if synteny.local_alignment(q, t)[0]]
    assert synteny.aligned_ends(jobs) == [synteny.local_alignment(q, t)[2:5] for q, t in jobs]
    together = synteny.place_many(pairs, 1.2)
    assert together == [synteny.place_anchors(*p, 1.2) for p in pairs] and sum(x is not None for of in together for x in of) > 40


def test_best_matches_ship_no_pairs(spark):
    """Vectors and references meet without a join of blocks with blocks, and ties go by ref_id across batches, zero vectors included."""
    from strandwise.operators import signatures

    rng = random.Random(9)
    rows = [(k, [float(rng.randrange(-1, 2)) for _ in range(3)]) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = signatures.best_matches(df, df.withColumnsRenamed({"id": "ref_id", "vector": "ref_vector"}), 3, 100)
        got = {(r.id, r["rank"]): (r.ref_id, r.similarity) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = np.array([v for _, v in rows])
    size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
    cosine = np.round(np.divide(x @ x.T, size, out=np.zeros_like(size), where=size != 0), 6)
    first = np.argsort(-cosine, axis=1, kind="stable")[:, :3]
    assert got == {(i, n + 1): (j, pytest.approx(cosine[i, j], abs=1e-9)) for i in range(700) for n, j in enumerate(first[i].tolist())}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_windows_that_cannot_win_are_not_scored(monkeypatch):
    """Of an anchor's windows on both strands, those that could at most reach less than the best one are left out; anchors are placed as by whole alignments."""
    rng = random.Random(31)
    text = bases(rng, 3000)
    changed = [text[i : i + 15] + ("A" if text[i + 15] != "A" else "C") + text[i + 16 : i + 32] for i in range(40, 2900, 200)]
    wanted = [other_strand(x) if k % 3 == 0 else x for k, x in enumerate(changed)] + [bases(rng, 32)]
    jobs, score = [], synteny.best_scores
    monkeypatch.setattr(synteny, "best_scores", lambda some: jobs.extend(some) or score(some))
    placed = synteny.place_anchors(wanted, text, 1.5)
    index = synteny.SeedIndex(text)
    shared, gaps = synteny.anchor_bounds(32, 1.5)
    windows = sum(len(index.windows(q, shared, gaps)) for x in wanted[:-1] for q in (x, other_strand(x)))
    mine = {q for x in wanted[:-1] for q in (x, other_strand(x))}
    assert sum(q in mine for q, _ in jobs) <= 2 * len(wanted) < windows
    for x, hit in zip(wanted, placed, strict=True):
        one, two = plain_alignment(x, text), plain_alignment(other_strand(x), text)
        best, direction = (two, "-") if two[0] > one[0] else (one, "+")
        assert hit == ((best[3], best[4], best[0], direction) if best[0] >= 48 else None)
    pairs = [(bases(rng, 32), bases(rng, n)) for n in (1, 5, 33, 90, 200)]
    assert score(pairs).tolist() == [plain_alignment(*p)[0] for p in pairs]


def test_windows_without_a_site_are_dropped(spark):
    """Windows that share words by chance are told by their score, for many primers at a time; none that has a site is dropped."""
    rng = random.Random(32)
    text = bases(rng, 12_000)
    wanted = [bases(rng, 18 + k % 8) for k in range(40)] + [text[k * 300 : k * 300 + 9] + text[k * 300 + 10 : k * 300 + 22] for k in range(20)]
    wanted += [text[k * 301 : k * 301 + 7] + "N" + text[k * 301 + 8 : k * 301 + 20] for k in range(10)]
    index = synteny.SeedIndex(text)
    windows = index.windows_of(wanted, [primers.shared_words(p) for p in wanted], primers.ERRORS)
    assert windows == [index.windows_of([p], [primers.shared_words(p)], primers.ERRORS)[0] for p in wanted]
    kept = primers.scored_windows([(p, index, w) for p, w in zip(wanted, windows, strict=True)])
    sites = [primers.sites_of(p, index, w) for p, w in zip(wanted, kept, strict=True)]
    assert sites == [primers.sites_of(p, index) for p in wanted] and sum(map(len, sites)) >= 30
    assert sum(map(len, windows)) - sum(map(len, kept)) >= 20  # by chance
    got = primers.binding_sites(spark.createDataFrame([(1, p) for p in wanted], "reference_id int, sequence string"), spark.createDataFrame([(1, text)], "reference_id int, bases string"))
    assert {(r.sequence, r.ref_start, r.ref_end, r.mismatches, r.gaps, r.score) for r in got.collect()} == {(p, *s) for p, of in zip(wanted, sites, strict=True) for s in of}
