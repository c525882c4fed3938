"""Conversation repair, SimHash and the Merkle manifest against brute force, and their defined results at the edges."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import merkle, repair, simhash
from pyspark.sql import functions as F

from strandwise.llm import conversation_repair, merkle_manifest, queries, ranking, simhash_join

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
LONG = " ".join(f"w{i % 900}" for i in range(90_000))


def test_ranked(spark):
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.7 else rng.choice("bcd"), rng.choice([None, *range(40)]), k) for k in range(900)]
    got = ranking.ranked(spark.createDataFrame(rows, "g string, x long, k long").withColumn("i", F.lit(-1)), "g", ["x", "k"], "test").collect()
    for g in "abcd":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [(r.x, r.k) for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] == [r[1:] for r in mine]
        assert {(r.n) for r in got if r.g == g} == {len(mine)}


def conversations():
    got = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    rng = random.Random(7)
    texts = ["Yes.", "no", "Why? ", "", " \t", None, "On and on", "é!", "Stop\n"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "use"]
    got += [(1000 + c, rng.choice([None, *range(9)]), rng.choice(roles if c % 3 else roles[:3]), rng.choice(texts)) for c in range(150) for _ in range(rng.randint(1, 9))]
    got += [(2000, t, ["user", "assistant", "user", "system"][t * 7 % 4], f"t{t}{'.' if t % 3 else ''}") for t in range(300)]
    return got + [(None, 1, "user", "Hm."), (None, None, None, None), (3000, None, "user", "x."), (3001, 5, "user", LONG)] + [(3002, 1, "user", "Same.")] * 5


@pytest.mark.parametrize("segment", [4096, 5, 1])
def test_conversation_repair(spark, segment):
    rows = conversations() if segment != 1 else [r for r in conversations() if r[0] is None or r[0] >= 1100]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("conv", "i", "n", "fault", "letters", "x")}).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_report(df, segment).collect()}
    want = repair(rows)
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_layers_hold_the_least_costs():
    """Every word against Dijkstra-like relaxation over (row, state)."""
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.choice(["s", "u", "a", "t"]), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 12))]
        want = list(conversation_repair.END)
        words = conversation_repair.layers(rows, want)
        for k in range(len(rows), -1, -1):
            if k < len(rows):
                initial, fault = rows[k]
                nxt, want = want, [10**9] * 4
                for s, n in enumerate(conversation_repair.NEXT):
                    want[s] = nxt[s] + 2
                    for x, to in n.items():
                        if fault in (0, 3):
                            want[s] = min(want[s], nxt[to] + 5 * (fault == 3) + (0 if x == initial else 10**9))
                            want[s] = min(want[s], nxt[to] + 5 * (fault == 3) + (1 if x in "ua" else 10**9))
                for _ in range(3):
                    want = [min(want[s], 5 + want[conversation_repair.GIVEN[s][1]]) for s in range(4)]
            assert [conversation_repair.cost_of(*words[k], s) for s in range(4)] == want
            assert max(want) - min(want) < 16


def test_repair_of_nothing(spark):
    assert conversation_repair.repair_report(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_repair.repaired(spark.createDataFrame([], TURNS)).count() == 0


def documents():
    got = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "source", "lang", "n_chars", "text"]).to_pylist()]
    edges = [None, "", " \n ", "one", "One", "two words", "three words\nhere", "a b c d", "a  B\tc\rd", LONG, LONG + " end", "é " * 40]
    return got + [(-1 - k, None if k % 2 else "src0", None, None, t) for k, t in enumerate(edges)] + [(10_000 + k, "é", "xx", k, f"{k}\n") for k in range(50)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit("x") for c in ("fp", "node", "path", "grp", "i", "n", "h", "cell", "bucket", "leaf")}).repartition(3)


@pytest.mark.parametrize("width", [1, 2])
def test_simhash(spark, width):
    rows = documents()
    words = random.Random(5)
    base = [f"w{words.randrange(500)}" for _ in range(80)]
    for k in range(60):  # near copies of each other, and chains of them
        base[words.randrange(80)] = f"x{k}"
        rows.append((20_000 + k, "src1", "en", 1, " ".join(base)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_join.simhash_components(frame(spark, rows), width).collect()}
    want = simhash([(r[0], r[4]) for r in rows])
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and len(got) == len(rows)
    assert len({c for _, c in want.values()}) < len({p for p, _ in want.values()})  # links between different fingerprints


@pytest.mark.parametrize("side", [4096, 7])
def test_dense_fingerprints(spark, monkeypatch, side):
    """Balls of fingerprints around few centres: large anchors are cut into squares, and no link is lost."""
    monkeypatch.setattr(simhash_join, "SIDE", side)
    monkeypatch.setattr(simhash_join, "PAIRS", 1000)
    rng = np.random.default_rng(8)
    centre = rng.integers(-(2**63), 2**63 - 1, 5)
    flips = [int(x) for x in rng.integers(0, 64, 900)]
    fps = {int(np.int64(np.uint64(int(centre[k % 5]) & (2**64 - 1)) ^ np.uint64(sum({1 << b for b in flips[3 * k : 3 * k + 1 + k % 3]})))) for k in range(300)}
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [tuple(r) for r in simhash_join.near_links(nodes).collect()]

    def groups(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {x: find(x) for x in fps}

    m = 2**64 - 1
    assert groups(links) == groups([(a, b) for a in fps for b in fps if ((a & m) ^ (b & m)).bit_count() <= 4])


def test_golay_words_are_perfect():
    errors, weights, first = simhash_join.error_lists(3)
    assert (np.diff(first) == 1).all() and weights.max() == 3


@pytest.mark.parametrize("levels", [6, 1, 2])
def test_merkle_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "SPAN", 3**levels)
    rows = documents() + [(None, "null id", "x", 1, "a\nb")]
    got = merkle_manifest.merkle_manifest(frame(spark, rows), altered=merkle_manifest.tampered_leaf()).collect()
    want = merkle(rows)
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got} == want and len(got) == len(rows)
    assert 0 < sum(not r.verified for r in got) < len(rows)


def test_merkle_of_few_rows(spark):
    assert merkle_manifest.merkle_manifest(frame(spark, documents()[:0])).count() == 0
    one = merkle_manifest.merkle_manifest(frame(spark, documents()[:1])).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.path == []
    same = merkle_manifest.merkle_manifest(frame(spark, documents()[:1] * 5)).collect()
    assert len(same) == 5 and len({r.root for r in same}) == 1 and all(r.verified for r in same)


def test_nulls_and_repeated_rows_of_simhash(spark):
    rows = [(None, None, None, None, "a b c d e"), (3, None, None, None, "a b c d e"), (3, None, None, None, "a b c d e"), (None, None, None, None, "x y"), (4, None, None, None, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_join.simhash_components(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3), (4, 4)]
    assert simhash_join.simhash_components(frame(spark, rows[:0])).count() == 0


def test_queries_run(spark):
    for name in ("op11_conversation_repair", "op12_simhash_join", "op13_merkle_manifest"):
        assert queries.QUERIES[name](spark, SF).count() > 0
