"""The ten operators and the pipeline against brute force, and their defined results at the edges."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from brute import base_counts, jaccard, kept_by_rules, posteriors, substring, votes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandwise.llm import bloom_dedup, jaccard_join, language_id, piece_matching, poisson_mix, quality_classifier, quality_rules, substring_dedup, token_records, toxicity
from strandwise.llm.store import materialize

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TABLE = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
EDGES = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "one"), (-5, LONG), (-6, LONG), (-7, "the same words here " * 9), (-8, "é " * 30)]


@pytest.fixture(scope="module")
def rows():
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in TABLE[:120]] + [(i, t, None, None) for i, t in EDGES]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {c: F.lit("x") for c in ("kept", "copy", "score", "tie", "node", "piece_ids", "bit", "word", "n_words", "gone")}
    return df.withColumns(extra).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def labels(spark):
    got = pq.read_table("/root/testdata/sf0.001/labels.parquet").to_pylist()
    return spark.createDataFrame([(r["doc_id"], r["quality"], r["toxic"]) for r in got] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def crc(i):
    return zlib.crc32(str(i).encode())


def test_substring_dedup(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs, texts=False).collect()}
    assert got == substring(pairs(rows))


def test_fm_index_statistics():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, rng.integers(20, 33)).tolist() for _ in range(60)]
    seq = np.array([x for t in texts for x in [*t, 0]])
    fm = substring_dedup.FMIndex(seq)
    c, i = np.array([1, 2, 3]), np.array([7, len(seq), 50])
    bwt = seq[fm.suffix - 1]
    assert fm.rank(c, i).tolist() == [int((bwt[:k] == x).sum()) for x, k in zip(c, i, strict=True)]
    end = np.cumsum([len(t) + 1 for t in texts]) - 1
    start = end - [len(t) for t in texts]
    length, lo, hi = fm.statistics(seq, start, end)
    joined = [tuple(seq[a : a + 20]) for a in range(len(seq) - 19)]
    for s, e in zip(start, end, strict=True):
        for a in range(s, e - 19):
            assert length[a] == 20 and hi[a] - lo[a] == joined.count(tuple(seq[a : a + 20]))


def test_language_id(docs, rows):
    got = {r.doc_id: r for r in language_id.predictions(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    assert all(r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    known = [(r[0], r[2]) for r in rows if r[2] and crc(r[0]) % 4 == 2]
    assert sum(got[i].lang_pred == x for i, x in known) >= 0.9 * len(known)


def test_quality_rules(docs, rows):
    got = {r.doc_id: r for r in quality_rules.judge_counts(docs).collect()}
    want = dict(zip([r[0] for r in rows], posteriors([votes(t) for _, t in pairs(rows)]), strict=True))
    for i, t in pairs(rows):
        n = base_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert abs(r.p_good - want[i]) < 1e-6
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def voted(spark, rows):
    """A table of votes, all good but for those named."""
    made = [({r: 1 for r in quality_rules.RULES} | v, n) for v, n in rows]
    flat = [(*v.values(), k) for k, (v, n) in enumerate(made) for _ in range(n)]
    df = spark.createDataFrame(flat, ", ".join(f"__v_{r} int" for r in quality_rules.RULES) + ", kind int").withColumn("base_failed", F.lit(False))
    return df, [v for v, n in made for _ in range(n)]


def test_a_rule_that_disagrees_loses_its_power(spark):
    junk = {r: 0 for r in ("symbols", "letters", "bare", "stops")}
    loud = {r: 0 for r in ("capitals", "shouting", "letters", "stops")}
    single = {"lines": 0, "repeats": 2, "variety": 2, "word_length": 2}
    for often, kept in ((300, True), (3, False)):  # "lines" alone against the others: often, or seldom
        df, votes_ = voted(spark, [({}, 700), (junk, 60), (loud, 60), ({"lines": 0, "repeats": 0, "variety": 0}, 60), (single, often)])
        got = {r.kind: r for r in quality_rules.verdicts(df, quality_rules.fit(df)).dropDuplicates(["kind"]).collect()}
        want = posteriors(votes_)
        assert abs(got[4].p_good - want[-1]) < 1e-6
        assert [got[k].kept for k in range(5)] == [True, False, False, False, kept]


def test_rounds_change_verdicts(spark):
    """What looks bad at the start is good once the rule that says so is seen to be wrong elsewhere."""
    odd = {"stops": 0, "capitals": 2, "shouting": 2, "bare": 2, "symbols": 2, "letters": 2, "repeats": 2}
    df, votes_ = voted(spark, [({}, 500), ({"stops": 0}, 200), (odd, 20), ({"symbols": 0, "letters": 0, "bare": 0}, 40)])
    before, after = (
        {r.kind: r.kept for r in quality_rules.verdicts(df, quality_rules.fit(df, n)).dropDuplicates(["kind"]).collect()} for n in (0, 25)
    )
    assert not before[2] and after[2] and not after[3]


def test_poisson_mix(docs, rows):
    rates = poisson_mix.tempered_rates(docs, 0.5, epochs=20.0)
    mixed = poisson_mix.poisson_mix(docs, rates).collect()
    assert abs(len(mixed) - 20 * len(rows)) < 6 * (20 * len(rows)) ** 0.5
    assert sorted(r.shuffle_key for r in mixed) == sorted(r.shuffle_key for r in poisson_mix.poisson_mix(docs.repartition(2), rates).collect())
    assert poisson_mix.poisson_mix(docs.limit(0), rates).count() == 0


def test_exact_dedup(docs, rows):
    got = {r.doc_id: r for r in bloom_dedup.exact_dedup(docs).collect()}
    groups = {}
    for i, t in pairs(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


def test_levenshtein_automaton():
    terms = ["moron", "scum", "idiots"]
    a = toxicity.Automaton(terms)

    def near(w, t):
        if w == t:
            return 0
        one = {w[:k] + w[k + 1 :] for k in range(len(w))} | {t[:k] + t[k + 1 :] for k in range(0)}
        swap = len(w) == len(t) and sum(x != y for x, y in zip(w, t, strict=True)) == 1
        put = any(t[:k] + t[k + 1 :] == w for k in range(len(t)))
        return 1 if len(t) >= 5 and (t in one or swap or put) else 2

    words = ["moron", "morom", "mooron", "oron", "moro", "scum", "scam", "idiot", "idiotts", "xidiots", "", "mroon", "zzz"]
    code = np.array([ord(c) for w in words for c in w])
    assert a.match(code, np.cumsum([0, *map(len, words)])).tolist() == [min(near(w, t) for t in terms) for w in words]


def test_terms_of_any_length_match():
    long = "x" * 70
    a = toxicity.Automaton([long, "scum", "y" * 100 + "z"])
    words = [long, long[:-1], long + "x", long + "xx", "x" * 64, "y" * 100 + "z", "y" * 99 + "z", "y" * 500, "x" * 30 + "q" + "x" * 39]
    code = np.array([ord(c) for w in words for c in w])
    assert a.match(code, np.cumsum([0, *map(len, words)])).tolist() == [0, 1, 1, 2, 2, 0, 1, 2, 1]


@pytest.mark.parametrize(("module", "label", "mod", "rest"), [(toxicity, "toxic", 5, 0), (quality_classifier, "quality", 3, 1)])
def test_scores(docs, labels, rows, module, label, mod, rest):
    got = {r.doc_id: r for r in module.scores(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(i) % mod == rest) for i, r in got.items())
    held = labels.where(~language_id.held_out(mod, rest))
    assert {r.doc_id: r.score for r in module.scores(docs, held).collect()} == {i: r.score for i, r in got.items()}


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_repeated_rows_teach_once(spark, docs, labels, module, label):
    """Repeated documents and labels change neither the sample nor the scores of the others."""
    one = docs.where("doc_id = 7").select(docs.columns)
    once = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()} if module is toxicity else None
    more = docs.unionByName(one).unionByName(one).unionByName(one)
    got = module.scores(more, labels.unionByName(labels)).collect()
    assert len(got) == more.count()
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    if once:  # word vectors of quality_classifier count all rows, a lexicon only the sample's
        assert {r.doc_id: r.score for r in got} == once


def test_jaccard(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == jaccard(pairs(rows))


def test_jaccard_rounds(spark):
    """Near copies of three texts, a chain of sixty whose ends are far apart, and a line that all have: what rounds after the first must join."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 40_000, n)]
    line = word(12)
    made = []
    for _ in range(3):
        base = word(90)
        for k in range(50):
            copy = list(base)
            for at in rng.integers(0, len(copy), k % 4):
                copy[at] = f"x{k}"
            made.append(copy + line)
    chain = word(60 + 80)
    made += [chain[k : k + 80] + line for k in range(60)]
    made += [word(int(n)) + line for n in rng.integers(3, 120, 90)]
    order = rng.permutation(len(made)).tolist()
    texts = [(k, " ".join(made[at])) for k, at in enumerate(order)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(7)).collect()
    want = jaccard(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({want[order.index(at)][1] for at in range(150, 210)}) == 1


def test_parity_bitmaps_bound_the_difference(spark):
    rng = np.random.default_rng(7)
    made = []
    for n in (1, 5, 16, 17, 60, 64, 65, 300, 5000):
        for share in (0.5, 0.75, 0.9, 1.0):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 62, max(0, n // 3 - n // 10)).astype(np.uint64)])
            sets = [set(a.tolist()), set(b.tolist())]
            tok = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
            words, counts = jaccard_join._parities(tok, np.cumsum([0, len(sets[0]), len(sets[1])]))
            words = words.view(np.int64).tolist()
            if max(counts) <= 2 * min(counts):
                made.append((len(sets[0]) + len(sets[1]), len(sets[0] ^ sets[1]), words[: counts[0]], words[counts[0] :]))
    got = spark.createDataFrame(made, "n long, d long, a array<long>, b array<long>").withColumn("least", jaccard_join.fewest_differences(F.col("a"), F.col("b"))).collect()
    assert all(r.least <= r.d for r in got)
    close = [r for r in got if r.n > 200 and r.d <= r.n / 5]  # about the border; far pairs fill their bitmaps
    assert close and all(r.least >= 0.8 * r.d for r in close)


def test_token_records(spark, docs, rows):
    tok = Tokenizer.from_file(WORDS)
    got = {r.doc_id: tuple(r)[1:] for r in token_records.record_digests(docs, WORDS).collect()}
    at = 0
    for i, t in sorted(pairs(rows)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_damaged_record_is_met():
    data = bytearray(token_records.frame(7, np.arange(5, dtype="<u2")) + b"\n")
    ((at, n),) = token_records.frames(bytes(data))
    assert token_records.parse(bytes(data), at, n)[0] == 7
    data[20] ^= 1
    with pytest.raises(ValueError):
        token_records.parse(bytes(data), at, n)


def test_shuffled_reads(spark, docs):
    path = token_records.new_path(spark, "test")
    token_records.write_records(docs, path, WORDS)
    plain = {(r.part, r.position): (r.doc_id, r.ids) for r in token_records.read_records(spark, path).collect()}
    met = token_records.read_shuffled(spark, path, 9).collect()
    assert {(r.part, r.position): (r.doc_id, r.ids) for r in met} == plain


def test_pieces(docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = [(9000, "a▁b  c"), (9001, "<0x41> <s> \x00 😀ﷺ"), (9002, " lead and  trail  "), (9003, "a" * 500)]
    both = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    coded = piece_matching.encode(both, PIECES)
    got = {r.doc_id: (r.piece_ids, r.decoded) for r in piece_matching.decode(coded, PIECES).collect()}
    for i, t in [*pairs(rows), *odd]:
        assert got[i][0] == sp.encode(t or "")
        assert got[i][1] == (t or "").replace("▁", " ")


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    assert substring_dedup.substring_dedup(none).count() == 0
    assert language_id.predictions(none).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert bloom_dedup.exact_dedup(none).count() == 0
    assert toxicity.scores(none, labels.limit(0)).count() == 0
    assert jaccard_join.near_dedup(none).count() == 0
    assert piece_matching.encode(none, PIECES).count() == 0
    assert quality_classifier.scores(none, labels.limit(0)).count() == 0
    assert token_records.record_digests(none, WORDS).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " more")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.jaccard_components(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()) == [(0, 60), (1, 0), (1, 0), (2, 60)]
    assert sum(r.kept for r in bloom_dedup.exact_dedup(df).collect()) == 2


EXTRA = ("kept", "copy", "score", "tie", "node", "piece_ids", "n_words", "keep_id", "shuffle_key", "token")


def draws(i, rate, seed=17):
    """How often Poisson replication draws doc_id i, for a rate of eight at most."""
    u = int(hashlib.sha256(f"{seed}:{'' if i is None else i}:1".encode()).hexdigest()[:13], 16) / float(1 << 52)
    p = c = math.exp(-rate)
    n = 0
    while round(c, 12) <= u and n < 60:
        n += 1
        p *= rate / n
        c += p
    return n


def test_pipeline(spark, tmp_path):
    """run() on nulls, blanks, very long texts, repeated rows and clashing columns against every stage by plain loops."""
    table = [(r["doc_id"], r["text"], r["source"]) for r in TABLE[:150]]
    odd = [(None, TABLE[3]["text"] + " more words", "src1"), (9001, None, None), (9002, " \n", "src1"), (9003, LONG, "src2"), (9004, TABLE[5]["text"], None)]
    table += [*odd, table[0], table[0], (table[1][0], table[2][1], "src1")]
    df = spark.createDataFrame(table, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in EXTRA})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [row for row, ok in zip(table, kept_by_rules(pairs(table)), strict=True) if ok]
    order = lambda row: (row[0] is None, row[0] or 0)
    first = {}
    for row in sorted(left, key=order):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or ""), row)
    left = list(first.values())
    at = jaccard([(k, row[1]) for k, row in enumerate(left)])
    least = {}
    for k, row in enumerate(left):
        least[at[k][1]] = min([x for x in (row[0], least.get(at[k][1])) if x is not None], default=None)
    left = [row for k, row in enumerate(left) if least[at[k][1]] in (None, row[0])]
    n = Counter(row[2] for row in left)
    mass = sum(x**0.5 for x in n.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(row[0], row[2], sp.encode(row[1])) for row in left for _ in range(draws(row[0], n[row[2]] ** 0.5 / mass * len(left) / n[row[2]]))]
    key = lambda r: (str(r[0]), str(r[1]), list(r[2]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pipeline_stages_keep_columns(spark):
    """Every stage but the last returns the columns of docs as they are; an empty table gives an empty table."""
    some = spark.createDataFrame([(r["doc_id"], r["text"], r["source"], "x", 7) for r in TABLE[:20]], "doc_id long, text string, source string, kept string, n_words int")
    for docs, rows in ((some, True), (some.limit(0), False)):
        docs = materialize(docs, "docs")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, ""), "stage")
            assert docs.columns == some.columns
            assert {(r.kept, r.n_words) for r in docs.collect()} == ({("x", 7)} if rows else set())
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == rows


def test_results_of_a_stage_live_side_by_side(spark):
    """Two results of one stage, of one folder or two, both count; a later stage of another folder leaves them alone."""
    some = materialize(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in TABLE[:20]], "doc_id long, text string, source string"), "docs")
    quality, exact = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[1][1]
    one, two = quality(spark, some, "here"), quality(spark, some.limit(9), "here")
    three = exact(spark, some, "there")
    assert one.count() >= two.count() > 0 and three.count() == 20
    stored = materialize(one, "stored")
    assert exact(spark, stored, "here").count() == stored.count()


def test_rare_postings_are_shuffled_by_parts(spark):
    """Each part of the rare shingles is stored by itself; together they are all that two nodes or more share, frequent ones too."""
    import random

    from strandwise.llm import jaccard_join

    rng = random.Random(8)
    tokens = [(rng.randrange(0, 2**64, 2**30) >> 2 | level << 62) - 2**63 for level in (0, 0, 0, 1, 3) for _ in range(40)]
    rows = [(n, 9, at, t ^ -(2**63)) for n in range(50) for at, t in enumerate(sorted(rng.sample(tokens, 6)))]
    rows += [(99, 9, 0, 17)]  # met once
    posts = spark.createDataFrame(rows, "node long, n int, at int, token long")
    by = {}
    for n, _, _, t in rows:
        by.setdefault(t, []).append(n)
    want = sorted((t, n, k, at, len(by[t]), min(by[t])) for n, k, at, t in rows if len(by[t]) > 1)
    parts = jaccard_join.shared_posts(posts)
    assert len(parts) == jaccard_join.PARTS + 1 and all(p.stored_at for p in parts)
    assert sorted(tuple(r) for p in parts for r in p.select("token", "node", "n", "at", "met", "hub").collect()) == want
    assert all(p.count() for p in parts)
