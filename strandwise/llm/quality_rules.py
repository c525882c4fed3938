"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote good (1), bad (0) or abstain (2). Expectation-maximisation over the histogram of vote patterns
(3 ** rules rows at most) estimates the share of good documents and, for each rule and class, how often its vote is right;
a document's posterior probability of being good replaces all-must-pass filtering. Nothing bounds a rule's
power but what the other rules say: one that disagrees with them on most of its votes loses it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, 2
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = (*BASE, "base_failed", "p_good", "kept")
MEASURES = ("__n_lines", "__n_distinct", "__n_upper", "__n_bang", "__n_stops", "__n_other", "__n_bare")
#: Rounds of EM at most, and the change of the share of good documents that ends it.
ROUNDS, SETTLED = 25, 1e-5
#: Where EM starts: the share of good documents, and how often a vote is right on good and on bad documents. A bad vote starts out
#: rare on good documents; a good vote says little, as most defects are seen by a few rules only.
START = {"good": 0.8, GOOD: 0.99, BAD: 0.35}
#: Votes that the start values are worth in each estimate: smoothing for rules that seldom vote.
SMOOTH = 10


def _window_keys(words: Column) -> Column:
    """A 64-bit key for each window of eight words, from three shifted zips (over 2, 4 and 8 words)."""
    n = F.size(words)
    twice = lambda h, by: F.zip_with(h, F.slice(h, by + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    h8 = twice(twice(twice(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    return F.slice(h8, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the base counts and the measures that rules read.

    Words are runs of anything but ASCII white space; null texts have none. A line counts if it has a word.
    Texts that repeat a window have its (key, position) pairs sorted, which brings equal keys together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.drop(*OUT, *MEASURES).withColumn("__words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("__keys", F.when(F.size("__words") >= WINDOW, _window_keys(F.col("__words"))).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: the exact count of covered words is computed for the others only
    some = F.size(F.array_distinct("__keys")) < F.size("__keys")
    pairs = F.sort_array(F.transform("__keys", lambda x, i: F.struct(x.alias("k"), i.cast("bigint").alias("i"))))
    d = d.withColumn("__pairs", F.when(some, pairs))
    q = F.col("__pairs")
    met = F.filter(q, lambda x, i: F.coalesce(((i > 0) & (F.get(q, i - 1)["k"] == x["k"])) | (F.get(q, i + 1)["k"] == x["k"]), F.lit(False)))
    starts = F.sort_array(F.transform(met, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, s: F.struct((a["n"] + (s + WINDOW) - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end")), lambda a: a["n"])
    long = lambda c: c.cast("bigint")
    count = lambda pattern: long(F.regexp_count(text, F.lit(pattern)))
    without = lambda marks: long(F.length(text) - F.length(F.translate(text, marks, "")))
    return d.select(
        *[c for c in docs.columns if c not in (*OUT, *MEASURES)],
        long(F.size("__words")).alias("n_words"),
        long(F.length(F.array_join("__words", ""))).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
        long(F.size("__lines")).alias("__n_lines"),
        long(F.size(F.array_distinct("__words"))).alias("__n_distinct"),
        count(r"\p{Lu}").alias("__n_upper"),
        without("!").alias("__n_bang"),
        without(".!?").alias("__n_stops"),
        count(r"[^\p{L}\p{M}\x20\x09-\x0D]").alias("__n_other"),
        count(r"(^|[\x20\x09-\x0D])[^\p{L}\p{M}\p{Nd}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)").alias("__n_bare"),
    )


def _votes() -> dict[str, Column]:
    """Each rule looks at one trait: bad where it is far off, good where it is as in prose, and between them it abstains."""
    c = F.col
    n, chars, distinct = c("n_words"), c("word_chars"), c("__n_distinct")
    vote = lambda bad, good: F.when(n == 0, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    return {
        "symbols": vote(c("n_symbols") * 10 > n, c("n_symbols") == 0),
        "bare": vote(c("__n_bare") * 5 > n, c("__n_bare") * 50 <= n),
        "letters": vote(c("__n_other") * 5 > chars, c("__n_other") * 10 <= chars),
        "repeats": vote(c("n_repeat_words") * 10 > n * 3, (c("n_repeat_words") == 0) & (n >= WINDOW)),
        "lines": vote((c("n_dup_lines") * 2 > c("__n_lines")) & (c("__n_lines") >= 4), (c("n_dup_lines") == 0) & (c("__n_lines") >= 4)),
        "word_length": vote((chars < n * 3) | (chars > n * 11), (chars >= n * 4) & (chars <= n * 8)),
        "capitals": vote(c("__n_upper") * 3 > chars, c("__n_upper") * 10 <= chars),
        "shouting": vote(c("__n_bang") * 4 > n, c("__n_bang") * 20 <= n),
        "stops": vote((c("__n_stops") * 2 > n) | ((c("__n_stops") == 0) & (n >= 100)), (c("__n_stops") * 50 >= n) & (c("__n_stops") * 4 <= n)),
        # different words grow about as the root of all words: the measure is alike for short and long texts
        "variety": vote((distinct * distinct < n * 9) & (n >= 50), (distinct * distinct >= n * 25) & (n >= 50)),
    }


RULES = ("symbols", "bare", "letters", "repeats", "lines", "word_length", "capitals", "shouting", "stops", "variety")


def with_votes(stats: DataFrame) -> DataFrame:
    """stats with one column __v_<rule> for each rule and base_failed."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return stats.withColumns({f"__v_{k}": v for k, v in _votes().items()} | {"base_failed": failed})


def _log_odds(model: dict) -> Column:
    """Log odds of good against bad given the votes; an abstention says nothing."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for r in RULES:
        v, right = F.col(f"__v_{r}"), {c: model[r, c] for c in (GOOD, BAD)}
        told = {GOOD: math.log(right[GOOD] / (1 - right[BAD])), BAD: math.log((1 - right[GOOD]) / right[BAD])}
        odds = odds + F.when(v == GOOD, told[GOOD]).when(v == BAD, told[BAD]).otherwise(0.0)
    return odds


def start() -> dict:
    return {"good": START["good"]} | {(r, c): START[c] for r in RULES for c in (GOOD, BAD)}


def fit(votes: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over the pattern histogram. model["good"]: the share of good documents; model[rule, c]: how often the
    rule's vote, if it votes, is right on class c. An empty table leaves the start values."""
    cols = [f"__v_{r}" for r in RULES]
    patterns = materialize(votes.groupBy(*cols).agg(F.count("*").alias("__n")).coalesce(1), "patterns")
    model = start()
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_log_odds(model)))
        w = patterns.select(*cols, "__n", (p * F.col("__n")).alias(f"__c{GOOD}"), ((1 - p) * F.col("__n")).alias(f"__c{BAD}"))
        sums = [F.sum("__n").alias("n"), F.sum(f"__c{GOOD}").alias("good")]
        sums += [F.sum(F.when(F.col(f"__v_{r}") == v, F.col(f"__c{c}"))).alias(f"{r}_{v}_{c}") for r in RULES for v in (GOOD, BAD) for c in (GOOD, BAD)]
        s = w.agg(*sums).first()
        if not s["n"]:
            break
        old, model = model, {"good": (s["good"] + SMOOTH * START["good"]) / (s["n"] + SMOOTH)}
        for r in RULES:
            for c in (GOOD, BAD):
                right, wrong = s[f"{r}_{c}_{c}"] or 0, s[f"{r}_{1 - c}_{c}"] or 0
                model[r, c] = (right + SMOOTH * START[c]) / (right + wrong + SMOOTH)
        if abs(model["good"] - old["good"]) < SETTLED:
            break
    return model


def verdicts(votes: DataFrame, model: dict) -> DataFrame:
    """votes with p_good and kept: false if base_failed, else whether good is likelier than bad."""
    p = 1 / (1 + F.exp(-_log_odds(model)))
    out = votes.withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
    return out.drop(*[c for c in out.columns if c.startswith("__v_") or c in MEASURES])


def judge(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed, p_good and kept; one row out for each row in.

    Null and empty texts have zero counts, no votes, and fail. Whole texts count, however long. Repeated rows get equal
    verdicts; posteriors of exactly one half are kept. Input columns named
    like an output column are replaced. An empty table gives an empty table.
    """
    # written once: a filter on kept would otherwise pull the statistics' expressions into itself, where each
    # element of a text's array would compute the whole array again
    votes = with_votes(materialize(with_statistics(docs), "statistics"))
    return verdicts(votes, fit(votes))


def judge_counts(docs: DataFrame) -> DataFrame:
    """judge() of doc_id alone, without text."""
    votes = with_votes(materialize(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics"))
    return verdicts(votes, fit(votes))
