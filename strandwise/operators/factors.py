"""Signatures extracted from counts by non-negative factors: the best of several starts, and how many factors are stable."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trees import joined_nodes

#: What keeps divisors from zero, the change below which an error stands still, and for how many steps; steps at most.
TINY, STILL, PATIENCE, STEPS = 1e-10, 1e-6, 20, 5000
#: The correlation from which a number of factors is stable, and the loss that ends the search below it.
STABLE, LOSS = 0.8, 0.1
RUNS = "k int, run int, seed bigint"
FACTORED = "k int, run int, error double, steps int, rows array<string>, columns array<bigint>, w array<array<double>>, h array<array<double>>"


def factored(v: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(w, h, error, steps) with w @ h near v, by multiplicative updates from uniform starts; columns of w sum to 1."""
    start = lambda m, n, s: np.array([(r := random.Random(s))] and [[r.random() for _ in range(n)] for _ in range(m)])
    w, h = start(len(v), k, seed), start(k, v.shape[1], seed + 1)
    before, still, steps = np.inf, 0, 0
    while steps < STEPS:
        steps += 1
        h = h * (w.T @ v) / (w.T @ w @ h + TINY)
        w = w * (v @ h.T) / (w @ h @ h.T + TINY)
        error = float(np.linalg.norm(v - w @ h))
        if before > 0:
            still = still + 1 if np.isfinite(before) and abs(before - error) / before < STILL else 0
            if still >= PATIENCE:
                break
        before = error
    total = w.sum(axis=0)
    return w / (total + TINY), h * total[:, None], before, steps


def factor_runs(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """FACTORED for each run (RUNS) over the matrix of counts (mutation_type, sample_id, n), absent cells being 0.

    A run is one task's work: the matrix has 96 rows and a cohort's columns (200 samples). Runs go side by side, and a lost one is repeated from its seed.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        types, r = np.unique(rows["mutation_type"].to_numpy(object), return_inverse=True)
        samples, c = np.unique(rows["sample_id"].to_numpy(np.int64), return_inverse=True)
        v = np.zeros((len(types), len(samples)))
        np.add.at(v, (r, c), rows["n"].to_numpy(float))
        one = rows.iloc[0]
        w, h, error, steps = factored(v, int(one["k"]), int(one["seed"]))
        return pd.DataFrame({"k": [one["k"]], "run": [one["run"]], "error": [error], "steps": [steps], "rows": [list(types)], "columns": [list(samples)], "w": [w.tolist()], "h": [h.tolist()]})

    cells = counts.select("mutation_type", F.col("sample_id").cast("bigint").alias("sample_id"), "n")
    return cells.crossJoin(F.broadcast(runs)).groupBy("k", "run", "seed").applyInPandas(fit, FACTORED)  # runs: some tens of rows


def best_run(done: DataFrame) -> DataFrame:
    """The run with the least error for each k; the first of equals."""
    first = F.min_by(F.struct(*done.columns), F.struct("error", "run")).alias("best")
    return done.groupBy("k").agg(first).select("best.*")


def starts(spark, ks: range, n: int, base: int | None = None) -> DataFrame:
    """RUNS: n for each k. With a base, seeds are that far apart by 1,000, as an extraction takes them; else 10,000 k + run."""
    rows = [(k, r, base + 1000 * r if base is not None else 10_000 * k + r) for k in ks for r in range(n)]
    return spark.createDataFrame(rows, RUNS)


def extract_signatures(counts: DataFrame, k: int, n: int = 10, base: int = 42) -> DataFrame:
    """(signature, mutation_type, p) of the best of n runs; each signature sums to 1."""
    best = extraction(counts, k, n, base)
    cells = best.select(F.posexplode(F.arrays_zip("rows", "w")).alias("i", "c")).select(F.col("c.rows").alias("mutation_type"), F.posexplode("c.w").alias("signature", "p"))
    total = F.sum("p").over(Window.partitionBy("signature"))
    return cells.select("signature", "mutation_type", F.when(total == 0, F.col("p")).otherwise(F.col("p") / total).alias("p"))


def extraction(counts: DataFrame, k: int, n: int = 10, base: int = 42) -> DataFrame:
    """FACTORED of the best of n runs, one row: what extract_signatures takes its signatures from."""
    return best_run(factor_runs(counts, starts(counts.sparkSession, range(k, k + 1), n, base)))


def exposures(best: DataFrame) -> DataFrame:
    """(sample_id, signature, exposure, error, steps) of an extraction: how much of a sample's counts each signature makes up."""
    rows = best.select("columns", F.round("error", 6).alias("error"), "steps", F.posexplode("h").alias("signature", "e"))
    cells = rows.select("signature", "error", "steps", F.explode(F.arrays_zip("columns", "e")).alias("c"))
    return cells.select(F.col("c.columns").alias("sample_id"), "signature", F.col("c.e").alias("exposure"), "error", "steps")


def consensus(done: DataFrame) -> DataFrame:
    """(k, a, b, together): the share of runs in which two samples have their largest exposure in the same factor."""
    h = done.select("k", "run", F.explode(F.arrays_zip(F.col("columns").alias("s"), F.expr("transform(sequence(0, size(columns) - 1), j -> transform(h, x -> x[j]))").alias("e"))).alias("c"))
    top = h.select("k", "run", F.col("c.s").alias("s"), F.array_position(F.col("c.e"), F.array_max("c.e")).alias("factor"))
    n = F.count("*")
    pairs = top.alias("x").join(top.alias("y"), ["k", "run"]).where("x.s < y.s")  # a cohort's pairs, within each run
    return pairs.groupBy("k", F.col("x.s").alias("a"), F.col("y.s").alias("b")).agg((F.count_if(F.col("x.factor") == F.col("y.factor")) / n).alias("together"))


def cophenetic(pairs: DataFrame) -> DataFrame:
    """(k, correlation) of 1 - together with the heights at which mean linkage joins a and b; 0 where either does not vary."""

    def correlate(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([rows["a"], rows["b"]]))
        a, b = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"])
        d = np.zeros((len(ids), len(ids)))
        d[a, b] = d[b, a] = 1 - rows["together"]
        joined, height, members = np.zeros_like(d), dict.fromkeys(range(len(ids)), 0.0), {i: [i] for i in range(len(ids))}
        edges = joined_nodes(d, ids.tolist(), "upgma")[:-1]
        for (x, new, length), (y, _, _) in zip(edges[::2], edges[1::2], strict=True):
            height[new], members[new] = height[x] + length, members[x] + members[y]
            joined[np.ix_(members[x], members[y])] = joined[np.ix_(members[y], members[x])] = 2 * height[new]
        p, q = d[a, b], joined[a, b]
        flat = len(p) < 2 or np.ptp(p) == 0 or np.ptp(q) == 0
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "correlation": [0.0 if flat else float(np.corrcoef(p, q)[0, 1])]})

    return pairs.groupBy("k").applyInPandas(correlate, "k int, correlation double")


def recommended(report: DataFrame) -> DataFrame:
    """report (k, correlation) with recommended: the last k before one that is not stable and has lost LOSS to the k before it."""
    order = Window.partitionBy(F.lit(0)).orderBy("k")  # a row for each k
    fall = (F.col("correlation") < STABLE) & (F.col("correlation") < F.lag("correlation").over(order) - LOSS)
    marked = report.withColumn("__falls", F.sum(F.when(fall, 1).otherwise(0)).over(order))
    last = F.max(F.when(F.col("__falls") == 0, F.col("k"))).over(Window.partitionBy(F.lit(0)))
    return marked.withColumn("recommended", F.col("k") == last).drop("__falls")


def optimal_k(counts: DataFrame, k_min: int = 2, k_max: int = 8, n: int = 10) -> DataFrame:
    """(k, error, correlation, recommended) for each number of factors from k_min to k_max, with n runs each."""
    done = factor_runs(counts, starts(counts.sparkSession, range(k_min, k_max + 1), n))
    done = done.select("k", "run", "error", "columns", "h").cache()  # some tens of small rows, read twice
    errors = done.groupBy("k").agg(F.min("error").alias("error"))
    return recommended(errors.join(cophenetic(consensus(done)), "k"))
