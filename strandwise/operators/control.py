"""Quality control by stored rules: what a rule set fails, by how much, and which results still hold.

rule_sets: (rule_set_id, is_active), rules: (rule_set_id, rule_id, rule_index, rule_type, min_alignment_score, min_coverage_depth, edge_margin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as plain
from .spectrum import KEY

#: Each type of rule and the column of its threshold.
THRESHOLDS = {"alignment_score": "min_alignment_score", "coverage_depth": "min_coverage_depth", "edge_position": "edge_margin"}
#: Rows of lengths that a join may broadcast: 16 bytes each.
SMALL = 1_000_000


def active_rules(rule_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules of the active set with their threshold, in order; of several active sets the one with the least id. Rules of an
    unknown type or without their threshold are passed over."""
    active = rule_sets.where("is_active").agg(F.min("rule_set_id").alias("rule_set_id"))
    threshold = F.coalesce(*[F.when(F.col("rule_type") == t, F.col(c).cast("double")) for t, c in THRESHOLDS.items()])
    of = rules.join(F.broadcast(active), "rule_set_id")  # one row
    return of.select("rule_set_id", "rule_index", "rule_id", "rule_type", threshold.alias("threshold")).where("threshold is not null")


def judged(evidence: DataFrame, rules: DataFrame, lengths: DataFrame) -> DataFrame:
    """evidence with rule_set_id, failed and qc_status: failed lists (rule_index, rule_id, rule_type, threshold, actual_value) in order.

    A score fails below its threshold or where it is null, a depth below its threshold, and an edge up to it: the distance is the position,
    or what is left of the reference's length counted from 1, if that is less; the position alone where lengths (reference_id, length) has no
    such reference. Rules are what active_rules gives, a few rows: they go along as one array, so that nothing shuffles. Without rules
    there are no results.
    """
    fields = ("rule_index", "rule_id", "rule_type", "threshold")
    table = rules.groupBy("rule_set_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__rules"))  # one set, one row
    known = lengths.select("reference_id", F.col("length").alias("__length"))
    rows = evidence.join(F.broadcast(known) if known.count() <= SMALL else known, "reference_id", "left")
    edge = F.coalesce(F.least("ref_pos", F.col("__length") - F.col("ref_pos") + 1), F.col("ref_pos"))
    actual = {"alignment_score": F.col("best_score"), "coverage_depth": F.col("depth"), "edge_position": edge}

    def value(rule: Column) -> Column:
        return F.coalesce(*[F.when(rule["rule_type"] == t, a.cast("double")) for t, a in actual.items()])

    def fails(rule: Column) -> Column:
        v = value(rule)
        low = F.when(rule["rule_type"] == "edge_position", v <= rule["threshold"]).otherwise(v < rule["threshold"])
        return F.coalesce(low, F.lit(True))

    failed = F.transform(F.filter("__rules", fails), lambda r: F.struct(*[r[f].alias(f) for f in fields], value(r).alias("actual_value")))
    out = rows.crossJoin(F.broadcast(table)).withColumn("failed", failed).drop("__rules", "__length")
    return out.withColumn("qc_status", F.when(F.size("failed") == 0, "PASS").otherwise("FAIL"))


def failures(results: DataFrame) -> DataFrame:
    """A row for each rule that a variant fails, with the value met and the threshold."""
    return results.select("sample_id", *KEY, F.explode("failed").alias("f")).select("sample_id", *KEY, "f.rule_id", "f.rule_type", "f.actual_value", "f.threshold")


def marked(results: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """results with is_stale: whether their set is not the active one any more."""
    active = rule_sets.where("is_active").agg(F.min("rule_set_id").alias("__active"))
    return results.crossJoin(F.broadcast(active)).withColumn("is_stale", ~F.expr("rule_set_id <=> __active")).drop("__active")  # one row


def sample_summary(samples: DataFrame, spectrum: DataFrame, marked: DataFrame) -> DataFrame:
    """Each sample's variants, and its results that pass, fail and are stale; one without results has none of them."""
    fresh = ~F.col("is_stale")
    n = spectrum.groupBy("sample_id").agg(F.count("*").alias("total_variants"))
    counts = marked.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.count_if(fresh & (F.col("qc_status") == "PASS")).alias("pass_count"),
        F.count_if(fresh & (F.col("qc_status") == "FAIL")).alias("fail_count"), F.count_if("is_stale").alias("stale_count"))
    out = samples.select("sample_id").distinct().join(n, "sample_id", "left").join(counts, "sample_id", "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total_variants", "pass_count", "fail_count", "stale_count")]
    return out.select("sample_id", F.col("n").isNotNull().alias("has_qc_results"), (F.coalesce("stale_count", F.lit(0)) > 0).alias("is_stale"), *zero)


def visible(spectrum: DataFrame, marked: DataFrame) -> DataFrame:
    """The variants that a reader gets: those that pass, of samples with results that aren't stale; all of the others."""
    return plain.passed_only(spectrum, marked.where("not is_stale"))


def batch_run(requested: DataFrame, spectrum: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each requested sample_id (with known, whether it exists): its counts and share of passes, 4 digits, or an error."""
    n = spectrum.groupBy("sample_id").agg(F.count("*").alias("total_variants"))
    ok = results.groupBy("sample_id").agg(F.count_if(F.col("qc_status") == "PASS").alias("pass_count"), F.count_if(F.col("qc_status") == "FAIL").alias("fail_count"))
    out = requested.select("sample_id", "known").join(n, "sample_id", "left").join(ok, "sample_id", "left").na.fill(0, ["total_variants", "pass_count", "fail_count"])
    rate = F.when(F.col("total_variants") == 0, 0.0).otherwise(F.round(F.col("pass_count") / F.col("total_variants"), 4))
    return out.withColumn("pass_rate", rate).withColumn("error", F.when(~F.col("known"), "sample not found")).drop("known")


def batch_totals(runs: DataFrame) -> DataFrame:
    """One row for a batch_run: samples asked for, done and not found, and the mean share of passes of those done (4 digits)."""
    done = F.col("error").isNull()
    share = F.when(F.col("total_variants") > 0, F.col("pass_count") / F.col("total_variants")).otherwise(0.0)
    mean = F.coalesce(F.round(F.avg(F.when(done, share)), 4), F.lit(0.0))
    return runs.agg(F.count("*").alias("total_samples"), F.count_if(done).alias("processed_samples"), F.count_if(~done).alias("failed_samples"), mean.alias("average_pass_rate"))
