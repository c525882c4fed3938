"""Quality control and pathogenicity scoring: rules are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from .spectrum import KEY, carried, shown_to, tasks

#: The classes, from scores of 6, 3, -2 and above -6 on, and below.
CLASSES = ("pathogenic", "likely_pathogenic", "uncertain_significance", "likely_benign", "benign")

#: The rules of scoring that hold where none are given, as (name, field, op, value, weight).
DEFAULT_RULES = [
    ("nonsense_mutation", "consequence", "eq", "stop_gained", 8.0),
    ("missense_mutation", "consequence", "eq", "missense_variant", 4.0),
    ("synonymous_mutation", "consequence", "eq", "synonymous_variant", -3.0),
    ("intron_variant", "feature_type", "eq", "intron", -2.0),
    ("intergenic_variant", "feature_type", "eq", "intergenic", -4.0),
    ("high_population_frequency", "population_frequency", "gt", "0.05", -6.0),
]
RULE = "name string, field string, op string, value string, weight double"
#: Fields that a rule can name.
FIELDS = ("impact", "feature_type", "variant_type", "consequence", "population_frequency")


def with_evidence(links: DataFrame, variants: DataFrame, alignments: DataFrame, dealt: tuple[int, int] | None = None, counted: bool = True) -> DataFrame:
    """Each sample's five-tuples with n_alignments, and the depth and best_score of those alignments that have a row, in one pass; depth 0: none has.

    Dealt by sample, so that what is asked of a sample's rows next needs no other shuffle. dealt: tasks(), if they are known. Where it is only asked
    whether there is any depth, it is not counted: it is 1 then, n_alignments is left out, and what an alignment shows twice needs no grouping of its own.
    """
    by_alignment, by_sample = dealt or tasks(links, variants)
    scores = alignments.groupBy("alignment_id").agg(F.max("score").alias("score"), F.lit(1).alias("known"))
    shown = (carried if counted else shown_to)(links, variants, by_alignment)
    joined = shown.join(scores, "alignment_id", "left").repartition(by_sample, "sample_id")
    depth = [F.count("*").alias("n_alignments"), F.count("known").alias("depth")] if counted else [F.coalesce(F.max("known"), F.lit(0)).alias("depth")]
    return joined.groupBy("sample_id", *KEY).agg(*depth, F.max("score").alias("best_score"))


def evidence(links: DataFrame, variants: DataFrame, alignments: DataFrame) -> DataFrame:
    """Coverage depth and best score of each sample's five-tuples, in one pass."""
    by_alignment, by_sample = tasks(links, variants)
    scores = alignments.groupBy("alignment_id").agg(F.max("score").alias("score"))
    joined = carried(links, variants, by_alignment).join(scores, "alignment_id").repartition(by_sample, "sample_id", *KEY)
    return joined.groupBy("sample_id", *KEY).agg(F.count("*").alias("depth"), F.max("score").alias("best_score"))


def qc(evidence: DataFrame, min_score: float, min_depth: int, margin: int, length: DataFrame) -> DataFrame:
    """The rules that each variant fails, and its status; length is one row with that column. The distance to the start is
    the position itself, the distance to the end is counted from 1."""
    edge = F.least(F.col("ref_pos"), F.col("length") - F.col("ref_pos") + 1)
    bad = {
        "alignment_score": F.coalesce(F.col("best_score") < min_score, F.lit(True)),
        "coverage_depth": F.col("depth") < min_depth,
        "edge_position": edge <= margin,
    }
    failed = F.concat_ws(",", *[F.when(c, F.lit(r)) for r, c in bad.items()])
    out = evidence.crossJoin(F.broadcast(length)).withColumn("failed_rules", failed).drop("length")
    return out.withColumn("qc_status", F.when(F.col("failed_rules") == "", "PASS").otherwise("FAIL"))


def qc_summary(results: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("qc_status") == "PASS")
    return results.groupBy("sample_id").agg(passed.alias("passed"), (F.count("*") - passed).alias("failed"), F.round(passed / F.count("*"), 6).alias("pass_rate"))


def qc_rule_failures(results: DataFrame) -> DataFrame:
    rule = results.where("failed_rules <> ''").select(F.explode(F.split("failed_rules", ",")).alias("rule_type"))
    return rule.groupBy("rule_type").agg(F.count("*").alias("failures"))


def qc_buckets(results: DataFrame, length: DataFrame, width: int = 500) -> DataFrame:
    """Passes and fails by bucket, labelled from 1, with the density of fails; length is one row with that column.

    Position 0 stands before the first bucket and is counted in the last one, as are positions beyond it."""
    last = F.expr(f"(length + {width} - 1) div {width} - 1")
    b = F.when(F.col("ref_pos") == 0, last).otherwise(F.least(F.expr(f"(ref_pos - 1) div {width}"), last)).alias("bucket")
    fail = F.count_if(F.col("qc_status") == "FAIL")
    placed = results.crossJoin(F.broadcast(length))
    return placed.groupBy(b).agg(F.count_if(F.col("qc_status") == "PASS").alias("passed"), fail.alias("failed"), (fail / F.lit(width)).alias("fail_density"))


def report_totals(results: DataFrame) -> DataFrame:
    """Samples, variants, passes, fails and the share of passes (4 digits) of each reference's results."""
    per = results.groupBy("reference_id", "sample_id").agg(F.count("*").alias("n"), F.count_if(F.col("qc_status") == "PASS").alias("ok"))
    all_, ok = F.sum("n"), F.sum("ok")
    sums = per.groupBy("reference_id").agg(F.count("*").alias("total_samples"), all_.alias("total_variants"), ok.alias("total_pass"), (all_ - ok).alias("total_fail"))
    return sums.withColumn("overall_pass_rate", F.round(F.col("total_pass") / F.col("total_variants"), 4))


def hot_buckets(results: DataFrame, lengths: DataFrame, width: int = 500, top: int = 10) -> DataFrame:
    """The top buckets of each reference by fails, ties by place: (reference_id, rank, bucket_start, bucket_end, fail_count, fail_density).

    Positions are dealt as in qc_buckets; lengths is (reference_id, length). Buckets without a fail have no rank.
    """
    placed = results.where("qc_status = 'FAIL'").join(lengths, "reference_id").withColumn("last", F.expr(f"(length + {width} - 1) div {width} - 1"))
    b = F.when(F.col("ref_pos") == 0, F.col("last")).otherwise(F.least(F.expr(f"(ref_pos - 1) div {width}"), F.col("last")))
    counts = placed.groupBy("reference_id", "length", b.alias("bucket")).agg(F.count("*").alias("fail_count"))
    order = Window.partitionBy("reference_id").orderBy(F.desc("fail_count"), "bucket")  # a row for each bucket of a reference
    first = counts.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    start, end = F.col("bucket") * width + 1, F.least((F.col("bucket") + 1) * width, F.col("length"))
    return first.select("reference_id", "rank", start.alias("bucket_start"), end.alias("bucket_end"), "fail_count", F.round(F.col("fail_count") / width, 6).alias("fail_density"))


def rule_shares(results: DataFrame) -> DataFrame:
    """How often each rule fails on each reference, and its percentage of that reference's failures (2 digits)."""
    rule = results.where("failed_rules <> ''").select("reference_id", F.explode(F.array_distinct(F.split("failed_rules", ","))).alias("rule_type"))
    counts = rule.groupBy("reference_id", "rule_type").agg(F.count("*").alias("fail_count"))
    share = F.col("fail_count") / F.sum("fail_count").over(Window.partitionBy("reference_id")) * 100  # a row for each rule
    return counts.withColumn("fail_percentage", F.round(share, 2))


def passed_only(spectrum: DataFrame, results: DataFrame) -> DataFrame:
    """Variants that passed; a sample without results keeps all of its own."""
    ran = results.select("sample_id").distinct().withColumn("ran", F.lit(True))
    ok = results.where("qc_status = 'PASS'").select("sample_id", *KEY).withColumn("ok", F.lit(True))
    return spectrum.join(ran, "sample_id", "left").join(ok, ["sample_id", *KEY], "left").where("ran is null or ok").drop("ran", "ok")


def marked(judged: DataFrame) -> DataFrame:
    """A spectrum that has its own results beside it (qc of with_evidence) with passed, whether passed_only keeps a row; depth 0: no result."""
    ran = F.max(F.col("depth") > 0).over(Window.partitionBy("sample_id"))
    return judged.withColumn("ran", ran).withColumn("passed", F.expr("not ran or (depth > 0 and qc_status = 'PASS')")).drop("ran")


def passed_of(judged: DataFrame) -> DataFrame:
    """passed_only of a spectrum that has its own results beside it, without meeting itself again."""
    return marked(judged).where("passed").drop("passed")


def status_of(judged: DataFrame) -> DataFrame:
    """with_status of a spectrum that has its own results beside it: null without a result."""
    has = F.col("depth") > 0
    return judged.withColumns({c: F.when(has, F.col(c)) for c in ("qc_status", "failed_rules")})


def with_status(spectrum: DataFrame, results: DataFrame, status: str | None = None) -> DataFrame:
    """The spectrum with each variant's qc_status and failed_rules, null without a result; with a status, its variants only."""
    keys = ["sample_id", *KEY]
    out = spectrum.join(results.select(*keys, "qc_status", "failed_rules"), keys, "left")
    return out.where(F.col("qc_status") == status) if status else out


def condition(actual: Column, op: Column, value: Column, numeric: bool, double: bool = False) -> Column:
    """Whether a rule's condition on a field holds: by eq and ne numbers compare as numbers and text as text; by the others, what
    is a number on both sides; else false. A double is its own number, which any other value is by its text."""
    x, y = actual if double else actual.cast("string").try_cast("double"), value.try_cast("double")
    a, b = (x, y) if numeric else (actual.cast("string"), value)
    held = F.when(op == "gt", x > y).when(op == "gte", x >= y).when(op == "lt", x < y).when(op == "lte", x <= y)
    held = held.when(op == "eq", a == b).when(op == "ne", a != b)
    return F.coalesce(held, F.lit(False))


def score_variants(variants: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """Each row with score, the sum of the weights of the rules (field, op, value, weight) that it meets; 0 without rules.

    Rules are a few rows, bounded by who writes them: they go along as one array that is folded over in each row, so that equal rows
    stay apart and nothing shuffles.
    """
    table = rules.agg(F.collect_list(F.struct("field", "op", "value", F.col("weight").cast("bigint").alias("weight"))).alias("__rules"))
    numeric = {f: isinstance(variants.schema[f].dataType, NumericType) for f in fields}

    def weight(rule: Column) -> Column:
        met = F.lit(False)
        for f in fields:
            met = met | ((rule["field"] == f) & condition(F.col(f), rule["op"], rule["value"], numeric[f]))
        return F.when(met, rule["weight"]).otherwise(F.lit(0).cast("bigint"))

    score = F.aggregate("__rules", F.lit(0).cast("bigint"), lambda total, rule: total + weight(rule))
    return variants.crossJoin(F.broadcast(table)).withColumn("score", score).drop("__rules")  # the table is one row


def classify(score: Column) -> Column:
    c = F.when(score >= 6, CLASSES[0]).when(score >= 3, CLASSES[1]).when(score >= -2, CLASSES[2])
    return c.when(score > -6, CLASSES[3]).otherwise(CLASSES[4])


def detailed(variants: DataFrame, rules: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each row with matched_rules (names, in order), variant_score (the sum of their weights) and variant_classification.

    A null field meets no rule, and a rule on another field is passed over. Rules are a few rows, as in score_variants: they are read
    first and become plain conditions, as the folds of an array are not compiled.
    """
    kinds = {f: variants.schema[f].dataType for f in fields}
    table = rules.select("name", "field", "op", "value", F.col("weight").cast("double").alias("weight")).where(F.col("field").isin(*fields))
    names, score = [], F.lit(0.0)
    for rule in table.orderBy("name", "field", "op", "value", "weight").collect():
        kind, text = kinds[rule.field], lambda v: F.lit(v).cast("string")
        met = condition(F.col(rule.field), text(rule.op), text(rule.value), isinstance(kind, NumericType), isinstance(kind, DoubleType))
        names.append(F.when(met, F.struct(text(rule["name"]).alias("name"))))
        score = score + F.when(met, F.lit(rule.weight).cast("double")).otherwise(0.0)
    matched = F.array_compact(F.array(*names))["name"] if names else F.array().cast("array<string>")
    out = variants.withColumn("matched_rules", matched).withColumn("variant_score", score)
    return out.withColumn("variant_classification", classify(F.col("variant_score")))


def sample_scores(details: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, total_score, classification, total_variants) of each sample; one without variants scores 0."""
    sums = details.groupBy("sample_id").agg(F.sum("variant_score").alias("total_score"), F.count("*").alias("total_variants"))
    out = samples.select("sample_id").distinct().join(sums, "sample_id", "left").na.fill(0, ["total_score", "total_variants"])
    return out.select("sample_id", "total_score", classify(F.col("total_score")).alias("classification"), "total_variants")


def detail_filter(details: DataFrame, classification: str | None = None, gene: str | None = None) -> DataFrame:
    """The details of one class, of one gene, or both; a null or empty condition is none."""
    details = details.where(F.col("variant_classification") == classification) if classification else details
    return details.where(F.col("gene_name") == gene) if gene else details


def class_distribution(scored: DataFrame) -> DataFrame:
    """Rows of each class, zero for those without."""
    names = scored.sparkSession.createDataFrame([(c,) for c in CLASSES], "classification string")
    counts = scored.groupBy(classify(F.col("score")).alias("classification")).agg(F.count("*").alias("n"))
    return names.join(counts, "classification", "left").select("classification", F.coalesce("n", F.lit(0)).alias("n"))
