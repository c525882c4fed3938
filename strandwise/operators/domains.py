"""Protein domains: where a variant is in its gene's code, the domains it hits, and what that risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlapping

#: The risk of each kind of domain, from the lowest, and what a variant without a risk is called.
RISKS = {"structural": "低风险", "binding": "中风险", "regulatory": "中风险", "catalytic": "高风险"}
LEVELS = ("未知风险", "低风险", "中风险", "高风险")
#: Reasons without a risk, and consequences that change a protein.
NO_DOMAINS, OUTSIDE, UNCHANGED = "无结构域信息", "不在任何结构域内", "命中结构域但非错义/无义突变"
HIT = ", 命中结构域: "
CHANGES = ("missense_variant", "stop_gained", "stop_lost")


def coding_exons(annotations: DataFrame) -> DataFrame:
    """(gene_name, strand, exon_order, exon_start, exon_end, codons_before) of the exons of each gene.

    A gene has the strand of its first annotation, + where that says nothing; its exons go up along +, down along -. Each exon counts its whole
    codons. An exon's place is a window over its gene's exons alone.
    """
    named = annotations.where("gene_name is not null and gene_name <> ''")
    strand = F.coalesce(F.nullif(F.first("strand").over(Window.partitionBy("gene_name").orderBy("annotation_id")), F.lit("")), F.lit("+"))
    exons = named.withColumn("strand", strand).where("feature_type = 'exon'")
    along = F.when(F.col("strand") == "-", -F.col("end_pos")).otherwise(F.col("start_pos"))
    order = Window.partitionBy("gene_name").orderBy(along, "annotation_id")
    codons = F.floor((F.col("end_pos") - F.col("start_pos") + 1) / 3)
    before = F.coalesce(F.sum(codons).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return exons.select("gene_name", "strand", F.row_number().over(order).alias("exon_order"), F.col("start_pos").alias("exon_start"), F.col("end_pos").alias("exon_end"), before.alias("codons_before"))


def codon_positions(variants: DataFrame, exons: DataFrame) -> DataFrame:
    """variants (gene_name, ref_pos and more) of exons with codon_position, from 1 along the gene; those outside of the gene's exons are left out.

    Each place of a gene is looked up once: the first exon over it, in the gene's order.
    """
    places = variants.select("gene_name", "ref_pos").distinct().withColumn("__end", F.col("ref_pos"))
    met = overlapping(places, exons, ["gene_name"], ("ref_pos", "__end"), ("exon_start", "exon_end"))
    within = F.when(F.col("strand") == "-", F.col("exon_end") - F.col("ref_pos")).otherwise(F.col("ref_pos") - F.col("exon_start"))
    codon = (F.col("codons_before") + F.floor(within / 3) + 1).cast("bigint")
    first = met.groupBy("gene_name", "ref_pos").agg(F.min_by(codon, "exon_order").alias("codon_position"))
    return variants.join(first, ["gene_name", "ref_pos"])


def _level(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)


def domain_impact(variants: DataFrame, exons: DataFrame, domains: DataFrame) -> DataFrame:
    """variants of exons with codon_position, hit_domains, amino_acid_change, risk_level and risk_reason.

    variants have gene_name, ref_pos, consequence, aa_ref and aa_alt; domains (domain_id, gene_name, domain_name, start_codon,
    end_codon, domain_type). All domains over the codon count; the worst kind gives the risk, if the consequence changes the protein.
    """
    at = codon_positions(variants, exons)
    codons = at.select("gene_name", "codon_position").distinct().withColumn("__end", F.col("codon_position"))
    met = overlapping(codons, domains, ["gene_name"], ("codon_position", "__end"), ("start_codon", "end_codon"))
    kinds = list(RISKS)
    rank = sum((F.when(F.col("domain_type") == k, LEVELS.index(RISKS[k])).otherwise(0) for k in kinds), F.lit(0))
    row = F.struct("domain_id", "domain_name", "domain_type", "start_codon", "end_codon")
    hits = met.groupBy("gene_name", "codon_position").agg(F.sort_array(F.collect_list(row)).alias("hit_domains"), F.max(rank).alias("__rank"))
    known = domains.select("gene_name").distinct().withColumn("__known", F.lit(True))
    out = at.join(hits, ["gene_name", "codon_position"], "left").join(known, "gene_name", "left")
    changes, hit = F.coalesce(F.col("consequence").isin(*CHANGES), F.lit(False)), F.col("hit_domains").isNotNull()
    names = F.array_join(F.transform("hit_domains", lambda x: F.concat(x["domain_name"], F.lit("("), x["domain_type"], F.lit(")"))), ", ")
    reason = F.when(~hit, F.when(F.col("__known"), OUTSIDE).otherwise(NO_DOMAINS)).when(~changes, UNCHANGED).otherwise(F.concat("consequence", F.lit(HIT), names))
    change = F.when(changes & (F.col("aa_ref") != "") & (F.col("aa_alt") != ""), F.concat("aa_ref", F.col("codon_position").cast("string"), "aa_alt"))
    level = _level(F.when(hit & changes, F.col("__rank")).otherwise(0))
    return out.withColumns({"amino_acid_change": change, "risk_level": level, "risk_reason": reason, "hit_domains": F.coalesce("hit_domains", F.array().cast(out.schema["hit_domains"].dataType))}).drop("__rank", "__known")


def _risk_counts() -> list[Column]:
    names = ("unknown_risk_count", "low_risk_count", "medium_risk_count", "high_risk_count")
    return [F.count_if(F.col("risk_level") == level).alias(n) for level, n in zip(LEVELS, names, strict=True)]


def sample_risks(exon_variants: DataFrame, impact: DataFrame) -> DataFrame:
    """Per sample: its exon variants, those placed in a gene, those with a domain hit, and how many are of each risk."""
    total = exon_variants.groupBy("sample_id").agg(F.count("*").alias("total_exon_variants"))
    per = impact.groupBy("sample_id").agg(F.count("*").alias("mapped_variants"), F.count_if(F.size("hit_domains") > 0).alias("variants_with_domain_hit"), *_risk_counts())
    return total.join(per, "sample_id", "left").na.fill(0)


def domain_summary(impact: DataFrame, key: list[str]) -> DataFrame:
    """Per domain: distinct variants (key and consequence) in it, distinct samples that carry one, and variants of each risk."""
    each = impact.select(F.explode("hit_domains").alias("d"), "sample_id", *key, "consequence", "gene_name", "risk_level")
    each = each.select("gene_name", "d.domain_id", "d.domain_name", "d.domain_type", "sample_id", *key, "consequence", "risk_level")
    by = ["gene_name", "domain_id", "domain_name", "domain_type"]
    samples = each.groupBy(*by).agg(F.count_distinct("sample_id").alias("unique_samples"))
    variants = each.select(*by, *key, "consequence", "risk_level").distinct().groupBy(*by).agg(F.count("*").alias("total_variants"), *_risk_counts())
    return variants.join(samples, by)
