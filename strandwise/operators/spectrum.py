"""Variant spectra, population frequency, comparison and interval operators; DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["reference_id", "ref_pos", "variant_type", "ref_base", "alt_base"]


#: Rows of a task that groups by alignment or by sample and five-tuple, about.
TASK_ROWS = 250_000


def tasks(links: DataFrame, variants: DataFrame) -> tuple[int, int]:
    """Tasks that what alignments show, and what samples carry of it, are dealt over: as many more as there is more of it, so that a task's memory stays.

    Parquet's footers give the counts of plain tables; how many samples share an alignment takes a pass over links.
    """
    least, n = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions")), variants.count()
    row = links.agg(F.count("*").alias("links"), F.approx_count_distinct("alignment_id").alias("alignments")).first()
    share = max(1.0, row["links"] / max(1, row["alignments"]))
    return max(least, -(-n // TASK_ROWS)), max(least, int(n * share) // TASK_ROWS + 1)


def carried(links: DataFrame, variants: DataFrame, n: int) -> DataFrame:
    """(alignment_id, sample_id, KEY, first_variant), once each, in n tasks by alignment: each side is made distinct before they meet."""
    own = variants.select("alignment_id", *KEY, "variant_id").where("alignment_id is not null").repartition(n, "alignment_id").groupBy("alignment_id", *KEY).agg(F.min("variant_id").alias("first_variant"))
    of = links.select("alignment_id", "sample_id").repartition(n, "alignment_id").distinct()
    return of.join(own, "alignment_id")


def shown_to(links: DataFrame, variants: DataFrame, n: int) -> DataFrame:
    """carried without first_variant, and a variant that an alignment shows twice is there twice: for what repeats change nothing of."""
    own = variants.select("alignment_id", *KEY).where("alignment_id is not null").repartition(n, "alignment_id")
    return links.select("alignment_id", "sample_id").repartition(n, "alignment_id").distinct().join(own, "alignment_id")


def variant_spectrum(links: DataFrame, variants: DataFrame) -> DataFrame:
    """One row for each sample and five-tuple: its distinct alignments and first variant."""
    by_alignment, by_sample = tasks(links, variants)
    joined = carried(links, variants, by_alignment).repartition(by_sample, "sample_id", *KEY)
    return joined.groupBy("sample_id", *KEY).agg(F.count("*").alias("n_alignments"), F.min("first_variant").alias("first_variant"))


def population_frequency(spectrum: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct carriers of each five-tuple over all samples, with or without data."""
    total = samples.agg(F.count_distinct("sample_id").alias("n_samples"))  # one row
    carriers = spectrum.groupBy(*KEY).agg(F.count_distinct("sample_id").alias("carriers"))
    return carriers.crossJoin(F.broadcast(total)).withColumn("frequency", F.col("carriers") / F.col("n_samples"))


def with_frequency(carriers: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """A spectrum (a row for each sample and five-tuple) with each five-tuple's population_frequency, as of its carriers in it, and without rows of a null key.

    Rows are dealt over n tasks by site and sorted within, so that a site's annotation meets them next without another shuffle; the
    position goes first, as few rows share it.
    """
    site = ["ref_pos", "reference_id"]
    total = samples.agg(F.count_distinct("sample_id").alias("n_samples"))  # one row
    own = Window.partitionBy(*site, *[k for k in KEY if k not in site])
    rows = carriers.na.drop(subset=KEY).repartition(n, *site).withColumn("__carriers", F.count("sample_id").over(own))
    return rows.crossJoin(F.broadcast(total)).withColumn("population_frequency", F.col("__carriers") / F.col("n_samples")).drop("__carriers", "n_samples")


def frequency_range(frequency: DataFrame, low: float, high: float) -> DataFrame:
    return frequency.where(F.col("frequency").between(low, high)).orderBy("ref_pos", *KEY)


def filtered(rows: DataFrame, reference_id: int | None = None, impact: str | None = None, gene: str | None = None, variant_type: str | None = None) -> DataFrame:
    """The rows of an annotated spectrum that meet all conditions given, by reference and position."""
    for column, value in (("reference_id", reference_id), ("impact", impact), ("gene_name", gene), ("variant_type", variant_type)):
        rows = rows.where(F.col(column) == value) if value is not None and value != "" else rows
    return rows.orderBy("reference_id", "ref_pos", *KEY[2:], "sample_id")


def by_site(spectrum: DataFrame) -> DataFrame:
    """Each sample's sites: its variants there, their number and the one of least key; a site of two references is two."""
    change = F.concat_ws(":", "variant_type", "ref_base", "alt_base")
    per = spectrum.select("sample_id", "reference_id", "ref_pos", change.alias("change")).distinct()
    return per.groupBy("sample_id", "reference_id", "ref_pos").agg(F.array_join(F.sort_array(F.collect_list("change")), ",").alias("changes"), F.count("*").alias("n"))


def minor_allele_frequency(spectrum: DataFrame, samples: DataFrame) -> DataFrame:
    """MAF of each SNP position of each reference over all samples, any allele counting."""
    n = samples.agg(F.count_distinct("sample_id").alias("n"))
    f = spectrum.where("variant_type = 'SNP'").groupBy("reference_id", "ref_pos").agg(F.count_distinct("sample_id").alias("c")).crossJoin(F.broadcast(n))
    return f.select("reference_id", "ref_pos", F.least(F.col("c") / F.col("n"), 1 - F.col("c") / F.col("n")).alias("maf"))


def maf_filter(maf: DataFrame, start: int, end: int, least: float) -> DataFrame:
    return maf.where(F.col("ref_pos").between(start, end) & (F.col("maf") >= least))


def table_length(variants: DataFrame) -> DataFrame:
    """One row: the length of the stretch that variants cover, from position 0 to the last."""
    return variants.agg((F.coalesce(F.max("ref_pos"), F.lit(-1)) + 1).alias("length"))


def density_buckets(variants: DataFrame, width: int) -> DataFrame:
    """Variants in each bucket of width positions up to the last position, zero where there are none."""
    last = table_length(variants).where("length > 0")
    buckets = last.select("length", F.explode(F.expr(f"sequence(0, (length - 1) div {width})")).alias("bucket"))
    counts = variants.groupBy(F.expr(f"ref_pos div {width}").alias("bucket")).agg(F.count("ref_pos").alias("n"))
    end = F.least((F.col("bucket") + 1) * width - 1, F.col("length") - 1)
    return buckets.join(counts, "bucket", "left").select("bucket", (F.col("bucket") * width).alias("start_pos"), end.alias("end_pos"), F.coalesce("n", F.lit(0)).alias("n"))


def counts_by(variants: DataFrame, column: str) -> DataFrame:
    return variants.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias(column)).agg(F.count("*").alias("n"))


def compare(spectrum: DataFrame, a: int, b: int) -> DataFrame:
    """Five-tuples of either sample, marked by where they are."""
    side = lambda s, name: spectrum.where(F.col("sample_id") == s).select(*KEY).distinct().withColumn(name, F.lit(True))
    both = side(a, "in_a").join(side(b, "in_b"), KEY, "full_outer")
    return both.select(*KEY, F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "only_a").otherwise("only_b").alias("found"))


def compared_jaccard(compared: DataFrame) -> DataFrame:
    """Shared over all, 6 digits; 0 for two empty sets."""
    n, all_ = F.count_if(F.col("found") == "shared"), F.count("*")
    return compared.agg(n.alias("shared"), all_.alias("total"), F.when(all_ == 0, 0.0).otherwise(F.round(n / all_, 6)).alias("jaccard"))


def same_site_other_allele(spectrum: DataFrame, a: int, b: int) -> DataFrame:
    """Positions where both samples have alleles and none in common."""
    per = spectrum.where(F.col("sample_id").isin(a, b)).groupBy("reference_id", "ref_pos", "alt_base").agg(F.count_distinct("sample_id").alias("n"), F.min("sample_id").alias("s"))
    site = per.groupBy("reference_id", "ref_pos").agg(F.max("n").alias("most"), F.count_distinct("s").alias("sides"), F.count("*").alias("alleles"))
    return site.where("most = 1 and sides = 2").select("reference_id", "ref_pos", "alleles")


def annotate_first(variants: DataFrame, annotations: DataFrame, width: int = 50) -> DataFrame:
    """The first annotation of its reference over each variant's position, or intergenic. Intervals are dealt into bins of
    width, so the range join is an equi-join whose sides hold a row for each bin."""
    binned = annotations.withColumn("bin", F.explode(F.sequence(F.expr(f"start_pos div {width}"), F.expr(f"end_pos div {width}"))))
    sites = variants.select("reference_id", "ref_pos").distinct().withColumn("bin", F.expr(f"ref_pos div {width}"))
    hits = sites.join(binned, ["reference_id", "bin"]).where("ref_pos between start_pos and end_pos")
    first = hits.groupBy("reference_id", "ref_pos").agg(F.min("annotation_id").alias("annotation_id"))
    named = first.join(annotations.drop("reference_id"), "annotation_id").select("reference_id", "ref_pos", "annotation_id", "start_pos", "feature_type", "gene_name")
    return variants.join(named, ["reference_id", "ref_pos"], "left").withColumn("feature_type", F.coalesce("feature_type", F.lit("intergenic")))


def first_features(variants: DataFrame, annotations: DataFrame, width: int = 50) -> DataFrame:
    """Each site of variants once, with what annotate_first gives there: sites are made distinct once, and those without a hit stay beside the others."""
    binned = annotations.select("reference_id", F.explode(F.sequence(F.expr(f"start_pos div {width}"), F.expr(f"end_pos div {width}"))).alias("bin"), "start_pos", "end_pos", "annotation_id")
    sites = variants.select("ref_pos", "reference_id").distinct().withColumn("bin", F.expr(f"ref_pos div {width}"))
    s, a = sites.alias("s"), binned.alias("a")
    over = (F.col("s.reference_id") == F.col("a.reference_id")) & (F.col("s.bin") == F.col("a.bin")) & F.col("s.ref_pos").between(F.col("a.start_pos"), F.col("a.end_pos"))
    first = s.join(a, over, "left").groupBy("s.ref_pos", "s.reference_id").agg(F.min("annotation_id").alias("annotation_id"))
    named = first.join(annotations.select("annotation_id", "start_pos", "feature_type", "gene_name"), "annotation_id", "left")
    return named.select("ref_pos", "reference_id", "annotation_id", "start_pos", F.coalesce("feature_type", F.lit("intergenic")).alias("feature_type"), "gene_name")


def hotspots(frequency: DataFrame, spectrum: DataFrame, annotations: DataFrame, least: float, width: int = 50) -> DataFrame:
    """Annotations with at least `least` distinct positions per 100 bases, their carriers and the most frequent variant's."""
    binned = annotations.withColumn("bin", F.explode(F.sequence(F.expr(f"start_pos div {width}"), F.expr(f"end_pos div {width}"))))
    at = lambda df: df.withColumn("bin", F.expr(f"ref_pos div {width}")).join(binned, ["reference_id", "bin"]).where("ref_pos between start_pos and end_pos")
    per = at(frequency).groupBy("annotation_id", "start_pos", "end_pos").agg(F.count_distinct("ref_pos").alias("positions"), F.max("frequency").alias("top_frequency"))
    per = per.withColumn("density", F.col("positions") * 100 / (F.col("end_pos") - F.col("start_pos") + 1)).where(F.col("density") >= least)
    carriers = at(spectrum).groupBy("annotation_id").agg(F.count_distinct("sample_id").alias("carriers"))
    return per.join(carriers, "annotation_id").select("annotation_id", "positions", "carriers", "top_frequency", F.round("density", 4).alias("density"))


def earliest_carriers(spectrum: DataFrame, samples: DataFrame) -> DataFrame:
    """Carriers of each variant with their dates; all that share the least date are marked."""
    w = Window.partitionBy(*KEY)
    dated = spectrum.join(samples.select("sample_id", "collection_date"), "sample_id")
    return dated.select(*KEY, "sample_id", "collection_date", F.coalesce(F.col("collection_date") == F.min("collection_date").over(w), F.lit(False)).alias("earliest"))


def page(rows: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)
