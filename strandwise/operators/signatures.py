"""Mutational signatures: spectra of contexts, exposures over time, matches; and sequence functions."""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nearest-neighbour enthalpy and entropy of each pair of bases, and what an end adds.
PAIRS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
ENDS = {"G": (0.1, -2.8), "C": (0.1, -2.8), "A": (2.3, 4.1), "T": (2.3, 4.1)}
GAS, STRAND = 1.987, 250e-9


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def gc_percent(bases: Column) -> Column:
    n = F.length(bases)
    return F.when(n == 0, 0.0).otherwise(F.round((n - F.length(F.translate(bases, "GC", ""))) * 100 / n, 2))


def melting_temperature(bases: Column) -> Column:
    """Nearest-neighbour Tm in °C, 2 digits; 0 below two bases."""
    pick = lambda table, k: F.create_map(*[x for b, v in table.items() for x in (F.lit(b), F.lit(v[k]))])
    def total(k: int) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.length(bases) - 1), lambda i: F.element_at(pick(PAIRS, k), F.substring(bases, i, F.lit(2))))
        inner = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
        return inner + F.element_at(pick(ENDS, k), F.substring(bases, 1, 1)) + F.element_at(pick(ENDS, k), F.substring(bases, -1, 1))
    tm = total(0) * 1000 / (total(1) + GAS * F.log(F.lit(STRAND / 4))) - 273.15
    return F.when(F.length(bases) < 2, 0.0).otherwise(F.round(tm, 2))


def primers(sequences: DataFrame, width: int) -> DataFrame:
    """(sequence_id, place, primer): every window of width bases, from 1; a shorter sequence is one whole."""
    places = sequences.select("sequence_id", "bases", F.explode(F.sequence(F.lit(1), F.greatest(F.length("bases") - (width - 1), F.lit(1)))).alias("place"))
    return places.select("sequence_id", "place", F.col("bases").substr(F.col("place"), F.lit(width)).alias("primer"))


def context_type(before: Column, ref: Column, after: Column, alt: Column) -> Column:
    """L[R>A]R with a pyrimidine in the middle."""
    flip = lambda c: F.translate(c, "ACGT", "TGCA")
    label = lambda l, r, a, x: F.concat(l, F.lit("["), r, F.lit(">"), a, F.lit("]"), x)
    return F.when(ref.isin("C", "T"), label(before, ref, alt, after)).otherwise(label(flip(after), flip(ref), flip(alt), flip(before)))


def context_spectrum(typed: DataFrame) -> DataFrame:
    """Rows of each sample and context, zero for contexts it lacks, in all 96."""
    spark = typed.sparkSession
    subs = [(r, a) for r in "CT" for a in "ACGT" if a != r]
    types = spark.createDataFrame([(f"{l}[{r}>{a}]{x}",) for r, a in subs for l in "ACGT" for x in "ACGT"], "mutation_type string")
    counts = typed.groupBy("sample_id", "mutation_type").agg(F.count("*").alias("n"))
    grid = typed.select("sample_id").distinct().crossJoin(F.broadcast(types))
    return grid.join(counts, ["sample_id", "mutation_type"], "left").select("sample_id", "mutation_type", F.coalesce("n", F.lit(0)).alias("n"))


def linear_trend(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and r² by key; 0 where all x are one."""
    g = points.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
    return g.select(*keys, "n", z("slope"), z("intercept"), z("r2"))


def two_tailed(r2: Column, df: Column) -> Column:
    """The chance of a correlation whose square is at least r2 with df degrees of freedom: Student's integral, a finite sum for whole df."""
    odd = df % 2 == 1
    more = F.greatest(F.when(odd, (df - 3) / 2).otherwise(df / 2 - 1), F.lit(0)).cast("int")
    steps = F.filter(F.sequence(F.lit(0), more), lambda k: k > 0)
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * ratio(k) * (1 - r2)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(steps, first, add)["total"]
    s = F.sqrt(r2)
    within = F.when(odd, (F.asin(s) + F.when(df > 1, s * F.sqrt(1 - r2) * total).otherwise(0.0)) * (2 / math.pi)).otherwise(s * total)
    return F.greatest(1 - within, F.lit(0.0))


def exposure_trends(points: DataFrame, keys: list[str], x: str, y: str, threshold: float = 0.05) -> DataFrame:
    """linear_trend of keys with three points or more, with p_value of the slope and trend: rising, falling or stable.

    One x for all gives slope 0, r2 0 and p 1; one y for all r2 1 and p 1. Rows without x or y are passed over.
    """
    g = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(y).alias("mean"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("xx"), F.regr_syy(y, x).alias("yy"))
    flat, level = F.col("xx") == 0, F.col("yy") == 0
    r2 = F.when(flat, 0.0).when(level, 1.0).otherwise(F.least("r2", F.lit(1.0)))
    slope, intercept = F.when(flat, 0.0).otherwise(F.col("slope")), F.when(flat, F.col("mean")).otherwise(F.col("intercept"))
    g = g.where("n >= 3").select(*keys, "n", slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"), (flat | level).alias("still"))
    # its own step: in the select that rounds r2, a lambda would take the rounded one
    g = g.withColumn("p_value", F.when(F.col("still"), 1.0).otherwise(two_tailed(F.col("r2"), F.col("n") - 2)))
    trend = F.when((F.col("p_value") >= threshold) | (F.abs("slope") < 1e-15), "stable").when(F.col("slope") > 0, "rising").otherwise("falling")
    g = g.withColumn("trend", trend)
    return g.select(*keys, "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2", "p_value")], "trend")


#: Groups of up to this many rows are ranked whole by exact_median; the error of its bounds, and the share around the middle that it ranks else.
WHOLE, ACCURACY, AROUND = 100_000, 100_000, 5e-5


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the middle value of each group, the mean of the middle two of an even number; nulls are passed over.

    A sketch bounds the middle, what lies below is only counted, and the values between are ranked: 1e-4 of a large group's rows, so that no
    task holds a group (up to WHOLE rows it does). The sketch's error is a fifth of what is taken on either side.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    near = F.percentile_approx("__v", [0.5 - AROUND, 0.5 + AROUND], ACCURACY)
    b = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), near.alias("__b"))
    small = F.col("__n") <= WHOLE
    b = b.select(*keys, "__n", F.when(small, F.col("__min")).otherwise(F.col("__b")[0]).alias("__low"), F.when(small, F.col("__max")).otherwise(F.col("__b")[1]).alias("__high"))
    placed = rows.join(b, keys).where("__v <= __high")
    # what lies below is one value, the null before all others
    counts = placed.groupBy(*keys, "__n", F.when(F.col("__v") >= F.col("__low"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()))
    middle = lambda at: (F.col("__upto") >= at) & (F.col("__upto") - F.col("__c") < at)
    ranked = counts.withColumn("__upto", upto).where(middle(F.expr("(__n + 1) div 2")) | middle(F.expr("__n div 2 + 1")))
    return ranked.groupBy(*keys).agg(F.avg("__v").alias("median"))


def exposure_change(exposures: DataFrame, start: str, end: str, aggregation: str = "mean") -> DataFrame:
    """Mean or median exposure up to start and from end on, and the change; in per cent unless the first is zero."""
    early, late = F.col("taken") <= F.lit(start).cast("timestamp"), F.col("taken") >= F.lit(end).cast("timestamp")
    if aggregation == "median":
        sides = F.array_compact(F.array(F.when(early, "first"), F.when(late, "last")))
        by = exact_median(exposures.select("signature", "exposure", F.explode(sides).alias("side")), ["signature", "side"], "exposure")
        g = exposures.select("signature").distinct().join(by, "signature", "left").groupBy("signature")
        g = g.agg(*[F.max(F.when(F.col("side") == s, F.col("median"))).alias(s) for s in ("first", "last")])
    else:
        g = exposures.groupBy("signature").agg(F.avg(F.when(early, F.col("exposure"))).alias("first"), F.avg(F.when(late, F.col("exposure"))).alias("last"))
    change = F.when(F.abs("first") >= 1e-15, F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 4))
    return g.select("signature", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), change.alias("percent"))


def strongest(exposures: DataFrame) -> DataFrame:
    """The signature with the largest total exposure of each sample; the first of equals."""
    total = exposures.groupBy("sample_id", "signature").agg(F.round(F.sum("exposure"), 6).alias("total"))
    w = Window.partitionBy("sample_id").orderBy(F.col("total").desc(), "signature")
    return total.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Parts that references are dealt into, parts that vectors are dealt into at least, and rows of vectors that meet a batch of references at a time.
STRIPS, LEAST_PARTS, SLICE = 8, 4, 512


def _better(best: np.ndarray, place: np.ndarray, cosine: np.ndarray, first: int, k: int) -> None:
    """Take the columns of cosine, which are the references from number first on, into the k best of each row (best, place), in place.

    References come in order, so that an equal one that comes later takes no place. Only what may pass the last of a row's best is rounded and ranked.
    """
    fresh = place[:, -1] < 0  # rows without k references yet
    floor = best[:, -1] + 4e-7
    if fresh.any():
        kth = max(cosine.shape[1] - k, 0)
        floor[fresh] = np.partition(cosine[fresh], kth, axis=1)[:, kth] - 1e-6
    row, col = np.nonzero(cosine >= floor[:, None])
    if not len(row):
        return
    met = np.unique(row)
    own = np.repeat(met, k)
    rows = np.concatenate([own, row])
    values = np.concatenate([best[met].ravel(), np.round(cosine[row, col], 6)])
    places = np.concatenate([place[met].ravel(), first + col])
    order = np.lexsort((places, -values, rows))  # a place not taken is below all others
    rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    order = order[rank < k]
    best[met], place[met] = values[order].reshape(-1, k), places[order].reshape(-1, k)


def best_matches(vectors: DataFrame, references: DataFrame, k: int = 3, block: int = 131_072) -> DataFrame:
    """The k references (ref_id, ref_vector) with the largest cosine, 6 digits, to each vector (id, vector), of all of them.

    Vectors are dealt into parts of about `block` rows and references into STRIPS, by hashes of their ids; each part meets each strip in a
    task of its own, that holds the part and reads the strip in batches. So a vector is shipped STRIPS times and a reference once for each
    part, never pair by pair, and a task gives k of each vector. What all strips give of a vector is then ranked once more. All have one length.
    """
    parts = max(LEAST_PARTS, -(-vectors.count() // block))
    to = lambda i, n: F.pmod(F.xxhash64(i), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(to("id", parts).alias("p"), every(STRIPS).alias("q"), F.lit(0).alias("side"), "id", F.lit(None).cast(references.schema["ref_id"].dataType).alias("ref_id"), F.col("vector").alias("v"))
    right = references.select(every(parts).alias("p"), to("ref_id", STRIPS).alias("q"), F.lit(1).alias("side"), F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), "ref_id", F.col("ref_vector").alias("v"))
    cells = left.unionByName(right).select((F.col("p") * STRIPS + F.col("q")).alias("cell"), "side", "id", "ref_id", "v")
    cells = cells.repartitionById(parts * STRIPS, "cell").sortWithinPartitions("side", "ref_id")
    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((vectors, "id"), (references, "ref_id"))], "similarity double"])

    def matrix(values: pa.Array) -> np.ndarray:
        return np.asarray(values.flatten()).reshape(len(values), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, refs, seen = [], [], [], 0
        x = best = place = None
        for rb in batches:
            n = int((np.asarray(rb["side"]) == 0).sum())  # vectors come first
            if n:
                ids.append(rb["id"].slice(0, n))
                held.append(matrix(rb["v"].slice(0, n)))
            if n == rb.num_rows or not ids:
                continue
            if x is None:
                x = np.concatenate(held)
                best, place = np.full((len(x), k), -np.inf), np.full((len(x), k), -1)
            y = matrix(rb["v"].slice(n)).astype(np.float64)
            refs.append(rb["ref_id"].slice(n))
            length = np.sqrt((y * y).sum(axis=1))
            for at in range(0, len(x), SLICE):
                part = x[at : at + SLICE].astype(np.float64)
                size = np.sqrt((part * part).sum(axis=1))[:, None] * length[None, :]
                cosine = part @ y.T
                np.divide(cosine, size, out=cosine, where=size != 0)  # of a zero vector the product is 0
                _better(best[at : at + SLICE], place[at : at + SLICE], cosine, seen, k)
            seen += len(y)
        if x is None:
            return
        ids, refs = pa.concat_arrays(ids), pa.concat_arrays(refs)
        for at in range(0, len(x), 10_000):
            row, rank = np.nonzero(place[at : at + 10_000] >= 0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + row)), refs.take(pa.array(place[at + row, rank])), pa.array(best[at + row, rank])], ["id", "ref_id", "similarity"])

    found = cells.mapInArrow(run, schema)
    w = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "ref_id", "similarity")


def cigar_runs(columns: DataFrame) -> DataFrame:
    """Run-length text of each id's operations (id, place, op)."""
    w = Window.partitionBy("id").orderBy("place", "op")
    new = columns.withColumn("new", F.when(F.lag("op").over(w) == F.col("op"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = new.groupBy("id", "run", "op").agg(F.count("*").alias("n"))
    parts = runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("run", F.concat(F.col("n").cast("string"), "op").alias("t")))).alias("all"))
    return parts.select("id", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("cigar"))
