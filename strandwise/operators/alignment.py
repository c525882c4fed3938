"""Local alignment of queries with references, the variants that it shows, and their effects."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import translate_codon

#: Scores of equal bases, of other bases and of a gap; the cells of a matrix that are traced at a time, about.
MATCH, MISMATCH, GAP, CELLS = 2, -1, -2, 5_000_000
#: Fixed value: the part of the best score that an alignment needs to be kept.
KEEP = 0.8
#: What a traceback cell says: where the best score comes from, ties in this order.
STOP, BOTH, QUERY, REFERENCE = 0, 1, 2, 3
#: Letters of a reference that are scored at a time.
TILE = 16_384
ALIGNED = "score int, query_start int, query_end int, ref_start int, ref_end int, aligned_query string, aligned_ref string"


def letters(text: str) -> np.ndarray:
    """The code point of each letter."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _tile_end(query: np.ndarray, tile: np.ndarray, skip: int) -> tuple[int, int, int]:
    """(score, row, column) of the first best cell in row order beyond the first skip columns; rows and columns count from 1."""
    slope = -GAP * np.arange(len(tile) + 1, dtype=np.int32)
    scores = {b: np.where(tile == b, MATCH, MISMATCH).astype(np.int32) for b in np.unique(query).tolist()}
    above, row = np.zeros(len(tile) + 1, np.int32), np.zeros(len(tile) + 1, np.int32)
    best, end = 0, (0, 0)
    for i, base in enumerate(query.tolist(), 1):
        np.add(above, GAP, out=row)
        np.maximum(row, 0, out=row)
        row[0] = 0
        above[:-1] += scores[base]
        np.maximum(row[1:], above[:-1], out=row[1:])
        row += slope
        np.maximum.accumulate(row, out=row)
        row -= slope
        own = row[skip + 1 :]
        if len(own) and (top := int(own.max())) > best:
            best, end = top, (i, skip + 1 + int(own.argmax()))
        above, row = row, above
    return best, *end


def _end(query: np.ndarray, ref: np.ndarray) -> tuple[int, int, int]:
    """_tile_end of the whole reference, in memory of a tile.

    An alignment that scores above 0 has less than two letters of ref for each of the query's, so a cell is right in a tile that begins so
    far before it. Tiles of equal letters are scored once.
    """
    before = 2 * len(query)
    width = TILE * max(1, -(-2 * before // TILE))
    known: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    best, end = 0, (0, 0)
    for at in range(0, len(ref), width):
        left = max(0, at - before)
        tile = ref[left : at + width]
        key = at - left, tile.tobytes()
        if key not in known:
            known[key] = _tile_end(query, tile, at - left)
        score, i, j = known[key]
        if score > best or (score == best and score and i < end[0]):
            best, end = score, (i, left + j)
    return best, *end


def _local(query: np.ndarray, ref: np.ndarray) -> tuple:
    """The first best local alignment in row order, rows being the query's bases: the fields of ALIGNED.

    A row is one vector step: what a gap along the row can bring is a running maximum, as each base of it costs the same. In a long reference
    the end is found first; then only what an alignment to there, and all that its cells are compared with, can reach is traced. Every step-th
    row is kept, and the rows between two of them are scored again where the trace meets them.
    """
    if len(ref) > 2 * TILE:
        score, _, j = _end(query, ref)
        left = max(0, j - 4 * len(query) - 4)
        if not score:
            return 0, 0, 0, 0, 0, "", ""
        if left or j < len(ref):
            _, qs, qe, rs, re, x, y = _local(query, ref[left:j])
            return score, qs, qe, rs + left, re + left, x, y
    slope = -GAP * np.arange(len(ref) + 1)
    step = max(CELLS // (len(ref) + 1), math.isqrt(len(query)) + 1)
    above, best, end, kept = np.zeros(len(ref) + 1, np.int64), 0, (0, 0), []
    came: list[np.ndarray] = []
    for i, base in enumerate(query):
        if i % step == 0:
            kept.append(above)
        above, *ways = _row(above, base, ref, slope)
        if step >= len(query):
            came.append(_came(above, *ways))
        j = int(above.argmax())
        if above[j] > best:
            best, end = int(above[j]), (i + 1, j)
    if not best:
        return 0, 0, 0, 0, 0, "", ""
    i, j = end
    q, r = [], []
    first = 0 if came else i  # came has the rows after it
    while i:
        if i <= first:
            first = (i - 1) // step * step
            above, came = kept[first // step], []
            for base in query[first:i]:
                above, *ways = _row(above, base, ref, slope)
                came.append(_came(above, *ways))
        way = came[i - first - 1][j]
        if way == STOP:
            break
        from_query, from_ref = way != REFERENCE, way != QUERY
        i, j = i - from_query, j - from_ref
        q.append(query[i] if from_query else ord("-"))
        r.append(ref[j] if from_ref else ord("-"))
    return best, int(i), end[0] - 1, int(j), end[1] - 1, "".join(map(chr, q[::-1])), "".join(map(chr, r[::-1]))


def _row(above: np.ndarray, base: int, ref: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of scores of a base below the row above, and what both bases and a gap in ref bring to its cells."""
    both, gap = np.zeros_like(above), above + GAP
    both[1:] = above[:-1] + np.where(ref == base, MATCH, MISMATCH)
    down = np.maximum(gap, 0)
    down[0] = 0
    return np.maximum.accumulate(np.maximum(both, down) + slope) - slope, both, gap


def _came(row: np.ndarray, both: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Where the best score of each cell comes from."""
    return np.where(row == 0, STOP, np.where(row == both, BOTH, np.where(row == gap, QUERY, REFERENCE))).astype(np.uint8)


def local_alignment(query: str, ref: str) -> tuple:
    """The fields of ALIGNED for one pair: the best of its whole matrix, however large the pair is."""
    return _local(letters(query), letters(ref))


def align(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Each query (query_id, query) against each reference (reference_id, bases): alignments, as ALIGNED says, with cigar,
    match and query_md5 of the query as written.

    Bases compare in upper case for queries, as they are for references. Null or empty sides score 0 with empty texts; equal rows
    are aligned each. Queries are a stated set (50 in a batch, of 1,000 bases), and each meets all references: that is what
    is asked for. Pairs are dealt over the tasks by their ids and align by themselves, so that a lost task repeats only its own.
    """
    pairs = queries.select("query_id", "query").crossJoin(references.select("reference_id", F.col("bases").alias("__bases")))
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(width, "query_id", "reference_id")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, reference_id {references.schema['reference_id'].dataType.simpleString()}, query_md5 string, {ALIGNED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        for rb in batches:
            made = [local_alignment((q or "").upper(), r or "") for q, r in zip(rb["query"].to_pylist(), rb["__bases"].to_pylist(), strict=True)]
            ints = [pa.array([m[k] for m in made], pa.int32()) for k in range(5)]
            texts = [pa.array([m[k] for m in made], pa.string()) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([rb["query_id"], rb["reference_id"], rb["query_md5"], *ints, *texts], ["query_id", "reference_id", "query_md5", *names])

    aligned = pairs.withColumn("query_md5", F.md5("query")).mapInArrow(run, schema)
    q, r = (F.split(F.col(c), "") for c in ("aligned_query", "aligned_ref"))
    mark = F.zip_with(q, r, lambda x, y: F.when((x == "-") | (y == "-"), " ").when(x == y, "|").otherwise("*"))
    return aligned.withColumn("match", F.when(F.col("aligned_query") == "", "").otherwise(F.array_join(mark, ""))).withColumn("cigar", cigar(q, r))


def cigar(query: Column, ref: Column) -> Column:
    """Run lengths of M, I (a gap in the reference) and D (a gap in the query) of two arrays of bases; empty for empty ones."""
    ops = F.array_join(F.zip_with(query, ref, lambda x, y: F.when(x == "-", "D").when(y == "-", "I").when(x != "", "M")), "")
    runs = F.regexp_extract_all(ops, F.lit("M+|I+|D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.length(t).cast("string"), F.substring(t, 1, 1))), "")


def kept(aligned: DataFrame) -> DataFrame:
    """The alignments of each query with a score above 0 and at least KEEP of its best."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return aligned.withColumn("__best", best).where((F.col("score") > 0) & (F.col("score") >= KEEP * F.col("__best"))).drop("__best")


#: The most queries of a batch, and the most bases of a query.
BATCH, LONGEST = 50, 1000


def batch_results(items: DataFrame, references: DataFrame) -> DataFrame:
    """A row for each item (batch_id, order_index, query) with status and error, aligned, and the best alignment of one that has any.

    A batch of over BATCH items, or with a query of over LONGEST bases, is rejected whole, before anything is aligned; a null query, an item
    without batch or place, and other queries for one place fail by themselves. Of equal scores the least reference_id is best; a query that aligns
    nowhere is completed, with nulls. aligned is true only where a row has an alignment, so that none else is taken for one. Equal items of one
    batch and place are one item. Sizes come from one count for each batch, so that no batch is held by a task.
    """
    place, score = ["batch_id", "order_index"], ("reference_id", "ref_start", "ref_end", "query_start", "query_end", "cigar")
    several = (F.min("query") != F.max("query")) | (F.count("query").between(1, F.count("*") - 1))
    items = items.groupBy(*place).agg(F.min("query").alias("query"), F.max(F.length("query")).alias("__length"), F.coalesce(several, F.lit(False)).alias("__several"))
    sizes = items.groupBy(F.col("batch_id").alias("__batch")).agg(F.count("*").alias("__n"), F.max("__length").alias("__longest"))
    checked = items.join(sizes, F.col("batch_id").eqNullSafe(F.col("__batch")))
    large, long = F.col("__n") > BATCH, F.coalesce(F.col("__longest") > LONGEST, F.lit(False))
    error = (
        F.when(large, f"over {BATCH} queries").when(long, f"a query of over {LONGEST} bases")
        .when(F.col("batch_id").isNull() | F.col("order_index").isNull(), "no batch or place").when(F.col("__several"), "several queries for one place").when(F.col("query").isNull(), "no query")
    )
    status = F.when(large | long, "rejected").when(error.isNotNull(), "failed").otherwise("completed")
    checked = checked.select(*place, "query", status.alias("status"), error.alias("error"))
    todo = checked.where("status = 'completed'").select(F.struct(*place).alias("query_id"), "query")
    best = F.min(F.struct((-F.col("score")).alias("__score"), *score)).alias("b")
    top = align(todo, references).where("score > 0").groupBy("query_id").agg(best)
    found = top.select("query_id.*", (-F.col("b.__score")).alias("score"), *[f"b.{c}" for c in score])
    return checked.drop("query").join(found, place, "left").withColumn("aligned", F.col("score").isNotNull())


def called_variants(aligned: DataFrame) -> DataFrame:
    """(query_id, reference_id, variant_type, ref_pos, ref_base, alt_base, ref_pos_end): each other base, and each run of gaps as one.

    An insertion stands before its ref_pos. Columns of an alignment are told apart within a window of it alone: they are as
    many as its bases.
    """
    ids = [c for c in ("query_id", "reference_id") if c in aligned.columns]
    own = [*ids, "ref_start", "aligned_query", "aligned_ref"]
    rows = aligned.where("score > 0").groupBy(*own).agg(F.count("*").alias("__n")).withColumn("__row", F.xxhash64(*own))
    side = lambda c: F.split(F.col(c), "")
    cols = rows.select(*ids, "__row", "__n", "ref_start", F.posexplode(F.arrays_zip(side("aligned_query").alias("q"), side("aligned_ref").alias("r"))).alias("place", "c"))
    op = F.when(F.col("c.q") == "-", "DEL").when(F.col("c.r") == "-", "INS").when(F.col("c.q") != F.col("c.r"), "SNP").otherwise("")
    order = Window.partitionBy("__row").orderBy("place")
    cols = cols.withColumn("variant_type", op)
    cols = cols.withColumn("pos", F.col("ref_start") + F.count_if(F.col("c.r") != "-").over(order) - F.when(F.col("c.r") != "-", 1).otherwise(0))
    new = (F.lag("variant_type").over(order) == F.col("variant_type")) & F.col("variant_type").isin("INS", "DEL")
    cols = cols.withColumn("run", F.sum(F.when(new, 0).otherwise(1)).over(order)).where("variant_type <> ''")
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(f"c.{c}").alias("b")))), lambda x: x["b"]), "")
    out = cols.groupBy(*ids, "__row", "run", "variant_type").agg(F.min("pos").alias("ref_pos"), F.max("pos").alias("ref_pos_end"), F.first("__n").alias("__n"), text("r").alias("r"), text("q").alias("q"))
    out = out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))  # equal alignments show the same each
    ref, alt = (F.when(F.col("variant_type") == t, "").otherwise(F.col(c)) for t, c in (("INS", "r"), ("DEL", "q")))
    return out.select(*ids, "variant_type", "ref_pos", ref.alias("ref_base"), alt.alias("alt_base"), "ref_pos_end")


def with_codon(variants: DataFrame, references: DataFrame, width: int = 1200) -> DataFrame:
    """variants with codon_ref: the reference's bases from the codon's start on, codons counted from start_pos; null without one.

    References are cut into blocks of width bases and two more, so that a variant meets a short text, not a whole sequence.
    """
    # one pass over the text: a substring by place counts letters from the first one, for each block anew
    whole = F.lit(f"(?s)(.{{1,{width}}})(?=(.{{0,2}}))")
    cut = F.arrays_zip(F.regexp_extract_all("bases", whole, F.lit(1)).alias("own"), F.regexp_extract_all("bases", whole, F.lit(2)).alias("next"))
    blocks = references.select("reference_id", F.posexplode(cut).alias("__block", "b"))
    blocks = blocks.select("reference_id", "__block", F.concat("b.own", "b.next").alias("__bases"))
    start = F.col("ref_pos") - F.pmod(F.col("ref_pos") - F.col("start_pos"), F.lit(3))
    placed = variants.withColumn("__start", start).withColumn("__block", F.expr(f"cast(__start div {width} as int)"))
    codon = F.upper(F.col("__bases").substr((F.pmod("__start", F.lit(width)) + 1).cast("int"), F.lit(3)))
    out = placed.join(blocks, ["reference_id", "__block"], "left").withColumn("codon_ref", F.when((F.length(codon) == 3) & (F.col("__start") >= 0), codon))
    return out.drop("__start", "__block", "__bases")


def effects(annotated: DataFrame, references: DataFrame) -> DataFrame:
    """Variants with their first feature (feature_type, start_pos; null start_pos: none) and impact, consequence, codons and amino acids.

    Codons are counted from an exon's start. SNPs whose codon the reference ends within are missense, without codons.
    """
    return consequences(with_codon(annotated, references))


def consequences(v: DataFrame) -> DataFrame:
    """effects of variants that have the codon_ref of with_codon."""
    exon, kind = F.col("start_pos").isNotNull() & (F.col("feature_type") == "exon"), F.col("variant_type")
    codon = F.when(exon & (kind == "SNP"), F.col("codon_ref"))
    place = F.pmod(F.col("ref_pos") - F.col("start_pos"), F.lit(3)).cast("int")
    v = v.withColumn("codon_ref", codon).withColumn("codon_alt", F.when(codon.isNotNull(), F.overlay(codon, F.upper("alt_base"), place + 1)))
    v = v.withColumn("aa_ref", translate_codon(F.col("codon_ref"))).withColumn("aa_alt", translate_codon(F.col("codon_alt")))
    changed = F.col("aa_ref") != F.col("aa_alt")
    frame = lambda c, name: F.when(F.length(c) % 3 != 0, "frameshift_variant").otherwise(name)
    exonic = (
        F.when(kind == "INS", frame("alt_base", "inframe_insertion")).when(kind == "DEL", frame("ref_base", "inframe_deletion"))
        .when(kind != "SNP", "exon_variant").when(~changed, "synonymous_variant").when(changed & (F.col("aa_alt") == "*"), "stop_gained")
        .when(changed & (F.col("aa_ref") == "*"), "stop_lost").otherwise("missense_variant")
    )
    feature = F.when(F.col("start_pos").isNull(), "none").otherwise(F.col("feature_type"))
    other = F.when(feature.isin("intron", "UTR", "intergenic"), F.concat(feature, F.lit("_variant")))
    v = v.withColumn("consequence", F.when(exon, exonic).otherwise(other))
    c = F.coalesce("consequence", F.lit(""))
    high = c.isin("frameshift_variant", "stop_gained", "stop_lost")
    moderate = c.isin("missense_variant", "inframe_insertion", "inframe_deletion")
    return v.withColumn("impact", F.when(high, "HIGH").when(moderate, "MODERATE").when(c.isin("synonymous_variant", "intron_variant", "UTR_variant"), "LOW").otherwise("MODIFIER"))
