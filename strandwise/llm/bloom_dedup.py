"""Exact dedup by two-pass Bloom filtering.

Pass one marks k bits for each text's digest and keeps the bits marked twice or more: a digest that
occurs twice has all of its bits among them. Pass two tests each row against that bitmap; only rows
whose bits are all there shuffle, the rest pass straight through with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: The bitmap is broadcast; these bound its size (2**27 bits: 2**21 rows of 16 bytes).
MIN_BITS, MAX_BITS, HASHES = 1 << 16, 1 << 27, 2
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def _bits(sha: Column, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(m)) for k in range(HASHES)]


def repeated_bits(digests: DataFrame, m: int) -> DataFrame:
    """(word, mask): the bits that two or more rows set, 64 to a row; m / 64 rows at most."""
    return repeated_bits_of(digests.select(F.explode(F.array(*_bits(F.col("text_sha256"), m))).alias("bit")), m)


def repeated_bits_of(bit: DataFrame, m: int) -> DataFrame:
    """(word, mask) of the bits that occur twice or more among m."""
    twice = bit.groupBy("bit").agg(F.count("*").alias("n")).where("n >= 2")
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return twice.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("mask"))


def repeated_only(rows: DataFrame, key: str, bitmap: DataFrame, m: int) -> DataFrame:
    """The rows whose key (a bigint) has its bit in the bitmap: all that occur twice or more, and few others."""
    small = F.broadcast(bitmap)  # at most m / 64 <= 2**21 rows
    held = rows.join(small, F.expr(f"pmod({key}, {m}) div 64 = word"))
    return held.where(f"(shiftright(mask, cast(pmod({key}, {m}) % 64 as int)) & 1L) = 1").select(rows.columns)


def repeated_flag(rows: DataFrame, key: str, bitmap: DataFrame, m: int, flag: str) -> DataFrame:
    """rows with a boolean: whether the key (a bigint) has its bit in the bitmap."""
    small = F.broadcast(bitmap.select(F.col("word").alias("__word"), F.col("mask").alias("__mask")))  # at most m / 64 <= 2**21 rows
    held = rows.join(small, F.expr(f"pmod({key}, {m}) div 64 = __word"), "left")
    set_ = F.expr(f"(shiftright(__mask, cast(pmod({key}, {m}) % 64 as int)) & 1L) = 1")
    return held.withColumn(flag, F.coalesce(set_, F.lit(False))).drop("__word", "__mask")


def bitmap_bits(n_rows: int) -> int:
    """16 to 32 bits a row, within the broadcast bound; beyond it more rows shuffle, results stay exact."""
    return max(MIN_BITS, min(MAX_BITS, 1 << (16 * max(1, n_rows)).bit_length()))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; one row out for each row in.

    Texts are equal when identical after replacing each run of ASCII white space by one space; null is
    equal to the empty text. Of equal texts the row with the smallest doc_id stays. A null doc_id is
    larger than any other. Of rows with equal text and equal doc_id one stays. Columns of docs that
    are named like an output column are replaced. An empty table gives an empty table.
    """
    docs = docs.drop(*OUT).withColumn("text_sha256", digest(F.col("text")))
    prints = materialize(docs.select("doc_id", "text_sha256"), "digests")
    m = bitmap_bits(prints.count())
    # every caller of _maybe probes the same table, whose rows are bounded by m / 64
    bitmap = materialize(repeated_bits(prints, m), "bloom")
    counted = _maybe(prints, bitmap, m).where("__maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("__n"))
    groups = counted.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.sum("__n").alias("group_size"),
        F.max(F.when(F.col("doc_id").isNull(), F.col("__n"))).alias("__nulls"), F.min_by("__n", "doc_id").alias("__least"))
    groups = materialize(groups, "groups")
    tagged = _maybe(docs, bitmap, m)
    alone = tagged.where("not __maybe").drop("__maybe").select(
        "*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    met = tagged.where("__maybe").drop("__maybe").join(groups, "text_sha256").withColumn("kept", F.expr("doc_id <=> keep_id"))
    ties = F.expr("kept and coalesce(if(keep_id is null, __nulls, __least), 1) > 1")
    # equal text and equal doc_id: one of the rows, by a number that each row gets as it is stored
    tied = materialize(met.where(ties).withColumn("__at", F.monotonically_increasing_id()), "ties")
    first = tied.groupBy("text_sha256").agg(F.min("__at").alias("__first"))
    tied = tied.join(first, "text_sha256").withColumn("kept", F.col("__at") == F.col("__first"))
    cols = [c for c in alone.columns if c not in OUT] + list(OUT)
    return alone.select(cols).unionByName(met.where(~ties).select(cols)).unionByName(tied.select(cols))


def _maybe(rows: DataFrame, bitmap: DataFrame, m: int) -> DataFrame:
    """rows with __maybe: whether all bits of the digest are in the bitmap."""
    small = F.broadcast(bitmap)  # at most m / 64 <= 2**21 rows
    held = F.lit(True)
    for k, bit in enumerate(_bits(F.col("text_sha256"), m)):
        side = small.select(F.col("word").alias(f"__w{k}"), F.col("mask").alias(f"__m{k}"))
        rows = rows.withColumn(f"__b{k}", bit).join(side, F.expr(f"__b{k} div 64 = __w{k}"), "left")
        held = held & F.coalesce(F.expr(f"shiftright(__m{k}, cast(__b{k} % 64 as int)) & 1L") == 1, F.lit(False))
    return rows.withColumn("__maybe", held).drop(*[f"__{x}{k}" for k in range(HASHES) for x in "bwm"])
