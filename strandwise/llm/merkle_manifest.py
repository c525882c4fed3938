"""Merkle dataset manifest by a block engine.

Leaves are numbered within their source and cut into buckets of ARITY**LEVELS consecutive ones, aligned so that a bucket is a whole
subtree. An executor hands each bucket to DuckDB as an Arrow table: a query of ordered string_agg and sha256 builds all of the
bucket's levels, its root and each leaf's siblings. Bucket roots are the leaves of the next round, until each source has
one root; sources are then numbered and go the same way. Spark joins a bucket's outer path to its leaves, and folds them up.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .ranking import ranked
from .store import leaving, materialize

ARITY, LEVELS = 3, 6
#: Leaves of a bucket: what a task holds at a time.
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def _field(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of a row's fields, each with its length; `changed` replaces a field's value."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c).cast("string"))) for c in FIELDS]), 256)


def depth(n: int) -> int:
    """Levels above n nodes."""
    k, span = 0, 1
    while span < n:
        k, span = k + 1, span * ARITY
    return k


@lru_cache(32)
def level_query(levels: int) -> str:
    """DuckDB: for each node (i, h) of table `bucket`, its columns, its siblings left and right of it level by level, and the bucket's root."""
    tables = ["n0 AS MATERIALIZED (SELECT i - min(i) OVER () AS i, h FROM bucket)"]
    tables += [
        f"n{k + 1} AS MATERIALIZED (SELECT i // {ARITY} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM n{k} GROUP BY i // {ARITY})" for k in range(levels)
    ]
    run = f"PARTITION BY i // {ARITY} ORDER BY i ROWS BETWEEN"
    tables += [
        f"s{k} AS MATERIALIZED (SELECT i, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
        f" coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{k})"
        for k in range(levels)
    ]
    path = ", ".join(f"{{'l': s{k}.l, 'r': s{k}.r}}" for k in range(levels))
    joins = " ".join(f"JOIN s{k} ON s{k}.i = (b.i - o.least) // {ARITY**k}" for k in range(levels))
    return f"""WITH {", ".join(tables)}
SELECT b.*, [{path}] AS path, n{levels}.h AS top FROM bucket b CROSS JOIN (SELECT min(i) AS least FROM bucket) o {joins} CROSS JOIN n{levels}"""


@lru_cache(1)
def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def levels(nodes: DataFrame) -> DataFrame:
    """nodes (grp, i, n, h and more) with path, the siblings of each level within the bucket, and top, the bucket's root."""
    out = A.arrow_schema(nodes.schema).append(pa.field("path", pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))).append(pa.field("top", pa.string()))

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        k = min(LEVELS, depth(n))  # a bucket of a larger tree climbs all its levels, even with a single node
        if k == 0:
            return table.append_column("path", pa.array([[]] * len(table), out.field("path").type)).append_column("top", table.column("h")).cast(out)
        con = _engine()
        con.register("bucket", table)
        got = con.sql(level_query(k)).to_arrow_table()
        con.unregister("bucket")
        return got.select(out.names).cast(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + f", path {PATH}, top string"
    return nodes.groupBy("grp", F.expr(f"i div {SPAN}")).applyInArrow(run, schema)


def climb(nodes: DataFrame) -> DataFrame:
    """(grp, i, path, root) for nodes (grp, i, n, h): each node's path to its group's root. Rounds end when each group has one node."""
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return nodes.select("grp", "i", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("h").alias("root"))
    inner = materialize(levels(nodes.select("grp", "i", "n", "h")), "levels")
    outer = climb(tops(inner)).withColumnsRenamed({"i": "bucket", "path": "rest"})
    both = inner.withColumn("bucket", F.expr(f"i div {SPAN}")).join(outer, ["grp", "bucket"])
    return both.select("grp", "i", F.concat("path", "rest").alias("path"), "root")


def tops(inner: DataFrame) -> DataFrame:
    """The roots of buckets as nodes of the next round."""
    return inner.where(f"i % {SPAN} = 0").select("grp", F.expr(f"i div {SPAN}").alias("i"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("top").alias("h"))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def merkle_manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified): one row for each row of docs.

    docs has doc_id, source, lang, n_chars and text; other columns are not read. Leaves ascend by doc_id within their source,
    nulls first; rows of one doc_id by their digest, and equal rows have equal digests, so their order is without effect on any
    root. A null source is a source of its own and comes first. `altered`, where given, is the digest with which a row is
    verified instead of its leaf (null: the leaf). Null fields and empty ones have different digests. Whole texts count,
    however long. An empty table gives an empty table.
    """
    leaves = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("grp"), leaf_digest().alias("h"),
                         (F.lit(None) if altered is None else altered).cast("string").alias("altered"))
    with leaving(docs.sparkSession) as kept:
        inner = materialize(levels(ranked(leaves, "grp", ["doc_id", "h", "altered"], "leaves")), "buckets")
        outer = materialize(climb(tops(inner)), "subtrees")
        subroots = outer.where("i = 0").select("grp", F.lit("").alias("all"), F.col("root").alias("h"))
        subroots = materialize(ranked(subroots, "all", ["grp"], "sources"), "subroots")
        above = climb(subroots.select(F.col("all").alias("grp"), "i", "n", "h")).select("i", F.col("path").alias("above"), "root")
        above = subroots.select("grp", "i", F.col("h").alias("subroot")).join(above, "i").drop("i")
        outer = outer.select("grp", F.col("i").alias("bucket"), F.col("path").alias("rest")).join(above, "grp")
        outer = materialize(outer.select("grp", "bucket", "subroot", "root", F.concat("rest", "above").alias("rest")), "outer")
        kept += [inner, outer]
    both = inner.withColumn("bucket", F.expr(f"i div {SPAN}")).join(outer, ["grp", "bucket"])
    both = both.select("doc_id", "source", F.col("h").alias("leaf"), "subroot", "root", F.concat("path", "rest").alias("path"), "altered")
    both = both.withColumn("proof_sha256", F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256))
    both = both.withColumn("folded_root", folded(F.col("path"), F.coalesce("altered", "leaf")))
    return both.withColumn("verified", F.col("folded_root") == F.col("root")).drop("altered")


def tampered_leaf() -> Column:
    """The digest of a row whose text has lost its line breaks, where 2 divides the crc32 of its doc_id; else null, also for a null doc_id."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even, leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
