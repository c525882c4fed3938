"""A spectrum that grows as variants arrive: micro-batches merge into a stored table, and a batch that comes twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.spectrum import KEY
from ..sources.tables import merge, stored

#: What a carried variant is named by: an alignment shows a five-tuple in a sample once, however often it arrives.
CARRIED = ["sample_id", *KEY, "alignment_id"]


def carried(links: DataFrame, variants: DataFrame) -> DataFrame:
    return links.select("sample_id", "alignment_id").join(variants, "alignment_id").select(*CARRIED, "variant_id")


def merge_batch(path: str, batch: DataFrame) -> None:
    """Put a batch of carried variants into the table at path; the least variant_id of a key stays, as the merge of equal keys leaves it."""
    merge(path, batch.select(*CARRIED, "variant_id"), CARRIED, ["variant_id"], first=True)


def grow_spectrum(variants: DataFrame, links: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes all that a stream of variants now has, joins it with the stored links, and merges it batch by batch.

    The stream's checkpoint remembers which files were taken; a batch that is repeated after a failure merges to the same table.
    """
    joined = carried(links, variants)
    write = joined.writeStream.foreachBatch(lambda batch, _: merge_batch(path, batch))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown_spectrum(spark, path: str) -> DataFrame:
    """The spectrum of what has arrived: as variant_spectrum of all of it."""
    rows = stored(spark, path)
    if rows is None:
        raise ValueError(f"nothing has arrived at {path}")
    return rows.groupBy("sample_id", *KEY).agg(F.count("*").alias("n_alignments"), F.min("variant_id").alias("first_variant"))
