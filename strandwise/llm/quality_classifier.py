"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters, of digits or of other marks. Each has a bucket by hash, and each bucket a sparse random
index vector; its context vector sums the index vectors of tokens up to two places away, over all documents. A
document pools the unit context vectors of its tokens, and of its distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from . import network
from .language_id import held_out
from .store import materialize

BUCKET_BITS, DIM, NONZERO, REACH = 13, 32, 4, 2
#: Labelled rows that the network is fitted to, at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
#: Byte classes: 0 ends a token, 1 letters (and all beyond ASCII), 2 digits, 3 other marks.
CLASS = np.full(256, 3, np.uint8)
CLASS[:33] = 0
CLASS[127] = 0
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[48:58] = 2


def _tokens(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): those of row i are first[i]:first[i + 1]."""
    buf, off = A.utf8(A.column(rb, "text"))
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = CLASS[buf]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    word = kind[start] > 0
    start, end = start[word], end[word]
    return (A.span_hashes(buf, start, end) >> A.U64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(start, off)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the NONZERO entries of each bucket's index vector."""
    h = A.mix(np.arange((1 << BUCKET_BITS) * NONZERO, dtype=A.U64) + A.U64(77)).reshape(-1, NONZERO)
    return (h % A.U64(DIM)).astype(np.int64), np.where(h >> A.U64(63), 1.0, -1.0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of each bucket, from every text; 2**BUCKET_BITS rows at most reach the driver."""
    schema = pa.schema([("bucket", pa.int32()), *[(f"v{d}", pa.float64()) for d in range(DIM)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors()
        size = (1 << BUCKET_BITS) * DIM
        total = np.zeros(size)
        for rb in A.chunks(batches, "text"):
            b, first = _tokens(rb)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for d in range(1, REACH + 1):
                ok = np.flatnonzero(row[d:] == row[:-d])
                x, y = b[ok], b[ok + d]
                for p, q in ((x, y), (y, x)):
                    for r in range(NONZERO):
                        total += np.bincount(p * DIM + places[q, r], weights=signs[q, r], minlength=size)
        total = total.reshape(-1, DIM)
        at = np.flatnonzero(np.any(total != 0, 1))
        if len(at):
            yield A.batch(schema, at, *total[at].T)

    parts = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"v{d} double" for d in range(DIM)))
    sums = parts.groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)]).toPandas()
    out = np.zeros((1 << BUCKET_BITS, DIM))
    out[sums["bucket"].to_numpy(np.int64)] = sums.drop(columns="bucket").to_numpy()
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features): means over tokens and over distinct tokens, the share of distinct tokens and the length's log."""
    id_type = A.arrow_schema(docs.schema).field("doc_id").type
    schema = pa.schema([("doc_id", id_type), ("features", pa.list_(pa.float32()))])

    def mean(b: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        out = np.zeros((len(n), DIM), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(vectors[b], first[some], axis=0) / n[some, None]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            b, first = _tokens(rb)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            key = np.sort((row << BUCKET_BITS) | b)
            new = np.flatnonzero(np.diff(key, prepend=-1))
            distinct = np.searchsorted(key[new] >> BUCKET_BITS, np.arange(len(n) + 1))
            share = np.diff(distinct) / np.maximum(n, 1)
            x = np.hstack([mean(b, first), mean(key[new] & ((1 << BUCKET_BITS) - 1), distinct), np.log1p(n)[:, None], share[:, None]]).astype(np.float32)
            yield A.batch(schema, A.column(rb, "doc_id"), A.ragged(x.ravel(), np.full(len(x), x.shape[1])))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, features array<float>")


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; the label's rows that are held out are never read.

    Null and empty texts have zero features, and a score. Rows without a label, or with a null one, teach nothing; of several labels of a
    doc_id the greater counts, of several texts the one with the least features. Without labels of both kinds every score is the
    labels' mean, 0.5 without any. Repeated rows get equal scores, a score of exactly one half predicts 1, whole
    texts count however long, and other columns of docs and labels are not read. An empty table gives an empty table.
    """
    features = materialize(pooled(docs, word_vectors(docs)), "features")
    taught = labels.where(~held_out(3, 1) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(SAMPLE)
    sample = features.join(F.broadcast(taught), "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features"))
    sample = sample.select("features", "y").toPandas()  # SAMPLE rows at most, however often a doc_id repeats
    sample = sample.iloc[np.lexsort([sample["y"], sample["features"].map(lambda v: float(np.sum(v)))])] if len(sample) else sample
    x = np.array(sample["features"].tolist(), float).reshape(len(sample), 2 * DIM + 2)
    model = network.fit(x, sample["y"].to_numpy(float))
    schema = pa.schema([A.arrow_schema(features.schema).field("doc_id"), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                f = np.asarray(rb.column(1).flatten(), float).reshape(rb.num_rows, -1)
                yield A.batch(schema, rb.column(0), network.probability(model, f))

    out = features.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
