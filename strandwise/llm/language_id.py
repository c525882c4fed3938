"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, the first
rolled by two places and the second by one; a document bundles (adds) the vectors of its trigrams; a language's prototype
bundles its documents' unit vectors. A document gets the language with the largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import arrow_text as A

DIM, SEED = 512, 20
UNKNOWN = "und"
#: Cells of a block of documents by trigrams.
CELLS = 1 << 21


@lru_cache(1)
def letter_symbols() -> np.ndarray:
    """For each code point 0 (no letter) or 1 + its lower-case letter's code modulo 255."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = 1 + ord(low[0]) % 255
    table[0x30000:0x323B0] = 1 + np.arange(0x30000, 0x323B0) % 255  # ideographs
    return table


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    """256 vectors of +1 and -1; that of symbol 0 stands for a word's edge."""
    bits = A.mix(np.arange(256 * DIM, dtype=A.U64) + A.U64(SEED) * A.U64(1 << 32)) & A.U64(1)
    return (bits.astype(np.int8) * 2 - 1).reshape(256, DIM)


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    v = letter_vectors()
    return (np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]).astype(np.float32)


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """One bundle for each text; zeros if it has no letter."""
    n = np.array([len(t or "") for t in texts], np.int64)
    code = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    sym = letter_symbols()[code]
    stay = np.ones(len(sym), bool)
    stay[1:] = (sym[1:] != 0) | (sym[:-1] != 0)  # runs of what isn't a letter are one edge
    row = np.repeat(np.arange(len(n)), n + 1)[: len(sym)][stay]
    sym = np.concatenate([[0], sym[stay], [0]]).astype(np.uint8)
    present = np.flatnonzero(np.bincount(sym, minlength=256))
    local = np.zeros(256, np.int64)
    local[present] = np.arange(len(present))
    k, s = len(present), local[sym]
    middle = np.flatnonzero(sym[1:-1])
    g = (s[:-2][middle] * k + s[1:-1][middle]) * k + s[2:][middle]
    there = np.flatnonzero(np.bincount(g, minlength=1))
    index = np.zeros(k**3, np.int32)
    index[there] = np.arange(len(there))
    g, row = index[g], row[middle]
    m = trigram_vectors(present[there // (k * k)], present[there // k % k], present[there % k])
    out = np.zeros((len(n), DIM), np.float32)
    step = max(1, CELLS // max(1, len(there)))
    for i in range(0, len(n), step):
        rows = min(step, len(n) - i)
        a, b = np.searchsorted(row, (i, i + rows))
        counts = np.bincount((row[a:b] - i) * len(there) + g[a:b], minlength=rows * len(there))
        out[i : i + rows] = counts.reshape(rows, len(there)).astype(np.float32) @ m
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-12)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text has that remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from the rows of docs whose lang isn't null."""
    schema = pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.float64()))])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rb in A.chunks(batches, "text"):
            v = _unit(document_vectors(A.column(rb, "text").to_pylist()))
            langs = np.array(A.column(rb, "lang").to_pylist(), object)
            for x in set(langs.tolist()):
                sums[x] = sums.get(x, 0) + v[langs == x].sum(0)
        if sums:
            yield A.batch(schema, list(sums), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())))

    parts = docs.where("lang is not null").select("text", "lang").mapInArrow(bundle, "lang string, bundle array<double>")
    cells = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("cells")).orderBy("lang").collect()  # DIM numbers a language
    return [r["lang"] for r in rows], _unit(np.array([[c["v"] for c in r["cells"]] for r in rows]).reshape(len(rows), DIM))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (the cosine, at least 0). Null texts and texts without letters, or a model without
    languages, give UNKNOWN and 0; of equal cosines the first language wins. Columns of those names are replaced."""
    langs, prototypes = model
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            v = document_vectors(A.column(rb, "text").to_pylist())
            some = np.any(v != 0, 1) & bool(langs)
            cos = _unit(v) @ prototypes.T if langs else np.zeros((len(v), 1))
            best = np.argmax(cos, 1)
            pred = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(pred), pa.array(score)], names=[*rb.schema.names, "lang_pred", "score"])



    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double"))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows that aren't held out, for every row."""
    model = fit(docs.where(~held_out(4, 2)))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
