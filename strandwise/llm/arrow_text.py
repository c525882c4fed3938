"""Whole Arrow batches of text as numpy arrays: word spans, word hashes, window hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Text of a chunk: numpy's intermediate arrays take some fifty times as much.
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODE = mix(np.arange(1, 257, dtype=U64))


@lru_cache(4)
def _powers(size: int, base: int) -> np.ndarray:
    p = np.full(size, base, U64)
    p[0] = 1
    return np.cumprod(p)


def powers(n: int, base: U64) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), int(base))[:n]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    off -= off[0]
    if col.null_count:  # a null's range may hold bytes
        n = np.where(np.asarray(col.is_valid()), np.diff(off), 0)
        if n.sum() != off[-1]:
            return utf8(col.fill_null(""))
    return buf, off


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about limit bytes of the column, at least one row each."""
    for rb in batches:
        if not rb.num_rows:
            continue
        off = utf8(rb.column(column))[1]
        a = 0
        while a < rb.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield rb.slice(a, b - a)
            a = b


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the byte spans of words; words first[i]:first[i + 1] are row i's."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ws = space[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = True, ws[:-1]
    before[off[:-1][off[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ws[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~ws & before), np.flatnonzero(~ws & after) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes (a polynomial over random byte codes, then mixed with the length)."""
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_CODE[buf] * powers(len(buf), _BASE), out=total[1:])
    h = (total[end] - total[start]) * powers(len(buf), _INVERSE)[start]
    return mix(h ^ (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ok): of the k words from each word on; ok where they are of one row."""
    n = len(h)
    if n < k:
        return np.zeros(n, U64), np.zeros(n, bool)
    g = np.zeros(n, U64)
    for j in range(k):
        g[: n - k + 1] = g[: n - k + 1] * _BASE + h[j : n - k + 1 + j]
    row_end = np.repeat(first[1:], np.diff(first))
    return mix(g), np.arange(n) + k <= row_end


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column: counts[i] of the values for row i."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values) if kind is None else pa.array(values, kind))


def slices(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, .. for each (start, count), one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def sequence_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run h[start:end] of word hashes."""
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h) * powers(len(h), _BASE), out=total[1:])
    return mix((total[end] - total[start]) * powers(len(h) + 1, _INVERSE)[start] ^ (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def column(rb: pa.RecordBatch, name: str) -> pa.Array:
    return rb.column(rb.schema.get_field_index(name))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of arrays, cast to the schema where they are numpy's."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)
