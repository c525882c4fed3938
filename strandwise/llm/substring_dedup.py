"""Substring dedup: windows of WINDOW words that also start earlier, by a compressed FM-index per shard.

Each document is cut into segments: runs of windows that share a minimizer (the least hash of GRAM words within
the window), so equal windows lie in segments with equal minimizers. Segments with equal words are one entry: all
of its occurrences but the first are removed whole. Entries that share their minimizer with others
are dealt by it to shards; a shard indexes its entries in an FM-index (suffix order, BWT in a wavelet matrix, ranks
by popcount), streams the entries through it by backward search, and reports windows with two or more
places, but for the first of them. The entries of a minimizer that has over HOT of them are dealt as single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .bloom_dedup import bitmap_bits, repeated_bits_of, repeated_only
from .store import discard, materialize

WINDOW, GRAM = 20, 8
#: Entries of one minimizer that are still dealt to one shard.
HOT = 200
#: Words of a shard, about.
SHARD_WORDS = 50_000
#: Entries that are searched, or cut out of texts, at once.
LANES, BLOCK = 8_192, 4_096


class FMIndex:
    """An FM-index of sequences of numbers >= 1, each ended by 0; suffixes are in order of their first 27 symbols.

    Backward search is right for patterns of up to 27 symbols. search() takes many patterns at once.
    """

    def __init__(self, seq: np.ndarray, depth: int = WINDOW):
        n = len(seq)
        self.n, self.depth = n, depth
        rank = seq.astype(np.int64)
        at = np.arange(n)
        ranks = []
        for step in (1, 3, 9):  # each round joins three ranks: 3, 9, 27 symbols
            base = int(rank.max(initial=0)) + 1
            key = rank.copy()
            for j in (1, 2):
                key = key * base + np.where(at + j * step < n, rank[np.minimum(at + j * step, n - 1)], 0) if base < 1 << 21 else self._pairs(key, rank, at, j * step, n)
            order = np.argsort(key, kind="stable")
            new = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            ranks.append(rank)
        self.suffix = order
        bwt = seq[order - 1]
        # rows whose first `depth` symbols are equal form a run: depth = 9 + 9 + (depth - 18)
        r9 = ranks[1]
        parts = [r9[np.minimum(order + d, n - 1)] for d in (0, 9, depth - 9)]
        new = np.zeros(n, bool)
        new[:1] = True
        for p in parts:
            new[1:] |= p[1:] != p[:-1]
        self.run = np.cumsum(new) - 1
        self.run_start = np.append(np.flatnonzero(new), n)
        sigma = int(seq.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bits, self.counts, self.zeros = [], [], []
        level = bwt.astype(np.int64)
        self.levels = max(1, sigma.bit_length())
        for b in range(self.levels - 1, -1, -1):  # a wavelet matrix
            bit = (level >> b) & 1
            pad = np.zeros((n >> 6) * 64 + 64, np.uint8)
            pad[:n] = bit
            words = np.packbits(pad, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    @staticmethod
    def _pairs(key, rank, at, step, n):
        both = np.stack([key, np.where(at + step < n, rank[np.minimum(at + step, n - 1)], 0)])
        return np.unique(both, axis=1, return_inverse=True)[1].reshape(-1).astype(np.int64)

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (A.U64(1) << (i & 63).astype(np.uint64)) - A.U64(1)
        return self.counts[level][w] + np.bitwise_count(self.bits[level][w] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs in the first i[k] symbols of the BWT."""
        lo, hi = np.zeros_like(i), i
        for level in range(self.levels):
            bit = (c >> (self.levels - 1 - level)) & 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            z = self.zeros[level]
            lo, hi = np.where(bit == 1, z + a, lo - a), np.where(bit == 1, z + b, hi - b)
        return hi - lo

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffix starts with c and then what the rows lo:hi start with."""
        return self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)

    def contract(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share their first `depth` symbols with row lo."""
        r = self.run[lo]
        return self.run_start[r], self.run_start[r + 1]

    def statistics(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) at each symbol of the texts symbols[start[k]:end[k]], read backward: how far what
        starts there occurs in the index, `depth` at most, and its rows. Symbols that aren't in the index match nothing."""
        length, lows, highs = (np.zeros(len(symbols), np.int64) for _ in range(3))
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        now = np.zeros(len(start), np.int64)
        for t in range(int((end - start).max(initial=0))):
            live = np.flatnonzero(end - t > start)
            at = end[live] - 1 - t
            full = now[live] >= self.depth
            l, h = lo[live], hi[live]
            l[full], h[full] = self.contract(l[full])
            now[live[full]] = self.depth
            c = symbols[at]
            l, h = self.extend(c, l, h)
            now[live] += 1
            gone = (h <= l) | (c == 0)
            l[gone], h[gone] = 0, self.n
            now[live[gone]] = 0
            lo[live], hi[live] = l, h
            over = now[live] > self.depth
            ll, hh = l.copy(), h.copy()
            ll[over], hh[over] = self.contract(l[over])
            length[at], lows[at], highs[at] = np.minimum(now[live], self.depth), ll, hh
        return length, lows, highs


def segments_of(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """row, start (in words of the row), n (words), anchor and seg (hashes) of each segment."""
    start, end, first = A.spans(buf, off)
    h = A.span_hashes(buf, start, end)
    n = len(h)
    g, _ = A.windows(h, first, GRAM)
    low = A.U64((1 << 24) - 1)
    m = (g & ~low) | np.arange(n, dtype=A.U64)  # ties: the leftmost
    reach, want = 1, WINDOW - GRAM + 1
    while reach < want:  # minima of windows of 2, 4, .. and then want grams
        step = min(reach, want - reach)
        if n > step:
            m[: n - step] = np.minimum(m[: n - step], m[step:])
        reach += step
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + WINDOW <= row_end)
    pick = (m[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)
    k = np.flatnonzero(new)
    a, b = at[k], at[np.append(k[1:], len(at)) - 1] + WINDOW if len(k) else at[:0]
    row = np.searchsorted(first, a, "right") - 1
    return {"row": row, "start": a - first[row], "n": b - a, "anchor": g[pick[k]].view(np.int64), "seg": A.sequence_hashes(h, a, b).view(np.int64)}


def _cut(id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("seg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            s = segments_of(*A.utf8(A.column(rb, "text")))
            if len(s["row"]):
                row = pa.array(s["row"])
                yield A.batch(schema, A.column(rb, "doc_id").take(row), A.column(rb, "tie").take(row), s["start"], s["n"], s["anchor"], s["seg"])

    return run


def _pick(id_type: pa.DataType):
    """Of the wanted segments: the words (as text), or each window's hash where the minimizer is hot."""
    schema = pa.schema([("doc_id", id_type), ("tie", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("words", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            buf, off = A.utf8(A.column(rb, "text"))
            start, end, first = A.spans(buf, off)
            h = A.span_hashes(buf, start, end)
            want = A.column(rb, "want")
            row = np.repeat(np.arange(rb.num_rows), np.diff(want.offsets.to_numpy()))
            flat = want.flatten()
            s0, n, key, hot = (np.asarray(flat.field(i)) for i in range(4))
            a = first[row] + s0
            colds = np.flatnonzero(~hot)
            for i in range(0, len(colds), BLOCK):
                cold = colds[i : i + BLOCK]
                # the words of each segment, one after the other with one space between
                words = A.slices(a[cold], n[cold])
                size = end[words] - start[words] + 1
                data = np.append(buf, np.uint8(32))[A.slices(start[words], size)]
                data[np.cumsum(size) - 1] = 32
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n[cold])])]
                text = pa.LargeStringArray.from_buffers(len(cold), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
                r = pa.array(row[cold])
                yield A.batch(schema, A.column(rb, "doc_id").take(r), A.column(rb, "tie").take(r), s0[cold], key[cold], text)
            warms = np.flatnonzero(hot)
            for i in range(0, len(warms), BLOCK):
                warm = warms[i : i + BLOCK]
                count = n[warm] - WINDOW + 1
                w = A.slices(a[warm], count)
                r = np.repeat(row[warm], count)
                taken = pa.array(r)
                none = pa.nulls(len(r), pa.large_string())
                yield A.batch(schema, A.column(rb, "doc_id").take(taken), A.column(rb, "tie").take(taken), w - first[r], A.sequence_hashes(h, w, w + WINDOW).view(np.int64), none)

    return run


def _search(table: pa.Table) -> pa.Table:
    """One shard: index its entries, stream them through, report windows that also start earlier."""
    schema = pa.schema([table.schema.field("doc_id"), ("tie", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
    table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("start", "ascending")]).combine_chunks()
    col = lambda c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
    ids, tie, s0 = col("doc_id"), col("tie"), np.asarray(col("start")).astype(np.int64)
    buf, off = A.utf8(col("words"))
    start, end, first = A.spans(buf, off)
    word = np.unique(A.span_hashes(buf, start, end), return_inverse=True)[1].astype(np.int64) + 1
    n = np.diff(first)
    seq = np.zeros(len(word) + len(n), np.int64)
    begin = first[:-1] + np.arange(len(n))
    seq[A.slices(begin, n)] = word
    fm = FMIndex(seq)
    length, lo, hi = (np.concatenate(x) for x in zip(*(_block(fm, seq, begin[i : i + LANES], n[i : i + LANES]) for i in range(0, len(n), LANES)), strict=True))
    entry = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(word)) - np.repeat(first[:-1], n)
    hit = np.flatnonzero((length >= WINDOW) & (hi - lo >= 2))
    # a repeated row of documents gives an entry twice: that is one place
    same = np.zeros(len(n), bool)
    if len(n) > 1:
        equal = lambda x: np.asarray(pc.equal(x.slice(1), x.slice(0, len(x) - 1)).fill_null(True)) & (np.asarray(x.slice(1).is_null()) == np.asarray(x.slice(0, len(x) - 1).is_null()))
        same[1:] = equal(ids) & equal(tie) & (s0[1:] == s0[:-1])
    hit = hit[~same[entry[hit]]]
    _, earliest = np.unique(lo[hit], return_index=True)  # hits are in order of document and start
    later = np.ones(len(hit), bool)
    later[earliest] = False
    at = hit[later]
    if not len(at):
        return schema.empty_table()
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (entry[at[1:]] != entry[at[:-1]])
    k = np.flatnonzero(new)
    last = at[np.append(k[1:], len(at)) - 1]
    e = entry[at[k]]
    a = s0[e] + offset[at[k]]
    b = s0[e] + offset[last] + WINDOW
    take = pa.array(e)
    return pa.table([ids.take(take), tie.take(take), pa.array(a, pa.int32()), pa.array(b, pa.int32())], schema=schema)


def _block(fm: FMIndex, seq: np.ndarray, begin: np.ndarray, n: np.ndarray):
    at = A.slices(begin, n)
    ends = np.cumsum(n)
    return fm.statistics(seq[at], ends - n, ends)


def _kept(id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string())])
    short = pa.schema([*list(schema)[:3], ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            buf, off = A.utf8(A.column(rb, "text"))
            start, end, first = A.spans(buf, off)
            gone = A.column(rb, "gone").fill_null([]) if A.column(rb, "gone").null_count else A.column(rb, "gone")
            row = np.repeat(np.arange(rb.num_rows), np.diff(gone.offsets.to_numpy()))
            flat = gone.flatten()
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, first[row] + np.asarray(flat.field(0)), 1)
            np.add.at(edge, first[row] + np.asarray(flat.field(1)), -1)
            stay = np.cumsum(edge[:-1]) == 0
            total = np.concatenate([[0], np.cumsum(stay)])
            n_kept = total[first[1:]] - total[first[:-1]]
            s, e = start[stay], end[stay]
            size = e - s + 1
            data = np.append(buf, np.uint8(32))[A.slices(s, size)]
            bytes_to = np.concatenate([[0], np.cumsum(size)])
            if len(size):
                data[bytes_to[1:] - 1] = 32
            cut = bytes_to[total[first]]
            view = memoryview(np.ascontiguousarray(data))
            parts = [view[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            n = np.diff(first)
            if texts:
                yield A.batch(schema, A.column(rb, "doc_id"), n, n - n_kept, pa.array([bytes(p).decode() for p in parts], pa.large_string()))
            else:
                yield A.batch(short, A.column(rb, "doc_id"), n, n - n_kept, pa.array([hashlib.sha256(p).hexdigest() for p in parts]))

    return run


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, a, b): spans of words a:b to remove; they may overlap. tie is xxhash64 of the text."""
    id_type = A.arrow_schema(docs.schema).field("doc_id").type
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    base = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie bigint"
    cut = f"{base}, start int, n int, anchor bigint, seg bigint"
    rows = materialize(keyed.mapInArrow(_cut(id_type), cut), "segments")
    m = bitmap_bits(rows.count())
    bitmap = materialize(repeated_bits_of(rows.select(F.pmod("anchor", F.lit(m)).alias("bit")), m), "bloom")
    some = materialize(repeated_only(rows, "anchor", bitmap, m), "repeated")
    discard(rows)
    place = F.struct("doc_id", "tie", "start")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *[F.col(c) for c in ("doc_id", "tie", "start")])
    entries = some.groupBy("anchor", "seg", "n").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    entries = materialize(entries.select("anchor", "seg", "n", "copies", *[F.col(f"first.{c}").alias(c) for c in ("doc_id", "tie", "start")]), "entries")
    again = entries.where("copies > 1").select("anchor", "seg", "n", F.struct("doc_id", "tie", "start").alias("__first"))
    copies = some.join(again, ["anchor", "seg", "n"]).where(~place.eqNullSafe(F.col("__first"))).select("doc_id", "tie", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    ties = entries.groupBy("anchor").agg(F.count("*").alias("entries")).where("entries > 1")
    met = materialize(entries.join(ties, "anchor"), "met")
    want = met.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n", "anchor", (F.col("entries") > HOT).alias("hot"))).alias("want"))
    want = want.withColumnsRenamed({"doc_id": "__id", "tie": "__tie"})
    words = met.where(F.col("entries") <= HOT).agg(F.sum("n")).first()[0] or 0
    found = keyed.join(want, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie"))).select("doc_id", "tie", "text", "want")
    found = materialize(found.mapInArrow(_pick(id_type), f"{base}, start int, key bigint, words string"), "found")
    shards = max(1, -(-words // SHARD_WORDS))
    searched = found.where("words is not null").select("doc_id", "tie", "start", "words", F.expr(f"pmod(xxhash64(key), {shards})").alias("shard"))
    searched = searched.groupBy("shard").applyInArrow(lambda t: _search(t.drop_columns(["shard"])), f"{base}, a int, b int")
    single = found.where("words is null")
    firsts = materialize(single.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("key", F.struct(*[F.col(f"first.{c}").alias(c) for c in ("doc_id", "tie", "start")]).alias("__first")), "firsts")
    hot = single.join(firsts, "key").where(~place.eqNullSafe(F.col("__first"))).select("doc_id", "tie", F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b"))
    return copies.unionByName(searched).unionByName(hot)


def substring_dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row; with texts=False its SHA-256 as kept_sha256 instead.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of WINDOW words over it also
    starts earlier: in a row with a smaller doc_id, or earlier in the row. Null doc_ids come last. Rows that share
    a doc_id come in the order of a hash of their texts; equal rows are one document. Null and empty texts have
    no words. Other columns of docs are not read. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    id_type = A.arrow_schema(docs.schema).field("doc_id").type
    spans = removed_spans(docs).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    gone = materialize(spans.withColumnsRenamed({"doc_id": "__id", "tie": "__tie"}), "gone")
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left").select("doc_id", "text", "gone")
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, {'kept_text' if texts else 'kept_sha256'} string"
    run = _kept(id_type)
    return joined.mapInArrow(lambda it: run(it, texts), out)
