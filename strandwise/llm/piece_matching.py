"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

A batch's distinct units (a run of spaces and what follows up to the next) are concatenated and their suffixes are
sorted. Every piece is found by binary search, as a range of suffixes; the ranges give edges (position, length,
piece), sorted by position. Positions that no edge spans are borders. The edges between borders are relaxed in lock-step: in each round the
best-scored edge that joins two neighbouring symbols (the leftmost of equals) is taken, as the model's merges ask.
Characters without a piece become bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import arrow_text as A
from .unit_coding import Known, coded

SPACE = "▁"
#: Units that are indexed together.
BLOCK_BYTES = 300_000
NONE = np.int64(1) << 62


class Pieces:
    """The pieces of a BPE model with byte fallback, a dummy prefix and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not (byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.bytes = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.bytes[int(names[i][3:5], 16)] = i
        self.single = {ord(names[i]): i for i in plain if len(names[i]) == 1}
        many = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: names[i])
        self.ids = np.array(many, np.int64)
        self.length = np.array([len(names[i]) for i in many], np.int64)
        self.longest = int(self.length.max(initial=1))
        self.codes = np.zeros((len(many), self.longest), np.int64)
        for k, i in enumerate(many):
            self.codes[k, : len(names[i])] = [ord(c) for c in names[i]]
        out = [bytes([int(x[3:5], 16)]) if b else b"" if sp.is_control(i) else x.replace(SPACE, " ").encode() for i, (x, b) in enumerate(zip(names, byte, strict=True))]
        self.out_start = np.cumsum([0, *map(len, out)])
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, id) of every occurrence of a piece of two or more characters, by position and length."""
        n = len(code)
        values, rank = np.unique(code, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        at = np.arange(n)
        depth = 1
        while True:  # ranks by the first 1, 3, 9, .. characters
            base = int(rank.max(initial=0)) + 1
            if depth >= self.longest:
                break
            key = rank.copy()
            if base < 1 << 21:
                for j in (1, 2):
                    key = key * base + np.where(at + j * depth < n, rank[np.minimum(at + j * depth, n - 1)], 0)
                depth *= 3
            else:
                key = key * base + np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)], 0)
                depth *= 2
            order = np.argsort(key, kind="stable")
            new = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
            rank[order] = np.cumsum(new)
        suffix = order if depth > 1 else np.argsort(rank, kind="stable")
        padded = np.append(code, np.full(self.longest, -1))
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n)
        for j in range(self.longest):
            live = np.flatnonzero((self.length > j) & (lo < hi))
            want = self.codes[live, j]
            a, b = self._bound(suffix, padded, j, want, lo[live], hi[live]), self._bound(suffix, padded, j, want + 1, lo[live], hi[live])
            lo[live], hi[live] = a, b
        count = hi - lo
        pos = suffix[A.slices(lo, count)]
        size, ids = np.repeat(self.length, count), np.repeat(self.ids, count)
        by = np.argsort(pos * 64 + size)
        return pos[by], size[by], ids[by]

    @staticmethod
    def _bound(suffix, code, j, want, lo, hi):
        """The first row of lo:hi whose character j is want or more."""
        lo, hi = lo.copy(), hi.copy()
        while len(act := np.flatnonzero(lo < hi)):
            mid = (lo[act] + hi[act]) >> 1
            less = code[suffix[mid] + j] < want[act]
            lo[act[less]] = mid[less] + 1
            hi[act[~less]] = mid[~less]
        return lo

    def segment(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, id) of the symbols that the merges leave; id -1 where a character has no piece."""
        n = len(code)
        pos, size, ids = self.edges(code)
        key = pos * 64 + size
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, pos + 1, 1)
        np.add.at(cover, pos + size, -1)
        part = np.cumsum(np.cumsum(cover[:n]) == 0) - 1  # parts between borders
        width, left = np.ones(n, np.int64), np.arange(n) - 1
        symbol = np.full(n, -1, np.int64)
        best = np.full(n, NONE)  # rank and position of the merge of the symbol here with the next
        two = np.flatnonzero(size == 2)
        best[pos[two]] = (self.rank[ids[two]] << 32) | pos[two]

        def look(s: np.ndarray) -> np.ndarray:
            """The merge of the symbol at s with the next one."""
            nxt = s + width[s]
            total = width[s] + np.where(nxt < n, width[np.minimum(nxt, n - 1)], 64)
            k = np.searchsorted(key, s * 64 + np.minimum(total, 63))
            k = np.minimum(k, len(key) - 1)
            ok = (total <= self.longest) & (key[k] == s * 64 + total)
            return np.where(ok, (self.rank[ids[k]] << 32) | s, NONE)

        live = np.flatnonzero(np.isin(part, part[pos])) if len(pos) else np.zeros(0, np.int64)
        while len(live):
            head = np.flatnonzero(np.diff(part[live], prepend=-1))
            pick = np.minimum.reduceat(best[live], head)
            pick = pick[pick < NONE]
            if not len(pick):
                break
            s = pick & ((1 << 32) - 1)
            nxt = s + width[s]
            total = width[s] + width[nxt]
            symbol[s] = ids[np.searchsorted(key, s * 64 + total)]
            width[s], width[nxt], best[nxt] = total, 0, NONE
            after = s + total
            inside = after < n
            left[after[inside]] = s[inside]
            best[s] = look(s)
            before = left[s]
            ok = (before >= 0) & (part[np.maximum(before, 0)] == part[s])
            best[before[ok]] = look(before[ok])
            going = np.zeros(part[-1] + 1, bool)
            going[part[s]] = True
            live = live[going[part[live]] & (width[live] > 0)]
        start = np.flatnonzero(width > 0)
        one = start[width[start] == 1]
        chars, inverse = np.unique(code[one], return_inverse=True)
        symbol[one] = np.array([self.single.get(int(c), -1) for c in chars], np.int64)[inverse] if len(one) else 0
        return start, symbol[start]

    def encode(self, units: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        block: list[bytes] = []
        size = 0
        for u in [*units, None]:
            if block and (u is None or size + len(u) > BLOCK_BYTES):
                out += self._encode(block)
                block, size = [], 0
            if u is not None:
                block.append(u)
                size += len(u)
        return out

    def _encode(self, units: list[bytes]) -> list[bytes]:
        texts = [u.decode().replace(" ", SPACE) for u in units]
        n = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        code = np.full(len(flat) + len(n), 0x110000, np.int64)  # a border after each unit
        begin = np.cumsum(n + 1) - n - 1
        code[A.slices(begin, n)] = flat
        start, symbol = self.segment(code)
        keep = code[start] != 0x110000
        start, symbol = start[keep], symbol[keep]
        odd = np.flatnonzero(symbol < 0)
        spell = [list(chr(int(c)).encode()) for c in code[start[odd]]]
        counts = np.ones(len(symbol), np.int64)
        counts[odd] = [len(x) for x in spell]
        ids = np.repeat(symbol, counts)
        if len(odd):
            to = np.cumsum(counts) - counts
            ids[A.slices(to[odd], counts[odd])] = self.bytes[np.concatenate([np.array(x) for x in spell])]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, np.append(begin, len(code)))] * 2
        data = ids.astype("<u2" if len(self.rank) <= 1 << 16 else "<u4").tobytes()
        ends = (ends if len(self.rank) <= 1 << 16 else ends * 2).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of each row's text: its pieces' bytes without the first, which is the dummy prefix."""
        n = self.out_start[ids + 1] - self.out_start[ids]
        data = self.out_bytes[A.slices(self.out_start[ids], n)]
        off = np.concatenate([[0], np.cumsum(n)])[first]
        some = off[1:] > off[:-1]
        stay = np.ones(len(data), bool)
        stay[off[:-1][some]] = False
        return data[stay], off - np.concatenate([[0], np.cumsum(some)])


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def _known(path: str) -> Known:
    """The units a worker remembers, from one task to the next."""
    return Known("<u2" if len(pieces(path).rank) <= 1 << 16 else "<u4")


def units_of(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, first) of the units, after a space is put before each text that isn't empty."""
    text = A.column(rb, "text")
    buf, off = A.utf8(text)
    mark = SPACE.encode()
    if len(buf) and np.any((buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2])):  # the model takes it for a space
        buf, off = A.utf8(pc.replace_substring(text.fill_null(""), SPACE, " "))
    some = np.flatnonzero(np.diff(off))
    buf = np.insert(buf, off[some], 32)
    off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
    space = buf == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[off[:-1][some]] = True
    start = np.flatnonzero(begin)
    return buf, start, np.append(start[1:], len(buf))[: len(start)], np.searchsorted(start, off)


def _rows(path: str, what: str, id_type: pa.DataType | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        dtype = "<u2" if len(model.rank) <= 1 << 16 else "<u4"
        for rb, ids, first in coded(batches, units_of, model.encode, dtype, _known(path)):
            n = np.diff(first)
            if what == "ids":
                made = A.ragged(ids.astype(np.int32), n)
                yield pa.RecordBatch.from_arrays([*rb.columns, made], names=[*rb.schema.names, "piece_ids"])
                continue
            data, off = model.decode(ids.astype(np.int64), first)
            buf, at = A.utf8(A.column(rb, "text"))
            same = [data[a:b].tobytes() == buf[c:d].tobytes() for a, b, c, d in zip(off[:-1].tolist(), off[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            schema = pa.schema([("doc_id", id_type), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
            yield A.batch(schema, A.column(rb, "doc_id"), n, crc, same)

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs with piece_ids, an array<int>; null and empty texts have none. A column of that name is replaced.

    The ids are those of the model's own library. Decoding gives the text again, but for U+2581, which the model takes for a space.
    """
    docs = docs.drop("piece_ids")
    return docs.mapInArrow(_rows(model, "ids", None), StructType([*docs.schema.fields, StructField("piece_ids", ArrayType(IntegerType()))]))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows with `decoded`, the text of piece_ids; null ids give the empty text. A column of that name is replaced."""
    rows = rows.drop("decoded")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for rb in batches:
            col = A.column(rb, "piece_ids")
            col = col.fill_null([]) if col.null_count else col
            first = col.offsets.to_numpy().astype(np.int64)
            data, off = table.decode(np.asarray(col.flatten()).astype(np.int64), first - first[0])
            text = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(text, pa.string())], names=[*rb.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip) of each row: its ids are decoded again and held against the text."""
    id_type = A.arrow_schema(docs.schema).field("doc_id").type
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces bigint, ids_crc32 bigint, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(_rows(model, "digests", id_type), out)
