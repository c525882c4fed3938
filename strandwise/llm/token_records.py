"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of records: 8 bytes payload length, 4 bytes masked checksum of those 8, the payload, 4 bytes masked
checksum of the payload, and a newline byte (all numbers little-endian). The checksum is CRC-32, rotated
right by 15 bits and raised by MASK, so that a record within a record isn't taken for one. A payload is 1 byte
id width (2 or 4), 1 byte whether there is a doc_id, 8 bytes doc_id, then the ids. Files are written by
Spark's own text writer (each record is one line's bytes), so a lost executor's files are never half there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrow_text as A
from .store import materialize, new_path
from .unit_coding import Known, coded

MASK = 0xA282EAD8
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<BBq")
#: Bytes of text that go to one file, about. A file is read whole by one task.
FILE_TEXT_BYTES = 8 << 20
SEPARATOR = "<|startoftext|>"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = BODY.pack(ids.itemsize, doc_id is not None, doc_id or 0) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, payload length) of each record of a file, by its heads alone; each head's checksum is tested."""
    at, end = 0, len(data)
    while at < end:
        n, check = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"damaged record head at byte {at}")
        yield at, n
        at += HEAD.size + n + 5


def parse(data: bytes, at: int, n: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of the record at byte `at`; its checksum is tested."""
    payload = data[at + HEAD.size : at + HEAD.size + n]
    if masked(payload) != struct.unpack_from("<I", data, at + HEAD.size + n)[0]:
        raise ValueError(f"damaged record at byte {at}")
    width, known, doc_id = BODY.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=BODY.size)


@lru_cache(2)
def _encoder(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    sep = tok.token_to_id(SEPARATOR) if SEPARATOR in special else None
    return tok, width, sep, tuple(s.encode() for s in special)


def _word_encoder(path: str):
    """Encodes lists of white-space-delimited words. Right for a tokenizer whose normaliser and splitter treat white
    space as a border and give it no ids, which word_bpe_49k.json does; a special token joins the words of a call."""
    tok, width, sep, special = _encoder(path)

    def encode(words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        plain = [i for i, w in enumerate(words) if sep is not None and not any(s in w for s in special)]
        out: list[bytes] = [b""] * len(words)
        blocks = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        made = tok.encode_batch_fast([SEPARATOR.join(texts[i] for i in b) for b in blocks], add_special_tokens=False)
        for block, enc in zip(blocks, made, strict=True):
            ids = np.array(enc.ids, f"<u{width}")
            data, cut = ids.tobytes(), (np.flatnonzero(ids == sep) * width).tolist()
            for i, a, b in zip(block, [0, *(c + width for c in cut)], [*cut, len(data)], strict=True):
                out[i] = data[a:b]
        rest = sorted(set(range(len(words))) - set(plain))
        for i, enc in zip(rest, tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(enc.ids, f"<u{width}").tobytes()
        return out

    return encode, width


@lru_cache(2)
def _known(path: str) -> Known:
    """The words a worker remembers, from one task to the next."""
    return Known(f"<u{_encoder(path)[1]}")


def _heads(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """Offsets, payload lengths and token counts of a file's records."""
    at = list(frames(data))
    return [a for a, _ in at], [n for _, n in at], [(n - BODY.size) // data[a + HEAD.size] for a, n in at]


def _records(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = _word_encoder(path)

        def split(rb: pa.RecordBatch):
            buf, off = A.utf8(A.column(rb, "text"))
            return buf, *A.spans(buf, off)

        schema = pa.schema([("record", pa.binary())])
        end = np.array([end_id], f"<u{width}")
        for rb, ids, first in coded(batches, split, encode, f"<u{width}", _known(path)):
            rows = zip(A.column(rb, "doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)
            yield A.batch(schema, pa.array([frame(d, np.append(ids[a:b], end)) for d, a, b in rows], pa.binary()))

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text (null: empty), append end_id, and write records to path in ascending doc_id order.

    File part-k holds what comes after file part-(k - 1). doc_id is an integer or null; nulls come first, rows that
    share a doc_id come in the order of a hash of their texts. The offset index goes to path + "-index".
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // FILE_TEXT_BYTES))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    lines = ordered.mapInArrow(_records(tokenizer, end_id), "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)
    _index(docs.sparkSession, path).write.parquet(f"{path}-index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content")


def _index(spark: SparkSession, path: str) -> DataFrame:
    schema = pa.schema([("part", pa.int32()), ("position", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, content in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                at, size, n = _heads(data)
                yield A.batch(schema, [part] * len(at), range(len(at)), at, size, n)

    return _files(spark, path).mapInArrow(run, "part int, position bigint, offset bigint, length bigint, n_tokens bigint")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(part, position, doc_id, start_in_part, n_tokens, ids_crc32, ids): all records, checksums tested."""
    schema = pa.schema([("part", pa.int32()), ("position", pa.int64()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, content in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                at, seen = list(frames(data)), 0
                for i in range(0, len(at), 1000):
                    got = [parse(data, a, n) for a, n in at[i : i + 1000]]
                    n = np.array([len(x) for _, x in got], np.int64)
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in got]
                    flat = np.concatenate([x for _, x in got]).astype(np.int32)
                    yield A.batch(schema, [part] * len(got), range(i, i + len(got)), [d for d, _ in got], seen + np.cumsum(n) - n, n, crc, A.ragged(flat, n))
                    seen += int(n.sum())

    return _files(spark, path).mapInArrow(run, "part int, position bigint, doc_id bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(part, position, doc_id, ids, order): records met by the index alone, dealt out and sorted by a seeded hash."""
    index = read_index(spark, path).withColumn("order", F.xxhash64(F.lit(seed), "part", "position"))
    wanted = index.groupBy("part").agg(F.collect_list(F.struct("position", "offset", "length", "order")).alias("wanted"))  # the records of a file

    schema = pa.schema([("part", pa.int32()), ("position", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("order", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, content, wanted in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2).to_pylist(), strict=True):
                data = content.as_buffer().to_pybytes()
                got = [parse(data, w["offset"], w["length"]) for w in wanted]
                yield A.batch(schema, [part] * len(got), [w["position"] for w in wanted], [d for d, _ in got], pa.array([x.astype(np.int32) for _, x in got], pa.list_(pa.int32())), [w["order"] for w in wanted])

    met = _files(spark, path).join(wanted, "part")
    return met.mapInArrow(run, "part int, position bigint, doc_id bigint, ids array<int>, order bigint").repartition("order").sortWithinPartitions("order")


def record_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, from record files that are written and read back."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    write_records(docs, path, tokenizer, end_id)
    sums = read_index(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a file
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    got = read_records(spark, path).select("part", "doc_id", "start_in_part", "n_tokens", "ids_crc32")
    return materialize(got, "digests").join(base, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
