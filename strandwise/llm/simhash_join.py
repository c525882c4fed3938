"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into three blocks of 22, 21 and 21; the code words of the binary Golay code of 23 bits are the anchors of
a block (its missing bits are zero). The code is perfect: each word is within COVER bits of exactly one anchor, its home. Two
fingerprints within THRESHOLD bits differ by at most THRESHOLD * k // 3 bits in some k of the blocks, so one of them visits the
other's home if each goes to every anchor within COVER plus that many bits. Per anchor, those at home are held against
all that visit. Anchors of one block are 4,096; from PAIRED_FROM fingerprints on those of two blocks together, 2**24, keep them small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .components import components
from .store import leaving, materialize

WIDTH, SEED, THRESHOLD = 4, 42, 4
#: Blocks of the fingerprint: (first bit, bits).
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: The Golay code: word length, bits of a syndrome, generator polynomial, covering radius.
LENGTH, CHECKS, GENERATOR, COVER = 23, 11, 0b110001110101, 3
#: Fingerprints from which anchors are pairs of blocks; either way finds all links.
PAIRED_FROM = 1 << 24
#: Rows of each kind that meet at a time; larger anchors are cut into squares of so many.
SIDE = 4096
#: Shingles hashed and pairs compared at a time.
STEP = 1 << 16
PAIRS = 1 << 21


def shingle_spans(rb: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row): the words of each row lower-cased and joined by single spaces, and the byte spans of its shingles."""
    buf, off = A.utf8(A.column(rb, "text"))
    buf = A.LOWER[buf]
    start, end, first = A.spans(buf, off)
    keep = ~A.SPACE[buf]
    after = end[end < len(buf)]
    after = after[A.SPACE[buf[after]]]
    keep[after] = True
    buf[after] = 32
    at = np.cumsum(keep) - 1
    n_words = np.diff(first)
    counts = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(counts)), counts)
    word = A.slices(first[:-1], counts)
    last = np.minimum(word + WIDTH, first[row + 1]) - 1
    return buf[keep].tobytes(), at[start[word]], at[end[last] - 1] + 1, row


def fingerprints(rb: pa.RecordBatch) -> np.ndarray:
    """A fingerprint for each row: the bits set in over half of its shingles' hashes."""
    import xxhash

    data, start, end, row = shingle_spans(rb)
    ones, total = np.zeros((rb.num_rows, 64), np.int64), np.bincount(row, minlength=rb.num_rows)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(row), STEP):
        h = np.array([digest(data[x:y], SEED) for x, y in zip(start[a : a + STEP].tolist(), end[a : a + STEP].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = row[a : a + STEP]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ones[part[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint as a bigint."""
    schema = A.arrow_schema(docs.select("doc_id").schema).append(pa.field("fp", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            yield A.batch(schema, A.column(rb, "doc_id"), fingerprints(rb).view(np.int64))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of each word of LENGTH bits by the generator polynomial."""
    x = x.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - CHECKS), 0)
    return x


@lru_cache(2)
def error_lists(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(errors, weights, first): all words of up to `most` bits by their syndrome; those of syndrome s are first[s]:first[s + 1].

    A word's anchors within `most` bits are the word with each error of its syndrome taken off.
    """
    words = np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(LENGTH), k)], np.int64)
    s = syndrome(words)
    order = np.argsort(s, kind="stable")
    return words[order], np.bitwise_count(words[order]).astype(np.int64), np.searchsorted(s[order], np.arange((1 << CHECKS) + 1))


def anchors(fp: np.ndarray, blocks: tuple[int, ...], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the anchors in these blocks that each fingerprint visits, and whether it is at home there."""
    errors, weights, first = error_lists(COVER + limit)
    row, cell, beyond = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    for b in blocks:
        low, bits = BLOCKS[b]
        x = (fp[row] >> A.U64(low)).astype(np.int64) & ((1 << bits) - 1)
        s = syndrome(x)
        n = first[s + 1] - first[s]
        at, up = A.slices(first[s], n), np.repeat(np.arange(len(row)), n)
        over = beyond[up] + np.maximum(weights[at] - COVER, 0)
        ok = over <= limit
        at, up = at[ok], up[ok]
        row, cell, beyond = row[up], (cell[up] << LENGTH) | (x[up] ^ errors[at]), over[ok]
    return row, cell, beyond == 0


def visits(nodes: DataFrame, width: int) -> DataFrame:
    """(cell, fp, home): each fingerprint once for each anchor it visits, and once more for its homes."""
    chosen = list(combinations(range(len(BLOCKS)), width))
    limit = THRESHOLD * width // len(BLOCKS)
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a in range(0, rb.num_rows, STEP >> 4):
                fp = np.asarray(A.column(rb, "fp").slice(a, STEP >> 4)).view(A.U64)
                for k, blocks in enumerate(chosen):
                    row, cell, home = anchors(fp, blocks, limit)
                    row, cell = (np.concatenate([v, v[home]]) for v in (row, cell | (k << 2 * LENGTH)))
                    yield A.batch(schema, cell, fp.view(np.int64)[row], np.arange(len(row)) >= len(home))

    return nodes.select("fp").mapInArrow(run, "cell bigint, fp bigint, home boolean")


def squares(rows: DataFrame) -> DataFrame:
    """rows (cell, fp, home) dealt so that all at home meet all that visit, in squares (cell, x, y) of about SIDE by SIDE."""
    size = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where(F.greatest("homes", "guests") > SIDE)
    size = materialize(size.selectExpr("cell", f"cast(ceil(homes / {SIDE}) as int) as nx", f"cast(ceil(guests / {SIDE}) as int) as ny"), "large")
    if size.isEmpty():
        return rows.withColumns({"x": F.lit(0), "y": F.lit(0)})
    rows = rows.join(size, "cell", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("nx", "ny")})
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("ny")).otherwise(F.col("nx")) - 1)))
    return rows.select("cell", "fp", "home", F.when(F.col("home"), own("nx")).otherwise(F.col("other")).alias("x"), F.when(F.col("home"), F.col("other")).otherwise(own("ny")).alias("y"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links (a, b) join, one for each node but the least of its group."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[u], label[v])
        now = label.copy()
        for end in (u, v, label[u], label[v]):
            np.minimum.at(now, end, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    own = np.flatnonzero(label != np.arange(len(node)))
    return node[label[own]], node[own]


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (cell, x, y, home, fp) that come sorted; a square that a batch leaves open waits for the next."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, x, y = (t.column(c).to_numpy() for c in ("cell", "x", "y"))
        fp, home = t.column("fp").to_numpy().view(A.U64), t.column("home").to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)]))
        square = np.cumsum(np.bincount(new, minlength=len(cell))) - 1
        guest = np.flatnonzero(~home)
        n = np.bincount(square[guest], minlength=len(new))
        first = np.cumsum(n) - n  # guests of each square
        host = np.flatnonzero(home & (n[square] > 0))
        total = np.cumsum(n[square[host]])
        done = 0
        while done < len(host):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
            some = host[done:upto]
            a = np.repeat(fp[some], n[square[some]])
            b = fp[guest[A.slices(first[square[some]], n[square[some]])]]
            near = (a != b) & (np.bitwise_count(a ^ b) <= THRESHOLD)
            if near.any():
                u, v = forest(a[near].view(np.int64), b[near].view(np.int64))
                yield A.batch(schema, u, v)
            done = upto

    held: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        t = pa.Table.from_batches([*held, rb])
        last = np.ones(len(t), bool)
        for c in ("cell", "x", "y"):
            v = t.column(c).to_numpy()
            last &= v == v[-1]
        cut = int(np.argmax(last)) if last[-1] else len(t)
        if cut:
            yield from links(t.slice(0, cut))
        held = t.slice(cut).to_batches()
    if held:
        yield from links(pa.Table.from_batches(held))


def near_links(nodes: DataFrame, width: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of nodes: they join exactly those that are joined by steps of THRESHOLD bits or fewer."""
    if width is None:
        width = 1 if nodes.count() < PAIRED_FROM else 2
    rows = materialize(visits(nodes, width), "visits")
    # a square has about SIDE rows of each kind, whatever the group
    dealt = squares(rows).repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "home")
    return dealt.mapInArrow(compared, "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, width: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Words are runs of anything but ASCII white space with A-Z lower-cased. Of the 4-word shingles, repeats included (a shorter text: its words as
    one), a fingerprint has the bits set in over half of their XXH64; null, empty and blank texts have fingerprint zero, and link like any
    other. component_id is the smallest doc_id reached; null doc_ids are passed over, and a row that reaches nothing but
    nulls has null. Equal rows get equal results; rows that share a doc_id are each placed by their own text. Whole texts
    count, however long. Other columns of docs are not read. An empty table gives an empty table.
    """
    with leaving(docs.sparkSession) as kept:
        rows = materialize(fingerprint_table(docs), "fingerprints")
        nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
        links = materialize(near_links(nodes, width), "links")
        member = components(links).withColumnRenamed("node", "fp")
        placed = materialize(nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
        least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = materialize(placed.join(least, "component").select("fp", "component_id"), "named")
        kept += [rows, named]
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
