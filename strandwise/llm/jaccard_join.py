"""N-gram Jaccard join by vertical partitioning.

Shingles have one global order: rare ones by hash, then frequent ones by hash. A document's prefix in that
order must share a shingle with that of any document it links with. The order is cut into fragments at fixed
pivots; for candidate pairs the overlap is counted in each fragment by itself and summed per pair.

Only connectivity is asked for, so pairs within a group are not all made: each prefix shingle ties its
documents to one hub (as many pairs as rows). Shingles whose documents are still in two or more components do so
again with other hubs, and in the end have their remaining pairs across components counted too. No link between components is lost.
Before any tokens are shipped, a pair is held against its sets' parity bitmaps: bits that differ are at most as many as
shingles that differ, so pairs with too many of them can't link. Postings carry a sketch of 512 bits, the bitmap folded;
the whole bitmap is joined once to each distinct pair that is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrow_text as A
from .bloom_dedup import bitmap_bits, repeated_bits_of, repeated_flag
from .components import components
from .store import discard, materialize, settle

WIDTH = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 3, 4
#: Slots of the frequency sketch, and the counts from which a slot is of level 1, 2 and 3 of the order.
SLOT_BITS, LEVELS = 22, (12, 64, 1024)
#: Fragments: the level and three bits of hash.
FRAGMENT_BITS = 5
#: Words of 64 bits of a node's sketch.
SKETCH = 8
#: A posting carries so many of its node's tokens before it; a pair that shares one of them has met there.
EARLIER = 4
#: Parts in which the postings of rare shingles are shuffled.
PARTS = 2
#: Rounds in which each shingle that still spans components ties its documents to another hub, chosen by hash.
HUB_ROUNDS = 2
#: Rounds in which each component's likeliest pair is counted before all pairs that are left.
LIKELIEST_ROUNDS = 2


def _shingles(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of all shingles with repeats; those of row i are first[i]:first[i + 1]."""
    buf, off = A.utf8(A.column(rb, "text"))
    buf = A.LOWER[buf]
    start, end, first = A.spans(buf, off)
    h = A.span_hashes(buf, start, end)
    g, ok = A.windows(h, first, WIDTH)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    whole = A.sequence_hashes(h, first[short], first[short + 1])
    ok[first[short]] = True
    g[first[short]] = whole
    counts = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    return g[ok], np.concatenate([[0], np.cumsum(counts)])


def _sets(rb: pa.RecordBatch, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): distinct tokens of each row in the global order; the top two bits are the shingle's level."""
    g, first = _shingles(rb)
    tok = (g >> A.U64(2)) | (level[g >> A.U64(64 - SLOT_BITS)].astype(A.U64) << A.U64(62))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        tok[a:b].sort()
    new = np.ones(len(tok), bool)
    new[1:] = tok[1:] != tok[:-1]
    new[first[:-1][first[:-1] < len(tok)]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return tok[new], total[first]


def _spread(tok: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    s = np.zeros(len(tok) + 1, A.U64)
    np.cumsum(A.mix(tok ^ A.U64(salt)), out=s[1:])
    return s[first[1:]] - s[first[:-1]]


def _parities(tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts): of each row a bitmap of four to eight bits a token (512 at least), each the parity of the tokens hashed to it."""
    n = np.diff(first)
    counts = np.left_shift(1, np.ceil(np.log2(np.maximum(n / 16, SKETCH))).astype(np.int64))
    at = np.repeat(np.cumsum(counts) - counts, n)
    h = A.mix(tok ^ A.U64(3))
    words = np.zeros(int(counts.sum()), A.U64)
    np.bitwise_xor.at(words, at + (h >> A.U64(6)).astype(np.int64) % np.repeat(counts, n), A.U64(1) << (h & A.U64(63)))
    return words, counts


def _folded(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bitmaps folded to SKETCH words each, one row each."""
    out = np.zeros((len(counts), SKETCH), A.U64)
    within = A.slices(np.zeros(len(counts), np.int64), counts) % SKETCH
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(counts)), counts), within), words)
    return out


def _halved(bits: Column) -> Column:
    """The bitmap of half the size: words that fall together are added without carry."""
    k = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, 1, k), F.slice(bits, k + 1, k), lambda x, y: x.bitwiseXOR(y))


def fewest_differences(a: Column, b: Column) -> Column:
    """A lower bound of the shingles that only one of two sets has, from bitmaps whose sizes differ by a factor of two at most."""
    longer = lambda x, y: F.when(F.size(x) > F.size(y), _halved(x)).otherwise(x)
    odd = F.zip_with(longer(a, b), longer(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(odd, F.lit(0), lambda total, x: total + x)


def _few(least: Column) -> Column:
    """Whether sets of na and nb shingles that differ in so many can link."""
    return least * (DEN + NUM) <= (F.col("na") + F.col("nb")) * (DEN - NUM)


def _similar() -> Column:
    """Whether the sizes and sketches of a pair (na, s0a, .., nb, s0b, ..) let it link."""
    odd = sum((F.bit_count(F.col(f"s{k}a").bitwiseXOR(F.col(f"s{k}b"))) for k in range(SKETCH)), F.lit(0))
    return (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM) & _few(odd)


def with_sides(pairs: DataFrame, nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pairs (a, b) with columns of both nodes: {"n_shingles": "n"} gives na and nb.

    Plain sort-merge joins of stored tables, which AQE splits at a hub; the hint makes small tables go the same way.
    """
    for k in "ab":
        side = nodes.select(F.col("node").alias(k), *[F.col(c).alias(f"{name}{k}") for c, name in columns.items()])
        pairs = pairs.join(side.hint("merge"), k)
    return pairs


#: What a pair carries of each side from its parity test to the count of its overlap.
SIDES = {"n_shingles": "n", "h1": "h1", "h2": "h2", "first_id": "id"}


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and parity bitmaps let link, with SIDES of both and least, the differences that the bitmaps show."""
    both = with_sides(pairs, nodes, {**SIDES, "parity": "bits"})
    both = both.where(F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)
    both = both.withColumn("least", fewest_differences(F.col("bitsa"), F.col("bitsb"))).drop("bitsa", "bitsb")
    return both.where(_few(F.col("least")))


def slot_levels(docs: DataFrame) -> np.ndarray:
    """The level of each slot of the sketch: how frequent its shingles are, 0 for most.

    A task passes on the slots in which it has counted clearly more than an even share. Levels only move
    shingles to the end of the order; results don't depend on them.
    """
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int32)
        for rb in A.chunks(batches, "text"):
            g, _ = _shingles(rb)
            slot, n = np.unique((g >> A.U64(64 - SLOT_BITS)).astype(np.int32), return_counts=True)
            total[slot] += n.astype(np.int32)
        mean = total.sum(dtype=np.int64) / len(total)
        at = np.flatnonzero(total >= 2 + mean + 4 * mean**0.5)
        if len(at):
            yield A.batch(schema, at, total[at])

    sums = docs.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    over = sums.where(F.col("n") >= LEVELS[0]).toPandas()  # at most 2**SLOT_BITS rows
    level = np.zeros(1 << SLOT_BITS, np.uint8)
    level[over["slot"].to_numpy(np.int64)] = np.searchsorted(LEVELS, over["n"].to_numpy(np.int64), "right")
    return level


def _digests(level: Broadcast, id_type: pa.DataType):
    sketch = [(f"s{k}", pa.int64()) for k in range(SKETCH)]
    schema = pa.schema([
        ("doc_id", id_type), ("tie", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
        *sketch, ("parity", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            tok, first = _sets(rb, level.value)
            n = np.diff(first)
            keep = np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)
            pre = tok[A.slices(first[:-1], keep)]
            words, counts = _parities(tok, first)
            short = _folded(words, counts).view(np.int64)
            h1, h2 = (_spread(tok, first, s).view(np.int64) for s in (1, 2))
            yield A.batch(
                schema, A.column(rb, "doc_id"), A.column(rb, "tie"), n, h1, h2, *np.ascontiguousarray(short.T),
                A.ragged(words.view(np.int64), counts), A.ragged(pre.view(np.int64), keep),
            )

    return run


def _fragments(level: Broadcast):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("fragment", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            tok, first = _sets(rb, level.value)
            h1, h2 = (_spread(tok, first, s).view(np.int64) for s in (1, 2))
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            key = (row << FRAGMENT_BITS) | (tok >> A.U64(64 - FRAGMENT_BITS)).astype(np.int64)
            at = np.flatnonzero(np.diff(key, prepend=-1))
            if len(at):
                r = key[at] >> FRAGMENT_BITS
                yield A.batch(schema, h1[r], h2[r], key[at] & ((1 << FRAGMENT_BITS) - 1), A.ragged(tok.view(np.int64), np.diff(at, append=len(tok))))

    return run


def verified(pairs: DataFrame, docs: DataFrame, level: Broadcast) -> DataFrame:
    """Those of the stored near_pairs that link: partial overlaps by fragment, summed per pair; their components (ca, cb) stay with them.

    The texts of the pairs' documents are read again and their sets cut into fragments; pairs meet them fragment by
    fragment, each side in turn. All joins are plain sort-merge joins, which AQE splits at a hub.
    """
    keys = ["a", "b", "ca", "cb", "na", "nb"]
    pairs = pairs.select(*keys, *[f"{c}{k}" for c in ("h1", "h2", "id") for k in "ab"])
    ids = pairs.select(F.explode(F.array("ida", "idb")).alias("__id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_fragments(level), "h1 bigint, h2 bigint, fragment int, tokens array<bigint>"), "sets")
    left = pairs.join(sets.withColumnsRenamed({"h1": "h1a", "h2": "h2a", "tokens": "ta"}), ["h1a", "h2a"])
    both = left.join(sets.withColumnsRenamed({"h1": "h1b", "h2": "h2b", "tokens": "tb"}), ["h1b", "h2b", "fragment"])
    part = both.select(*keys, "fragment", F.size(F.array_intersect("ta", "tb")).alias("overlap"))
    part = part.groupBy(*keys, "fragment").agg(F.max("overlap").alias("overlap"))  # equal rows have equal sets
    total = part.groupBy(*keys).agg(F.sum("overlap").alias("overlap"))
    enough = F.col("overlap") * (DEN + NUM) >= (F.col("na") + F.col("nb")) * NUM
    links = materialize(total.where(enough).select("a", "b", "ca", "cb"), "links")
    discard(sets)
    return links


def distinct_sets(wide: DataFrame) -> DataFrame:
    """The rows of digests with shingles, those of equal sets as one: node, first_id, n_shingles, h1, h2, s0.., parity, prefix.

    Rows whose hash has no double by the Bloom bitmap pass straight through; only the others are grouped.
    """
    wide = wide.where("n_shingles > 0").withColumn("first_id", F.col("doc_id")).drop("doc_id", "tie")
    m = bitmap_bits(wide.count())
    bitmap = materialize(repeated_bits_of(wide.select(F.pmod("h1", F.lit(m)).alias("bit")), m), "bloom")
    tried = repeated_flag(wide, "h1", bitmap, m, "again")
    rest = [c for c in wide.columns if c not in ("h1", "h2", "n_shingles", "first_id")]
    grouped = tried.where("again").groupBy("h1", "h2", "n_shingles").agg(F.min("first_id").alias("first_id"), F.first(F.struct(*rest)).alias("row"))
    grouped = materialize(grouped.select("h1", "h2", "n_shingles", "first_id", "row.*"), "grouped")
    return tried.where("not again").drop("again").unionByName(grouped)


def shared_posts(posts: DataFrame) -> list[DataFrame]:
    """The postings (token, node, n, at) whose token has two nodes or more, with their number (met) and the smallest (hub), as stored tables.

    Shingles of level 0 are rare: one shuffle brings the few nodes of each together, and a window counts them. The others may be in any
    share of all documents: they are counted with partial sums, and meet their counts in a join that AQE splits at a hot shingle.
    Rare ones go in PARTS by a part of their hash, one after the other: most are met once and end here, so that only one part of them lies in a shuffle at a time.
    """
    level = F.shiftrightunsigned("token", 62)
    same = Window.partitionBy("token")
    parts = []
    for k in range(PARTS):
        own = posts.where((level == 0) & (F.shiftrightunsigned("token", 32) % PARTS == k))
        parts.append(materialize(own.withColumn("hub", F.min("node").over(same)).withColumn("met", F.count("*").over(same)).where("met > 1"), "shared"))
        settle(posts.sparkSession)
    frequent = posts.where(level != 0)
    lists = materialize(frequent.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("met")).where("met > 1"), "lists")
    return [*parts, materialize(frequent.join(lists.hint("merge"), "token").select(parts[0].columns), "shared")]


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, tie) for each row of docs; tie is xxhash64 of the text.

    Words are runs of anything but ASCII white space with A-Z lower-cased; a set holds the distinct shingles of
    WIDTH words, or the whole sequence if shorter. Null, empty and blank texts have no shingles and are
    their own component. component_id is the smallest doc_id reached; null doc_ids are passed over, and a row that
    reaches nothing but nulls has null. Rows that share a doc_id but not a text are each placed by their own text;
    equal rows get equal results. Whole texts count, however long.
    Other columns of docs are not read. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    level = docs.sparkSession.sparkContext.broadcast(slot_levels(docs))  # 2**SLOT_BITS bytes
    id_type = A.arrow_schema(docs.schema).field("doc_id").type
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie bigint, n_shingles bigint, h1 bigint, h2 bigint"
    out += "".join(f", s{k} bigint" for k in range(SKETCH)) + ", parity array<bigint>, prefix array<bigint>"
    wide = docs.withColumn("tie", F.xxhash64("text")).mapInArrow(_digests(level, id_type), out)
    wide = materialize(wide.withColumn("node", F.monotonically_increasing_id()), "digests")
    rows = materialize(wide.select("doc_id", "tie", "n_shingles", "h1", "h2"), "rows")
    sets = distinct_sets(wide)
    posts = sets.select("node", F.col("n_shingles").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    parts = shared_posts(posts)
    shared = reduce(DataFrame.unionByName, parts)
    nodes = materialize(sets.drop("prefix"), "nodes")  # after the postings, whose shuffles are gone by now
    discard(wide)
    stars = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = tested_links(stars.withColumns({"ca": F.col("a"), "cb": F.col("b")}), nodes, docs, level)
    member = materialize(components(links), "member")
    crossed = crossing_links(shared, nodes, docs, level, member)
    discard(*parts)
    named = nodes.select("node", "h1", "h2", "first_id").join(member.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    if crossed is not None:
        named = moved(named, components(crossed))
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    named = materialize(named.select("h1", "h2", "component").join(least.hint("merge"), "component").select("h1", "h2", "component_id"), "placed")
    discard(nodes)
    full = rows.where("n_shingles > 0").join(named.hint("merge"), ["h1", "h2"], "left").select("doc_id", "n_shingles", "component_id", "tie")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "tie"))


def tested_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, level: Broadcast) -> DataFrame:
    """Those of the distinct pairs (a, b, ca, cb) that link: by sketch, then by parity bitmap, then by fragments."""
    pairs = materialize(pairs, "stars")
    sketch = {"n_shingles": "n"} | {f"s{k}": f"s{k}" for k in range(SKETCH)}
    alike = with_sides(pairs, nodes, sketch).where(_similar()).select("a", "b", "ca", "cb")
    near = materialize(near_pairs(alike, nodes), "near")
    links = verified(near, docs, level)
    discard(pairs, near)
    return links


def _enough() -> Column:
    """Whether what two sets can still share from a shingle at ia and ib on lets them link, if it is their first."""
    return (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (DEN + NUM)) >= (F.col("na") + F.col("nb")) * NUM


def moved(rows: DataFrame, joined: DataFrame, component: str = "component") -> DataFrame:
    """rows with their component replaced by what it has become part of; joined is (node, component) of components."""
    to = joined.select(F.col("node").alias(component), F.col("component").alias("__to"))
    return rows.join(to.hint("merge"), component, "left").withColumn(component, F.coalesce("__to", component)).drop("__to")


def spanning(placed: DataFrame) -> DataFrame:
    """The postings of shingles whose nodes are of two or more components."""
    placed = materialize(placed, "placed")
    split = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    out = materialize(placed.join(split.hint("merge"), "token", "left_semi"), "spanning")
    discard(placed)
    return out


def crossing_links(shared: DataFrame, nodes: DataFrame, docs: DataFrame, level: Broadcast, member: DataFrame) -> DataFrame | None:
    """Links (a, b) between components, such that with them none between two components is left out; None if there is nothing to meet.

    First rounds of other hubs: they join what is close to several of a group, in as many pairs as rows.
    Then pairs meet at the shingles whose nodes are of two or more components, not at each but at those without another
    shared one close before. A posting carries its component, its place, a sketch of fixed size and the EARLIER tokens
    before it, no more. The likeliest pair of each component is counted first: most other pairs
    are then within one. What is left is all counted.
    Between rounds only the new links' components are joined, not all links again: a and b of the result name components,
    each by its smallest node.
    """
    shared = shared.where("met > 2").select("token", "node", "n", "at", "hub")
    shared = shared.join(member.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    found: DataFrame | None = None

    def grown(links: DataFrame) -> DataFrame:
        new = links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        return new if found is None else found.unionByName(new)

    side = {"node": "", "component": "c", "n": "n", "at": "i"}
    for salt in range(HUB_ROUNDS):
        shared = spanning(shared)
        if shared.isEmpty():
            return found
        row = F.struct(*[F.col(c).alias(f"{to}b") for c, to in side.items()])
        hubs = shared.groupBy("token").agg(F.min_by(row, F.xxhash64("node", "token", F.lit(salt))).alias("with")).select("token", "with.*")
        rows = shared.select("token", *[F.col(c).alias(f"{to}a") for c, to in side.items()])
        size = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM
        stars = rows.join(hubs.hint("merge"), "token").where((F.col("ca") != F.col("cb")) & size & _enough())
        ends = (F.struct(F.col(k).alias("x"), F.col(f"c{k}").alias("c")) for k in "ab")
        stars = stars.select(F.array_sort(F.array(*ends)).alias("e")).select(
            F.expr("e[0].x").alias("a"), F.expr("e[1].x").alias("b"), F.expr("e[0].c").alias("ca"), F.expr("e[1].c").alias("cb")
        )
        links = tested_links(stars.distinct(), nodes, docs, level)
        if not links.isEmpty():
            found = grown(links)
            shared = moved(shared, components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    shared = spanning(shared)
    if shared.isEmpty():
        return found
    sketch = [f"s{k}" for k in range(SKETCH)]
    open_ = shared.join(nodes.select("node", *sketch).hint("merge"), "node")
    order = Window.partitionBy("node").orderBy("at")  # the prefix of one document
    open_ = open_.withColumn("earlier", F.array_compact(F.array(*[F.lag("token", k).over(order) for k in range(1, EARLIER + 1)])))
    open_ = materialize(open_, "open")
    x, y = (
        open_.select("token", "hub", *[F.col(c).alias(f"{to}{k}") for c, to in {**side, "earlier": "e", **{s: s for s in sketch}}.items()])
        for k in "ab"
    )
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    first = ~F.arrays_overlap("ea", "eb")  # where a is the hub of an earlier shared token, the pair has been a star's
    meet = (x.token == y.token) & apart & _enough() & _similar() & first
    met = x.where("a <> hub").join(y.drop("hub").hint("merge"), meet).select("a", "b", "ca", "cb").distinct()
    met = materialize(met, "met")
    discard(open_)
    rest = materialize(near_pairs(met, nodes), "rest")
    discard(met)
    for k in range(LIKELIEST_ROUNDS + 1):
        if rest.isEmpty():
            break
        tried = rest
        if k < LIKELIEST_ROUNDS:
            ends = rest.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("least", "a", "b").alias("rank"), F.struct(*rest.columns).alias("pair"))
            tried = materialize(ends.groupBy("c").agg(F.min_by("pair", "rank").alias("pair")).select("pair.*").distinct(), "tried")
        links = verified(tried, docs, level)
        found = grown(links)
        if k < LIKELIEST_ROUNDS:
            joined = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            rest = rest.join(tried.select("a", "b"), ["a", "b"], "left_anti")
            rest = materialize(moved(moved(rest, joined, "ca"), joined, "cb").where("ca <> cb"), "rest")
    return found


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each component left: the one whose doc_id names it, with all of its equal rows.

    Rows without shingles are linked with nothing and stay, as do rows that reach only null doc_ids.
    """
    named = jaccard_components(docs).where("component_id is not null and not (doc_id <=> component_id)")
    gone = materialize(named.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).distinct(), "dropped")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tie")), "left_anti")
