"""Trees from distances, their splits, support, comparison and clocks; a tree is a table of its nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import decimal_year

NODES = "node int, parent int, name string, length double, depth double, leaves array<string>"


def _closest(d: np.ndarray) -> tuple[int, int] | None:
    """The first pair with the least value in row order; not-a-numbers are passed over."""
    i, j = np.triu_indices(len(d), 1)
    values = d[i, j]
    if not (values < np.inf).any():
        known = np.flatnonzero(~np.isnan(values))
        return (int(i[known[0]]), int(j[known[0]])) if len(known) else None
    k = int(np.nanargmin(values))
    return int(i[k]), int(j[k])


def joined_nodes(d: np.ndarray, names: list[str], method: str) -> list[tuple]:
    """(node, parent, length) of the tree that joins the closest two again and again; the new node goes to the end of the matrix.

    upgma joins at half the distance, distances weigh with sizes; nj joins by distances less mean ones, the last two halve theirs.
    Lengths are 0 at least. What only not-a-numbers connect stays apart: the first part is the tree.
    """
    d, alive, sizes, heights = d.astype(float).copy(), list(range(len(names))), [1] * len(names), [0.0] * len(names)
    edges, new, least = [], len(names), 2 if method == "nj" else 1
    while len(alive) > least:
        m = len(alive)
        far = np.cumsum(np.where(np.isnan(d) | np.eye(m, dtype=bool), 0.0, d), axis=1)[:, -1] / max(m - 2, 1)
        pair = _closest(d - far[:, None] - far[None, :] if method == "nj" else d)
        if pair is None:
            break
        i, j = pair
        between = d[i, j]
        if method == "nj":
            lengths, row = ((between + far[i] - far[j]) / 2, (between + far[j] - far[i]) / 2), (d[:, i] + d[:, j] - between) / 2
        else:
            lengths, row = (between / 2 - heights[i], between / 2 - heights[j]), (sizes[i] * d[:, i] + sizes[j] * d[:, j]) / (sizes[i] + sizes[j])
        edges += [(alive[k], new, max(0.0, float(x))) for k, x in zip(pair, lengths, strict=True)]
        rest = [k for k in range(m) if k not in pair]
        d = np.block([[d[np.ix_(rest, rest)], row[rest, None]], [row[None, rest], np.zeros((1, 1))]])
        alive, sizes, heights = ([x[k] for k in rest] + [y] for x, y in ((alive, new), (sizes, sizes[i] + sizes[j]), (heights, between / 2)))
        new += 1
    if method == "nj" and len(alive) == 2:
        half = max(0.0, float(np.nan_to_num(d[0, 1])) / 2)
        edges += [(alive[0], new, half), (alive[1], new, half)]
        alive = [new]
    return [*edges, (alive[0], None, None)] if alive else []


def _table(edges: list[tuple], names: list[str]) -> pd.DataFrame:
    """The rows of NODES, from the root down; leaves are those below a node, sorted."""
    below: dict[int, list[int]] = {}
    for node, parent, _ in edges:
        below.setdefault(parent, []).append(node)
    length, rows, leaves = {n: x for n, _, x in edges}, [], {}
    reach = [(r, None, 0.0) for r in below.get(None, [])]
    for node, parent, depth in reach:  # grows while it is read: parents come before their children
        rows.append((node, parent, names[node] if node < len(names) else None, length[node], depth))
        reach += [(c, node, depth + length[c]) for c in below.get(node, [])]
    for node, *_ in reversed(rows):
        leaves[node] = sorted(([names[node]] if node < len(names) else []) + [x for c in below.get(node, []) for x in leaves[c]])
    out = pd.DataFrame(rows, columns=["node", "parent", "name", "length", "depth"]).astype({"node": "Int32", "parent": "Int32"})
    out["leaves"] = [leaves[n] for n in out["node"]]
    return out


def build_trees(distances: DataFrame, method: str = "nj") -> DataFrame:
    """(tree_id, NODES) of the trees over distances (tree_id, a, b, distance), each pair once or both ways, by nj or upgma.

    A tree is one task's work: its matrix is bounded by the cohort (200 samples). Names are the ids as text, in the order of the ids.
    Pairs without a distance, or null ones, are not-a-numbers. The root has no parent and no length.
    """
    t = distances.schema["tree_id"].dataType.simpleString()

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([rows["a"], rows["b"]]))
        d = np.full((len(ids), len(ids)), np.nan)
        a, b = (np.searchsorted(ids, rows[c]) for c in ("a", "b"))
        d[a, b] = d[b, a] = rows["distance"].astype(float)
        np.fill_diagonal(d, 0)
        out = _table(joined_nodes(d, names := [str(i) for i in ids], method), names)
        out.insert(0, "tree_id", rows["tree_id"].iloc[0])
        return out

    return distances.select("tree_id", "a", "b", "distance").groupBy("tree_id").applyInPandas(grow, f"tree_id {t}, {NODES}")


def newick(trees: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """(tree_id, newick): lengths with 6 digits, an inner node's support (tree_id, node, support) with none; the root has no length."""
    t = trees.schema["tree_id"].dataType.simpleString()
    full = trees.join(support.select("tree_id", "node", "support"), ["tree_id", "node"], "left") if support is not None else trees.withColumn("support", F.lit(None).cast("double"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("depth", kind="stable")
        texts: dict = {}
        for r in rows.sort_values("leaves", key=lambda s: s.str.len(), kind="stable").itertuples():
            inner = texts.pop(r.node, None)
            text = r.name if inner is None else f"({','.join(x for _, x in sorted(inner))})" + ("" if pd.isna(r.support) else f"{r.support:.0f}")
            if pd.isna(r.parent):
                return pd.DataFrame({"tree_id": [r.tree_id], "newick": [text + ";"]})
            texts.setdefault(int(r.parent), []).append((r.node, f"{text}:{r.length:.6f}"))

    return full.select("tree_id", "node", "parent", "name", "length", "depth", "leaves", "support").groupBy("tree_id").applyInPandas(write, f"tree_id {t}, newick string")


def splits(trees: DataFrame) -> DataFrame:
    """(tree_id, split, length) of each inner node below the root with two leaves or more on either side: the leaves that are
    not below it, and the longest of the lengths that give the same split."""
    whole = trees.where("parent is null").select("tree_id", F.col("leaves").alias("all"))
    inner = trees.where("parent is not null and name is null").join(whole, "tree_id").withColumn("split", F.array_sort(F.array_except("all", "leaves")))
    return inner.where("size(leaves) > 1 and size(split) > 1").groupBy("tree_id", "split").agg(F.max("length").alias("length"))


def compare_trees(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row for two trees over the same leaves or some common ones: rf, normalized_rf, matching and total splits, and weight_dist.

    Splits are cut to the common leaves; with fewer than three of these rf is -1, normalized_rf 1, and all else 0.
    weight_dist sums the differences of the lengths of the whole splits, over those of either tree.
    """
    leaf = lambda t: t.where("parent is null").select(F.explode("leaves").alias("name"))
    common = leaf(one).intersect(leaf(other)).agg(F.array_sort(F.collect_list("name")).alias("common"))  # one row, as long as a tree has leaves

    def cut(t: DataFrame, mark: str) -> DataFrame:
        s = splits(t).crossJoin(F.broadcast(common)).withColumn("in", F.array_sort(F.array_intersect("split", "common")))
        out = F.array_sort(F.array_except("common", "in"))  # the complement, as a split of the common leaves is stored again
        return s.where((F.size("in") > 1) & (F.size(out) > 1)).select(out.alias("s")).distinct().withColumn(mark, F.lit(1))

    both = cut(one, "x").join(cut(other, "y"), "s", "full").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "xy"], F.count_if(F.expr("x = 1 and y = 1")).alias("matching"))
    w = splits(one).select("split", F.col("length").alias("p")).join(splits(other).select("split", F.col("length").alias("q")), "split", "full")
    w = w.agg(F.coalesce(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), F.lit(0.0)).alias("w"))
    few = F.size("common") < 3
    rf = F.col("x") + F.col("y") - 2 * F.col("matching")
    row = both.crossJoin(F.broadcast(w)).crossJoin(F.broadcast(common))  # one row each
    return row.select(
        F.when(few, -1).otherwise(rf).alias("rf"),
        F.when(few, 1.0).when(F.col("x") + F.col("y") > 0, rf / (F.col("x") + F.col("y"))).otherwise(0.0).alias("normalized_rf"),
        F.when(few, 0).otherwise(F.col("matching")).alias("matching"), F.when(few, 0).otherwise(F.col("x")).alias("total"),
        F.when(few, 0.0).otherwise(F.col("w")).alias("weight_dist"),
    )


def inconsistent_branches(one: DataFrame, other: DataFrame) -> DataFrame:
    """(found_in, split_a, split_b): the splits of the common leaves that only one of two trees has, 'a' being one, 'b' other.

    split_a is the side that is stored of a split of one, and what it leaves of a split of other; split_b the other way. Sides are sorted.
    None with fewer than three common leaves.
    """
    leaf = lambda t: t.where("parent is null").select(F.explode("leaves").alias("name"))
    common = leaf(one).intersect(leaf(other)).agg(F.array_sort(F.collect_list("name")).alias("common")).where("size(common) >= 3")  # one row

    def cut(t: DataFrame, mark: str) -> DataFrame:
        s = splits(t).crossJoin(F.broadcast(common)).withColumn("in", F.array_sort(F.array_intersect("split", "common")))
        out = F.array_sort(F.array_except("common", "in"))
        return s.where((F.size("in") > 1) & (F.size(out) > 1)).select(out.alias("stored"), F.col("in").alias("rest")).distinct().withColumn(mark, F.lit(True))

    met = cut(one, "a").join(cut(other, "b"), ["stored", "rest"], "full").where("a is null or b is null")
    pick = lambda x, y: F.when(F.col("a").isNotNull(), F.col(x)).otherwise(F.col(y))
    return met.select(F.when(F.col("a").isNotNull(), "a").otherwise("b").alias("found_in"), pick("stored", "rest").alias("split_a"), pick("rest", "stored").alias("split_b"))


def kimura(n: Column, ti: Column, tv: Column) -> Column:
    """The two-parameter distance of n sites with ti transitions and tv transversions; not a number without sites."""
    p, q = ti / n, tv / n
    s, t = 1 - 2 * p - q, 1 - 2 * q
    d = F.when((s > 0) & (t > 0), -0.5 * F.log(s * F.sqrt(t))).when(q > 0, (p + q) * (1 + 0.5 * (p + q)) + p * p / (2 * q * q)).when(p < 1, -F.log(1 - p))
    return F.when(n == 0, F.lit(float("nan"))).otherwise(d.otherwise(F.lit(float("inf"))))


#: Positions of one stretch that numbers its sites, and draws that are made at a time.
STRETCH = 1 << 16


def drawn_sites(sites: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(site columns, drawn) of the sites that a replicate drew: the numbers of the replicates, as often as each drew it.

    sites: (ref_pos), with reference_id where there are several references. As many sites as there are, drawn with replacement: a draw is a hash of seed,
    replicate and place, so that a repeated task draws the same. Sites are numbered in order, by stretches of positions, not in one task.
    """
    site = [c for c in ("reference_id", "ref_pos") if c in sites.columns]
    stretch = [*site[:-1], "__stretch"]
    placed = sites.select(*site).distinct().withColumn("__stretch", F.floor(F.col("ref_pos") / STRETCH))
    sizes = placed.groupBy(*stretch).agg(F.count("*").alias("__size"))
    order = Window.partitionBy(F.lit(0)).orderBy(*stretch)  # a row for each stretch
    begins = sizes.select(*stretch, (F.sum("__size").over(order) - F.col("__size")).alias("__begin"))
    own = Window.partitionBy(*stretch).orderBy("ref_pos")
    numbered = placed.withColumn("__own", F.row_number().over(own) - 1).join(begins, stretch).select(*site, (F.col("__begin") + F.col("__own")).alias("at"))
    n = sizes.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("n")).where("n > 0")
    rounds = sites.sparkSession.range(replicates).select(F.col("id").cast("int").alias("tree_id"))
    parts = rounds.crossJoin(F.broadcast(n)).select("tree_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {STRETCH})")).alias("part"))
    parts = parts.repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree_id", "part")
    drawn = parts.select("tree_id", "n", F.explode(F.expr(f"sequence(part * {STRETCH} + 1, least((part + 1) * {STRETCH}, n))")).alias("k"))
    drawn = drawn.select("tree_id", F.pmod(F.xxhash64(F.lit(seed), "tree_id", "k"), F.col("n")).alias("at")).groupBy("at").agg(F.collect_list("tree_id").alias("drawn"))
    return numbered.join(drawn, "at").select(*site, "drawn")


def bootstrap_distances(differences: DataFrame, pairs: DataFrame, sites: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(tree_id, a, b, distance) of each replicate, tree_id being its number: as many sites as there are, drawn with replacement.

    differences: (a, b, ref_pos, kind), transition or transversion, of the sites where a pair differs; pairs: all (a, b);
    sites: (ref_pos); both with reference_id where there are several references. A site brings the replicates that drew it to its
    differences, and only sums by pair go on; for all pairs of a cohort, cohort.bootstrap_k2p gives the same without a table of differences.
    """
    site = [c for c in ("reference_id", "ref_pos") if c in sites.columns]
    n = sites.select(*site).distinct().agg(F.count("*").alias("n"))
    rounds = sites.sparkSession.range(replicates).select(F.col("id").cast("int").alias("tree_id"))
    weighed = differences.join(drawn_sites(sites, replicates, seed), site).withColumn("tree_id", F.explode("drawn"))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    sums = weighed.groupBy("tree_id", "a", "b").agg(of("transition").alias("ti"), of("transversion").alias("tv"))
    all_ = pairs.select("a", "b").crossJoin(rounds).crossJoin(F.broadcast(n)).join(sums, ["tree_id", "a", "b"], "left")  # replicates x the pairs asked for
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_.select("tree_id", "a", "b", kimura(F.col("n"), zero("ti"), zero("tv")).alias("distance"))


def support(tree: DataFrame, replicates: DataFrame, n: int) -> DataFrame:
    """(tree_id, node, support): the share of the n replicates' trees, in per cent, that have the split of each inner node of tree."""
    whole = tree.where("parent is null").select("tree_id", F.col("leaves").alias("all"))
    inner = tree.where("parent is not null and name is null").join(whole, "tree_id").withColumn("split", F.array_sort(F.array_except("all", "leaves"))).where("size(leaves) > 1 and size(split) > 1")
    found = splits(replicates).groupBy("split").agg(F.count("*").alias("found"))
    return inner.join(found, "split", "left").select("tree_id", "node", (F.coalesce("found", F.lit(0)) * 100 / F.lit(n)).alias("support"))


def molecular_clock(trees: DataFrame, dates: DataFrame) -> DataFrame:
    """One row a tree with three dated leaves or more: slope, intercept, r2 and rate of depth over the year, and outliers.

    dates: (name, collection_date). Residuals beyond twice the sum of their mean size and of their spread around it are
    outliers; with one year for all the slope is 0, the intercept the mean depth and r2 0. poor: r2 is 0.5 or less.
    """
    dated = trees.where("name is not null").join(dates.where("collection_date is not null"), "name")
    p = dated.select("tree_id", "name", "depth", decimal_year(F.col("collection_date")).alias("year"))
    by = Window.partitionBy("tree_id")  # the leaves of one tree
    mx, my = F.avg("year").over(by), F.avg("depth").over(by)
    p = p.withColumn("n", F.count("*").over(by)).where("n >= 3").withColumn("dx", F.col("year") - mx).withColumn("dy", F.col("depth") - my).withColumn("mx", mx).withColumn("my", my)
    xx, xy, yy = (F.sum(e).over(by) for e in (F.col("dx") ** 2, F.col("dx") * F.col("dy"), F.col("dy") ** 2))
    p = p.withColumn("xx", xx).withColumn("yy", yy).withColumn("slope", F.when(F.col("xx") == 0, 0.0).otherwise(xy / xx))
    p = p.withColumn("intercept", F.col("my") - F.when(F.col("xx") == 0, 0.0).otherwise(F.col("slope") * F.col("mx")))
    p = p.withColumn("off", F.col("depth") - F.when(F.col("xx") == 0, F.col("my")).otherwise(F.col("slope") * F.col("year") + F.col("intercept")))
    p = p.withColumn("size", F.avg(F.abs("off")).over(by)).withColumn("spread", F.sqrt(F.avg((F.col("off") - F.col("size")) ** 2).over(by)))
    r2 = F.when((F.col("xx") == 0) | (F.col("yy") == 0), 0.0).otherwise(1 - F.sum(F.col("off") ** 2) / F.col("yy"))
    out = F.when(F.abs("off") > 2 * (F.col("spread") + F.col("size")), F.col("name"))
    g = p.groupBy("tree_id", "n", "slope", "intercept", "xx", "yy").agg(r2.alias("r2"), F.array_sort(F.collect_list(out)).alias("outliers"))
    return g.select("tree_id", "n", "slope", "intercept", "r2", F.abs("slope").alias("rate"), "outliers", (F.col("r2") <= 0.5).alias("poor"))


def divergence_times(trees: DataFrame, clocks: DataFrame, dates: DataFrame) -> DataFrame:
    """Nodes with year: (depth - intercept) / slope where the clock is not poor and has a slope, a dated leaf's own year; else null."""
    c = clocks.where("not poor and slope <> 0").select("tree_id", "slope", "intercept")
    known = dates.where("collection_date is not null").select("name", decimal_year(F.col("collection_date")).alias("known"))
    joined = trees.join(c, "tree_id", "left").join(known, "name", "left")
    year = F.when(F.col("slope").isNotNull(), F.coalesce("known", (F.col("depth") - F.col("intercept")) / F.col("slope")))
    return joined.withColumn("year", year).drop("slope", "intercept", "known")
