"""Primer design around targets: candidates from running sums, ranked pairs, sites elsewhere and what two of them could amplify."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import GAP as GAP_SCORE
from .alignment import MATCH, local_alignment
from .synteny import WORD, SeedIndex, best_scores, reverse_complement

#: Bases beside a target, lengths, GC per cent and melting temperatures of primers, the temperature to be near to.
FLANK, LENGTHS, GC, TM, OPTIMAL = 200, (18, 25), (40.0, 60.0), (55.0, 65.0), 60.0
#: Candidates of a side and pairs that are kept, errors of a site, bases between two sites that amplify.
SIDE, PAIRS, ERRORS, REACH = 30, 10, 2, 3000
#: Primers that meet a reference at a time.
LIST = 64
#: The gas constant in cal per mol and K, and the concentration of primers in mol per litre.
GAS, CONCENTRATION = 1.987, 250e-9
#: Nearest-neighbour enthalpies (0.1 kcal per mol) and entropies (0.1 cal per mol and K) of steps between bases.
STEPS = {
    "AA": (-79, -222), "TT": (-79, -222), "AT": (-72, -204), "TA": (-72, -213), "CA": (-85, -227), "TG": (-85, -227), "GT": (-84, -224), "AC": (-84, -224),
    "CT": (-78, -210), "AG": (-78, -210), "GA": (-82, -222), "TC": (-82, -222), "CG": (-106, -272), "GC": (-98, -244), "GG": (-80, -199), "CC": (-80, -199),
}
#: What a primer's first and last base add.
ENDS = {"G": (1, -28), "C": (1, -28), "A": (23, 41), "T": (23, 41)}
_STEP = np.zeros((256, 256, 2), np.int64)
for _pair, _v in STEPS.items():
    _STEP[ord(_pair[0]), ord(_pair[1])] = _v
_END = np.zeros((256, 2), np.int64)
for _b, _v in ENDS.items():
    _END[ord(_b)] = _v


def window_sums(bases: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums over a text: (G and C, other letters than bases, enthalpy and entropy of steps); a window's are a difference of two."""
    text = np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)
    zero = lambda x: np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(x, axis=0)])
    return zero(np.isin(text, list(b"GC"))), zero(~np.isin(text, list(b"ACGT"))), zero(_STEP[text[:-1], text[1:]] if len(text) else np.zeros((0, 2), np.int64))


def melting_points(bases: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, gc, tm) of each window of that length without other letters: per cent and degrees, 2 digits each."""
    text = np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)
    gc, other, steps = window_sums(bases)
    start = np.arange(max(0, len(text) - length + 1))
    start = start[other[start + length] == other[start]]
    h, s = (steps[start + length - 1] - steps[start] + _END[text[start]] + _END[text[start + length - 1]]).T
    tm = h * 100.0 / (s / 10.0 + GAS * math.log(CONCENTRATION / 4)) - 273.15
    return start, np.round((gc[start + length] - gc[start]) / length * 100, 2), np.round(tm, 2)


def window_temperatures(sequences: DataFrame, width: int, step: int = 1 << 16) -> DataFrame:
    """(sequence_id, place, primer, tm): every window of width bases, from 1, with its temperature; a shorter sequence is one window.

    Each sequence (sequence_id, bases) goes in pieces of step windows. A window is a difference of two running sums; of what has
    other letters than bases tm is null, and 0 below two bases.
    """
    rows = sequences.where("bases is not null").select("sequence_id", "bases", F.explode(F.expr(f"sequence(0, greatest(length(bases) - {width}, 0), {step})")).alias("at"))
    rows = rows.select("sequence_id", "at", F.col("bases").substr(F.col("at") + 1, F.lit(step + width - 1)).alias("bases"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sequence_id", "at")  # a short text makes many windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for k, (at, bases) in enumerate(zip(rb["at"].to_pylist(), rb["bases"].to_pylist(), strict=True)):
                size = min(width, len(bases))
                n = len(bases) - size + 1
                tm = np.zeros(n) if size < 2 else np.full(n, np.nan)
                if size > 1:
                    start, _, found = melting_points(bases, size)
                    tm[start] = found
                ids = rb["sequence_id"].take(pa.array(np.full(n, k)))
                texts = pa.array([bases[i : i + size] for i in range(n)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(at + 1 + np.arange(n), pa.int32()), texts, pa.array(tm, pa.float64(), from_pandas=True)], ["sequence_id", "place", "primer", "tm"])

    return rows.mapInArrow(run, f"sequence_id {sequences.schema['sequence_id'].dataType.simpleString()}, place int, primer string, tm double")


def best_windows(region: str) -> list[tuple[int, int, float, float]]:
    """(start, length, gc, tm) of the SIDE windows nearest to the best temperature: then shorter ones, then earlier ones.

    A side's windows are 8 lengths of a flank: 1,500 at most. A primer and its reverse complement have the same GC and temperature.
    """
    return best_windows_of([region])[0]


def best_windows_of(regions: list[str], at_once: int = 256) -> list[list[tuple[int, int, float, float]]]:
    """best_windows of each region, at_once of them as one matrix of their letters."""
    out = []
    for begin in range(0, len(regions), at_once):
        some = regions[begin : begin + at_once]
        wide = max(map(len, some))
        text = np.frombuffer("".join(r.ljust(wide, "\0") for r in some).encode("latin-1", "replace"), np.uint8).reshape(len(some), wide)
        zero = lambda x: np.concatenate([np.zeros((len(x), 1), np.int32), np.cumsum(x, axis=1, dtype=np.int32)], axis=1)
        gc, other = zero(np.isin(text, list(b"GC"))), zero(~np.isin(text, list(b"ACGT")))
        h, s = (zero(_STEP[text[:, :-1], text[:, 1:], k]) for k in (0, 1))
        tips = [_END[text, k] for k in (0, 1)]
        keys, shares, temperatures, base = [], [], [], wide + 1
        for length in range(LENGTHS[0], min(LENGTHS[1], wide) + 1):
            n = wide - length + 1
            low, high = slice(0, n), slice(length, length + n)
            dh, ds = (x[:, length - 1 : length - 1 + n] - x[:, low] + t[:, low] + t[:, length - 1 :] for x, t in zip((h, s), tips, strict=True))
            tm = np.round(dh * 100.0 / (ds / 10.0 + GAS * math.log(CONCENTRATION / 4)) - 273.15, 2)
            share = np.round((gc[:, high] - gc[:, low]) / length * 100, 2)
            ok = (other[:, high] == other[:, low]) & (share >= GC[0]) & (share <= GC[1]) & (tm >= TM[0]) & (tm <= TM[1])
            far = np.where(ok, np.round(np.abs(tm - OPTIMAL) * 100), 1 << 20).astype(np.int64)
            keys.append((far * (LENGTHS[1] + 1) + length) * base + np.arange(n))  # what they go by, as one number
            shares.append(share)
            temperatures.append(tm)
        if not keys:
            out += [[] for _ in some]
            continue
        key, share, tm = (np.concatenate(x, axis=1) for x in (keys, shares, temperatures))
        first = np.argpartition(key, min(SIDE, key.shape[1]) - 1, axis=1)[:, :SIDE]
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(key, first, axis=1), axis=1), axis=1)
        key, share, tm = (np.take_along_axis(x, first, axis=1) for x in (key, share, tm))
        count = (key < (1 << 20) * (LENGTHS[1] + 1) * base).sum(axis=1).tolist()
        start, length = (key % base).tolist(), (key // base % (LENGTHS[1] + 1)).tolist()
        out += [list(zip(start[k][:n], length[k][:n], share[k].tolist()[:n], tm[k].tolist()[:n], strict=True)) for k, n in enumerate(count)]
    return out


def _placed(targets: DataFrame, references: DataFrame) -> DataFrame:
    """(target_id, reference_id, forward, reverse) with offset and region of the flank of either side; see candidates."""
    at = targets.select("target_id", "reference_id", "target_start", "target_end").join(references.select("reference_id", "bases"), "reference_id")
    at = at.where("target_start >= 0 and target_start < target_end and target_end < length(bases)")
    left = F.greatest(F.lit(0), F.col("target_start") - FLANK)
    cut = lambda start, size: F.col("bases").substr((start + 1).cast("int"), size.cast("int"))
    return at.select("target_id", "reference_id",
        F.struct(left.cast("bigint").alias("offset"), cut(left, F.col("target_start") - left).alias("region")).alias("forward"),
        F.struct((F.col("target_end") + 1).cast("bigint").alias("offset"), cut(F.col("target_end") + 1, F.lit(FLANK)).alias("region")).alias("reverse"))


def candidates(targets: DataFrame, references: DataFrame) -> DataFrame:
    """(target_id, reference_id, side, rank, sequence, length, gc, tm, bind_start, bind_end): up to SIDE primers on each side of each target.

    A target (target_id, reference_id, target_start, target_end; both ends in it) lies within its reference and has two bases or more; others
    give none. Reverse primers are the reverse complement of where they bind. Only the flanks leave the join with references (reference_id, bases).
    """
    at = _placed(targets, references)
    sides = at.select("target_id", "reference_id", F.inline(F.array(*[F.struct(F.lit(side).alias("side"), f"{side}.offset", f"{side}.region") for side in ("forward", "reverse")])))
    sides = sides.repartition(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target_id", "side")  # flanks only
    fields = {"rank": pa.int32(), "sequence": pa.string(), "length": pa.int32(), "gc": pa.float64(), "tm": pa.float64(), "bind_start": pa.int64(), "bind_end": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row, made = [], []
            regions = rb["region"].to_pylist()
            for k, (side, offset, region, best) in enumerate(zip(rb["side"].to_pylist(), rb["offset"].to_pylist(), regions, best_windows_of(regions), strict=True)):
                for rank, (a, n, gc, tm) in enumerate(best):
                    text = region[a : a + n]
                    row.append(k)
                    made.append((rank, reverse_complement(text) if side == "reverse" else text, n, gc, tm, offset + a, offset + a + n - 1))
            if made:
                ids = [rb[c].take(pa.array(row)) for c in ("target_id", "reference_id", "side")]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, t) for c, t in zip(zip(*made, strict=True), fields.values(), strict=True)]], ["target_id", "reference_id", "side", *fields])

    ids = ", ".join(f"{c} {targets.schema[c].dataType.simpleString()}" for c in ("target_id", "reference_id"))
    return sides.mapInArrow(run, f"{ids}, side string, rank int, sequence string, length int, gc double, tm double, bind_start bigint, bind_end bigint")


def ranked_pairs(primers: DataFrame) -> DataFrame:
    """The PAIRS best pairs of each target's candidates: rank, both primers, amplicon_length, avg_tm_deviation and tm_difference.

    Pairs go by the mean deviation, halves of a hundredth up, then by the difference, then by the ranks of both: 900 at most of a target.
    """
    part = lambda side: primers.where(F.col("side") == side).select("target_id", "reference_id", F.struct("rank", "sequence", "length", "gc", "tm", "bind_start", "bind_end").alias(side))
    both = part("forward").join(part("reverse"), ["target_id", "reference_id"])
    points = lambda c: F.round(c * 100).cast("bigint")
    away = lambda side: F.abs(points(F.col(f"{side}.tm")) - int(OPTIMAL * 100))
    both = both.withColumn("__away", F.floor((away("forward") + away("reverse") + 1) / 2)).withColumn("__apart", F.abs(points(F.col("forward.tm")) - points(F.col("reverse.tm"))))
    order = Window.partitionBy("target_id", "reference_id").orderBy("__away", "__apart", "forward.rank", "reverse.rank")
    both = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PAIRS)
    return both.select("target_id", "reference_id", "rank", "forward", "reverse", (F.col("reverse.bind_end") - F.col("forward.bind_start") + 1).alias("amplicon_length"),
                       (F.col("__away") / 100).alias("avg_tm_deviation"), (F.col("__apart") / 100).alias("tm_difference"))


def best_pairs(targets: DataFrame, references: DataFrame) -> DataFrame:
    """ranked_pairs of the candidates of each target: only its PAIRS best leave the task that has its flanks, in place of 60 candidates and 900 pairs."""
    at = _placed(targets, references)
    at = at.repartition(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target_id", "reference_id")  # flanks only
    primer = pa.struct([("rank", pa.int32()), ("sequence", pa.string()), ("length", pa.int32()), ("gc", pa.float64()), ("tm", pa.float64()), ("bind_start", pa.int64()), ("bind_end", pa.int64())])
    kinds = {"rank": pa.int32(), "forward": primer, "reverse": primer, "amplicon_length": pa.int64(), "avg_tm_deviation": pa.float64(), "tm_difference": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row, made = [], []
            sides = {c: rb[c].to_pylist() for c in ("forward", "reverse")}
            best = {c: best_windows_of([x["region"] for x in sides[c]]) for c in sides}
            for k, (fs, rs) in enumerate(zip(best["forward"], best["reverse"], strict=True)):
                if not fs or not rs:
                    continue
                f, r = (np.round(np.array([x[3] for x in of]) * 100).astype(np.int64) for of in (fs, rs))
                away = (np.abs(f - int(OPTIMAL * 100))[:, None] + np.abs(r - int(OPTIMAL * 100))[None, :] + 1) // 2
                apart = np.abs(f[:, None] - r[None, :])
                places = np.argsort(((away << 20) + apart).ravel(), kind="stable")[:PAIRS]  # then by the ranks of both
                for rank, (i, j) in enumerate(zip(*(x.tolist() for x in np.divmod(places, len(r))), strict=True), 1):
                    pair = []
                    for side, x, place in (("forward", fs[i], i), ("reverse", rs[j], j)):
                        offset, text = sides[side][k]["offset"] + x[0], sides[side][k]["region"][x[0] : x[0] + x[1]]
                        pair.append((place, reverse_complement(text) if side == "reverse" else text, x[1], x[2], x[3], offset, offset + x[1] - 1))
                    row.append(k)
                    made.append((rank, *pair, pair[1][6] - pair[0][5] + 1, int(away[i, j]) / 100, int(apart[i, j]) / 100))
            if made:
                columns = dict(zip(kinds, zip(*made, strict=True), strict=True))
                arrays = [pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*columns[c], strict=True), primer, strict=True)], fields=list(primer)) if t == primer else pa.array(columns[c], t)
                          for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([*[rb[c].take(pa.array(row)) for c in ("target_id", "reference_id")], *arrays], ["target_id", "reference_id", *kinds])

    ids = ", ".join(f"{c} {targets.schema[c].dataType.simpleString()}" for c in ("target_id", "reference_id"))
    one = "struct<rank: int, sequence: string, length: int, gc: double, tm: double, bind_start: bigint, bind_end: bigint>"
    return at.mapInArrow(run, f"{ids}, rank int, forward {one}, reverse {one}, amplicon_length bigint, avg_tm_deviation double, tm_difference double")


def shared_words(primer: str) -> int:
    """Words that a site has in common with its primer at least: up to ERRORS bases at the ends and ERRORS errors leave so many whole."""
    return len(primer) - WORD + 1 - ERRORS * WORD - ERRORS


def sites_of(primer: str, index: SeedIndex, windows: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, end, mismatches, gaps, score) of each site: an alignment of all but ERRORS of the primer's bases or more with at most ERRORS errors.

    Sites are taken best first; where one is, nothing within two bases of it is looked at again. All sites are within the index's windows,
    and where fewer words are left than a site has in common with its primer, none is.
    """
    shared, plain = shared_words(primer), not primer.strip("ACGT")
    out = []
    for lo, hi, _ in index.windows_of([primer], [shared], ERRORS)[0] if windows is None else windows:
        text = index.text[lo:hi]
        while True:
            if (start := text.find(primer)) >= 0:
                end, other, gaps, score = start + len(primer) - 1, 0, 0, MATCH * len(primer)
            elif (not plain or sum(max(0, len(run) - WORD + 1) for run in text.split("N")) >= shared) and SeedIndex(text).windows(primer, shared, ERRORS):
                score, _, _, start, end, query, ref = local_alignment(primer, text)
                gaps = query.count("-") + ref.count("-")
                other = sum(x != y for x, y in zip(query, ref, strict=True)) - gaps
                if not score or len(query) < len(primer) - ERRORS or gaps + other > ERRORS:
                    break
            else:
                break
            out.append((lo + start, lo + end, other, gaps, score))
            a, b = max(0, start - 2), min(len(text), end + 3)
            text = text[:a] + "N" * (b - a) + text[b:]
    return sorted(out)


def scored_windows(asked: list[tuple[str, SeedIndex, list[tuple[int, int, int]]]]) -> list[list[tuple[int, int, int]]]:
    """Of the windows of each (primer, index, windows), those that can have a site: many are scored at a time.

    A site has all but ERRORS of the primer's bases as columns, of which ERRORS at most are gaps, the worst of errors.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in asked]
    jobs: dict[int, list[tuple[int, tuple[int, int, int], str]]] = {}
    for k, (primer, index, windows) in enumerate(asked):
        for w in windows:
            jobs.setdefault(len(primer), []).append((k, w, index.text[w[0] : w[1]]))
    for size, own in jobs.items():
        far = [x for x in own if asked[x[0]][0] not in x[2]]
        least = MATCH * (size - 2 * ERRORS) + GAP_SCORE * ERRORS
        drop = {(k, w) for (k, w, _), score in zip(far, best_scores([(asked[k][0], text) for k, _, text in far]).tolist(), strict=True) if score < least}
        for k, w, _ in own:
            if (k, w) not in drop:
                out[k].append(w)
    return out


def binding_sites(primers: DataFrame, references: DataFrame) -> DataFrame:
    """(reference_id, sequence, ref_start, ref_end, mismatches, gaps, score): every site of each distinct primer (reference_id, sequence) on its reference.

    A reference meets its primers in lists of LIST, one for most; it has 100,000 bases at most, the limit of what is asked for.
    Lists are dealt by a hash of their own: a partitioning that the join already has would stand in for it, in as few tasks as its bytes fill.
    """
    lists = primers.select("reference_id", "sequence").distinct().groupBy("reference_id").agg(F.collect_list("sequence").alias("all"))
    lists = lists.select("reference_id", "all", F.explode(F.expr(f"sequence(0, (size(all) - 1) div {LIST})")).alias("part"))
    lists = lists.select("reference_id", "part", F.expr(f"slice(all, part * {LIST} + 1, {LIST})").alias("primers"))
    rows = lists.join(references.select("reference_id", "bases"), "reference_id").withColumn("__task", F.xxhash64(F.lit(1), "reference_id", "part"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__task")  # work, not bytes, is what tasks share
    fields = {"ref_start": pa.int64(), "ref_end": pa.int64(), "mismatches": pa.int32(), "gaps": pa.int32(), "score": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row, made = [], []
            asked, own = [], []
            for k, (primers, bases) in enumerate(zip(rb["primers"].to_pylist(), rb["bases"].to_pylist(), strict=True)):
                index = SeedIndex(bases or "")
                asked += [(p, index, windows) for p, windows in zip(primers, index.windows_of(primers, [shared_words(p) for p in primers], ERRORS), strict=True)]
                own += [k] * len(primers)
            for k, (p, index, _), windows in zip(own, asked, scored_windows(asked), strict=True):
                for site in sites_of(p, index, windows):
                    row.append(k)
                    made.append((p, *site))
            if made:
                columns = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([rb["reference_id"].take(pa.array(row)), pa.array(columns[0]), *[pa.array(c, t) for c, t in zip(columns[1:], fields.values(), strict=True)]],
                                                 ["reference_id", "sequence", *fields])

    kind = primers.schema["reference_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"reference_id {kind}, sequence string, ref_start bigint, ref_end bigint, mismatches int, gaps int, score int")


def nonspecific(pairs: DataFrame, targets: DataFrame, sites: DataFrame) -> DataFrame:
    """(target_id, reference_id, rank, amplicon_start, amplicon_end): what a pair's sites beyond its target could amplify, below REACH bases.

    Forward sites meet reverse ones of their pair in bins of REACH bases: the own and the next.
    """
    bounds = targets.select("target_id", "reference_id", "target_start", "target_end")
    beyond = ~((F.col("ref_start") >= F.col("target_start")) & (F.col("ref_end") <= F.col("target_end")))

    def side(name: str) -> DataFrame:
        own = pairs.select("target_id", "reference_id", "rank", F.col(f"{name}.sequence").alias("sequence")).join(sites, ["reference_id", "sequence"])
        return own.join(bounds, ["target_id", "reference_id"]).where(beyond).select("target_id", "reference_id", "rank", "ref_start", "ref_end")

    forward = side("forward").select("target_id", "reference_id", "rank", F.col("ref_start").alias("amplicon_start"), F.expr(f"explode(array(ref_start div {REACH}, ref_start div {REACH} + 1))").alias("bin"))
    reverse = side("reverse").select("target_id", "reference_id", "rank", F.col("ref_end").alias("amplicon_end"), F.expr(f"ref_end div {REACH}").alias("bin"))
    met = forward.join(reverse, ["target_id", "reference_id", "rank", "bin"]).where(f"amplicon_start < amplicon_end and amplicon_end - amplicon_start + 1 < {REACH}")
    return met.drop("bin")


def tm_consistency(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How far the temperatures of the best pairs of targets are spread, in each group: population deviations, 4 digits, 0 for fewer than two."""
    best = pairs.where("rank = 1")
    each = best.select(*by, F.col("forward.tm").alias("f"), F.col("reverse.tm").alias("r"), F.explode(F.array("forward.tm", "reverse.tm")).alias("tm"), F.lit(1).alias("one"))
    spread = lambda c: F.round(F.coalesce(F.stddev_pop(c), F.lit(0.0)), 4)
    return each.groupBy(*by).agg((F.count("*") / 2).cast("bigint").alias("pairs"), spread("f").alias("fwd_tm_std"), spread("r").alias("rev_tm_std"), spread("tm").alias("combined_tm_std"))
