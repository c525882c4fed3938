"""Toxicity: misspelled lexicon terms by a Levenshtein automaton intersected with a trie, scored by their context.

The lexicon is learned: words that are far likelier in toxic documents. The automaton's states are sets of trie nodes
reached with no edit and with one; a text's distinct words run through its table in lock-step. A hit between
quotation marks or near a word of reporting counts as quoted. A small network turns a document's counts of plain and quoted
hits into a probability.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from . import network
from .language_id import held_out
from .quality_classifier import CLASS
from .store import materialize

#: Labelled rows that the lexicon and the network are fitted to, at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
#: The share of toxic documents that must have a term, and the log odds that it needs. The share bounds the lexicon: the
#: terms of all toxic documents of the sample are at most their different words, so 1 / SHARE times those of a mean document.
SHARE, ODDS = 0.005, 3.0
#: Letters from which a term may be met with an edit.
FUZZY = 5
#: Words on either side of a hit that are its context.
REACH = 6
#: Words of reporting, in the four languages of the documents.
CUES = "said says wrote quoted called term word sagte schrieb nannte zitat wort dit écrit appelé mot dijo escribió llamó palabra cita"


class Automaton:
    """All words within one edit of a term (the term itself only, below FUZZY letters), as one table."""

    def __init__(self, terms: list[str]):
        children: list[dict[str, int]] = [{}]
        final: dict[int, bool] = {}
        for t in terms:
            n = 0
            for c in t:
                if c not in children[n]:
                    children[n][c] = len(children)
                    children.append({})
                n = children[n][c]
            final[n] = len(t) >= FUZZY
        letters = sorted({c for t in terms for c in t})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        down = lambda n: children[n].values() if n >= 0 else ()
        start = (0, frozenset(down(0)))  # the node without an edit; the nodes after one
        numbers, table, self.edits, todo = {start: 0}, [], [], deque([start])
        while todo:
            exact, edited = todo.popleft()
            self.edits.append(0 if exact in final else 1 if any(final.get(n) for n in edited) else 2)
            row = []
            for c in (None, *letters):
                to = children[exact].get(c, -1) if exact >= 0 else -1
                near = {children[n][c] for n in edited if c in children[n]}
                near.update(down(exact), down(to))  # a letter replaced; a term's letter left out
                if exact >= 0:
                    near.add(exact)  # a letter put in
                state = (to, frozenset(near))
                if state not in numbers:
                    numbers[state] = len(numbers)
                    todo.append(state)
                row.append(numbers[state])
            table.append(row)
        self.table = np.array(table, np.int32)
        self.edits = np.array(self.edits, np.int8)
        self.dead = numbers.get((-1, frozenset()), -1)  # where all words end that are two letters longer than any term

    def match(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each word code[first[i]:first[i + 1]]: 0 for a term, 1 within an edit of one, else 2."""
        at = np.searchsorted(self.letters, code)
        at = np.minimum(at, max(0, len(self.letters) - 1))
        kind = np.where(self.letters[at] == code, at + 1, 0) if len(self.letters) else np.zeros(len(code), np.int64)
        n = np.diff(first)
        state = np.zeros(len(n), np.int32)
        live = np.arange(len(n))
        j = 0
        while len(live := live[(n[live] > j) & (state[live] != self.dead)]):
            state[live] = self.table[state[live], kind[first[live] + j]]
            j += 1
        return self.edits[state].astype(np.int64)


def _words(rb: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end, first, quotes): words in lower case, and how many quotation marks stand before each byte."""
    text = pc.utf8_lower(A.column(rb, "text").fill_null(""))
    text = pc.replace_substring_regex(text, "[«»“”„‟‹›]", '"')
    buf, off = A.utf8(pc.replace_substring_regex(text, "[–—…¿¡·]", " "))
    n = len(buf)
    letter = CLASS[buf] == 1
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    start, end = np.flatnonzero(letter & before), np.flatnonzero(letter & after) + 1
    return buf, start, end, np.searchsorted(start, off), np.concatenate([[0], np.cumsum(buf == 34)])


def _distinct(buf, start, end) -> tuple[list[str], np.ndarray, np.ndarray]:
    _, at, inverse = np.unique(A.span_hashes(buf, start, end), return_index=True, return_inverse=True)
    data = buf.tobytes()
    return [data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], inverse, at


def lexicon(docs: DataFrame) -> list[str]:
    """Terms from docs (text, y): words in at least SHARE of the rows with y = 1 that are far likelier there."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            buf, start, end, first, _ = _words(rb)
            words, inverse, _ = _distinct(buf, start, end)
            row = np.repeat(np.arange(rb.num_rows), np.diff(first))
            pair = np.unique(row * max(1, len(words)) + inverse)
            y = np.asarray(A.column(rb, "y"))[pair // max(1, len(words))]
            w = pair % max(1, len(words))
            yield A.batch(schema, words, np.bincount(w, y == 1, len(words)).astype(int), np.bincount(w, y != 1, len(words)).astype(int))

    counts = docs.select("text", "y").mapInArrow(run, "word string, toxic bigint, clean bigint")
    n1, n0 = docs.agg(F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0)), F.count("*")).first()
    n0 -= n1
    words = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    good = words.where((F.col("toxic") >= max(3, SHARE * n1)) & (odds >= ODDS))
    return sorted(r["word"] for r in good.collect())


def features(docs: DataFrame, terms: list[str], *keep: str, model: dict | None = None) -> DataFrame:
    """(keep.., features): logs of the counts of plain and of quoted hits, exact and misspelled, and hits per word.
    With a model, its score instead."""
    kinds = [A.arrow_schema(docs.schema).field(c) for c in keep]
    schema = pa.schema([*kinds, ("score", pa.float64()) if model else ("features", pa.list_(pa.float32()))])
    automaton, cues = Automaton(terms), frozenset(CUES.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in A.chunks(batches, "text"):
            buf, start, end, first, quotes = _words(rb)
            words, inverse, _ = _distinct(buf, start, end)
            code = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            edits = automaton.match(code, np.cumsum([0, *map(len, words)]))[inverse] if words else np.zeros(0, np.int64)
            cue = np.array([w in cues for w in words], bool)[inverse] if words else np.zeros(0, bool)
            said = np.concatenate([[0], np.cumsum(cue)])
            hit = np.flatnonzero(edits < 2)
            row = np.repeat(np.arange(rb.num_rows), np.diff(first))[hit]
            a, b = np.maximum(hit - REACH, first[row]), np.minimum(hit + REACH, first[row + 1] - 1)
            # an odd mark open before it and one after it, or a word of reporting
            inside = ((quotes[start[hit]] - quotes[start[a]]) % 2 == 1) & (quotes[end[b]] > quotes[end[hit]])
            quoted = inside | (said[b + 1] > said[a])
            x = np.zeros((rb.num_rows, 5), np.float32)
            for k, some in enumerate((~quoted & (edits[hit] == 0), ~quoted & (edits[hit] == 1), quoted & (edits[hit] == 0), quoted & (edits[hit] == 1))):
                x[:, k] = np.log1p(np.bincount(row[some], minlength=rb.num_rows))
            x[:, 4] = np.bincount(row, minlength=rb.num_rows) / np.maximum(np.diff(first), 1)
            yield A.batch(schema, *[A.column(rb, c) for c in keep], network.probability(model, x.astype(float)) if model else A.ragged(x.ravel(), np.full(rb.num_rows, 5)))

    out = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{out}, {'score double' if model else 'features array<float>'}")


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; the label's rows that are held out are never read.

    Null and empty texts have no hits, and a score. Rows without a label, or with a null one, teach nothing; of several labels of a
    doc_id the greater counts, of several texts the least. Without labels of both kinds every score is the labels' mean, 0.5
    without any. Repeated rows get equal scores, a score of exactly one half predicts 1, whole texts count however
    long, and other columns of docs and labels are not read. An empty table gives an empty table.
    """
    taught = labels.where(~held_out(5, 0) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(SAMPLE)  # SAMPLE rows at most are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = materialize(sample, "sample")  # as many rows at most, however often a doc_id repeats
    terms = lexicon(sample)
    seen = features(sample, terms, "doc_id", "y").toPandas()
    x = np.array(seen["features"].tolist(), float).reshape(len(seen), 5)
    y = seen["y"].to_numpy(float)
    order = np.lexsort([*x.T, y]) if len(y) else slice(None)
    model = network.fit(x[order], y[order], hidden=8)
    out = features(docs, terms, "doc_id", model=model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
