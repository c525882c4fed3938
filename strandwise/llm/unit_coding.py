"""Texts to ids by way of their distinct units (words): each unit is encoded once per group of chunks, or known from before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import arrow_text as A

#: Chunks that are encoded together, and units that a worker remembers (some 30 bytes each; then it learns no more).
GROUP, REMEMBERED = 3, 1_000_000


class Known:
    """The ids of units that were met before, by two hashes (64 and 32 bits) of their bytes."""

    def __init__(self, dtype: str):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.n = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype), 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of the units, -1 for new ones."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def learn(self, key: np.ndarray, check: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """key is sorted; a key that is there already with another check is left as it was."""
        room = max(0, REMEMBERED - len(self.key))
        at = np.searchsorted(self.key, key)
        new = np.flatnonzero(~((at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == key)) if len(self.key) else np.ones(len(key), bool))[:room]
        if not len(new):
            return
        flat = ids[A.slices((np.cumsum(n) - n)[new], n[new])]
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(n[new]) - n[new]
        self.used += len(flat)
        self.key, self.check = np.insert(self.key, at[new], key[new]), np.insert(self.check, at[new], check[new])
        self.start, self.n = np.insert(self.start, at[new], start), np.insert(self.n, at[new], n[new])


def _check(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of the spans, from their bytes permuted."""
    return (A.span_hashes(OTHER[buf], start, end) >> A.U64(32)).astype(np.uint32)


OTHER = (np.arange(256) * 167 + 91).astype(np.uint8)


def coded(
    batches: Iterator[pa.RecordBatch], split: Callable, encode: Callable[[list[bytes]], list[bytes]], dtype: str, known: Known
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, first) for each chunk: the ids of row i are ids[first[i]:first[i + 1]].

    split(rows) gives (bytes, start, end, first) of the units; encode gives each new unit's ids as bytes of dtype.
    """
    group: list[tuple] = []

    def flush() -> Iterator[tuple]:
        key, at = np.unique(np.concatenate([g[1] for g in group]), return_index=True)
        check = np.concatenate([g[2] for g in group])[at]
        place = known.find(key, check)
        new = np.flatnonzero(place < 0)
        # the bytes of new units, from the chunk each was first met in
        which = at[new]
        begin = np.cumsum([0, *(len(g[1]) for g in group)])
        units: list[bytes] = [b""] * len(new)
        owner = np.searchsorted(begin, which, "right") - 1
        for k, (rb, _, _, _, first, start, end, data) in enumerate(group):
            mine = np.flatnonzero(owner == k)
            local = which[mine] - begin[k]
            for i, a, b in zip(mine.tolist(), start[local].tolist(), end[local].tolist(), strict=True):
                units[i] = data[a:b]
        parts = encode(units)
        fresh = np.frombuffer(b"".join(parts), dtype)
        n = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(dtype).itemsize
        old = np.flatnonzero(place >= 0)
        # one flat array: known ids first, new ones after them
        count = np.empty(len(key), np.int64)
        count[old], count[new] = known.n[place[old]], n
        flat = np.concatenate([known.ids[A.slices(known.start[place[old]].astype(np.int64), count[old])], fresh])
        to = np.empty(len(key), np.int64)
        to[old] = np.cumsum(count[old]) - count[old]
        to[new] = len(flat) - len(fresh) + np.cumsum(n) - n
        if len(new):
            known.learn(key[new], check[new], n, fresh)
        for rb, own, _, inverse, first, *_ in group:
            unit = np.searchsorted(key, own)[inverse]
            counts = count[unit]
            yield rb, flat[A.slices(to[unit], counts)], np.concatenate([[0], np.cumsum(counts)])[first]
        group.clear()

    for rb in A.chunks(batches, "text"):
        buf, start, end, first = split(rb)
        own, at, inverse = np.unique(A.span_hashes(buf, start, end), return_index=True, return_inverse=True)
        group.append((rb, own, _check(buf, start[at], end[at]), inverse.astype(np.int32), first, start[at], end[at], buf.tobytes()))
        if len(group) >= GROUP:
            yield from flush()
    if group:
        yield from flush()
