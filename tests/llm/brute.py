"""Brute-force versions of operators, over lists of (doc_id, text)."""

import hashlib
import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def jaccard(docs, width=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[a : a + width]) for a in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    shared = defaultdict(int)
    for v in lists.values():
        for k, a in enumerate(v):
            for b in v[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for a in range(len(words) - 7):
        seen.setdefault(tuple(words[a : a + 8]), []).append(a)
    covered = {a + k for v in seen.values() if len(v) > 1 for a in v for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def votes(text):
    """1 good, 0 bad, 2 none, by rule."""
    import regex

    text = text or ""
    n, chars, symbols, dup, repeat = base_counts(text)
    words = WORD.findall(text)
    lines = len([x for x in text.split("\n") if WORD.search(x)])
    distinct = len(set(words))
    upper = len(regex.findall(r"\p{Lu}", text))
    bang, stops = text.count("!"), sum(c in ".!?" for c in text)
    other = len(regex.findall(r"[^\p{L}\p{M}\x20\x09-\x0D]", text))
    bare = sum(not regex.search(r"[\p{L}\p{M}\p{Nd}]", w) for w in words)
    seen = {
        "symbols": (symbols * 10 > n, symbols == 0), "bare": (bare * 5 > n, bare * 50 <= n), "letters": (other * 5 > chars, other * 10 <= chars),
        "repeats": (repeat * 10 > n * 3, repeat == 0 and n >= 8), "lines": (dup * 2 > lines and lines >= 4, dup == 0 and lines >= 4),
        "word_length": (chars < n * 3 or chars > n * 11, n * 4 <= chars <= n * 8), "capitals": (upper * 3 > chars, upper * 10 <= chars),
        "shouting": (bang * 4 > n, bang * 20 <= n), "stops": (stops * 2 > n or (stops == 0 and n >= 100), stops * 50 >= n and stops * 4 <= n),
        "variety": (distinct**2 < n * 9 and n >= 50, distinct**2 >= n * 25 and n >= 50),
    }
    return {r: 2 if n == 0 else 0 if bad else 1 if good else 2 for r, (bad, good) in seen.items()}


def posteriors(rows, rounds=25, prior=0.8, right=(0.35, 0.99), smooth=10):
    """EM over votes, row by row: p(good) of each row of {rule: vote}."""
    share, acc = prior, {r: list(right) for r in (rows[0] if rows else {})}

    def p_good(v):
        odds = math.log(share / (1 - share))
        for r, x in v.items():
            if x == 1:
                odds += math.log(acc[r][1] / (1 - acc[r][0]))
            elif x == 0:
                odds += math.log((1 - acc[r][1]) / acc[r][0])
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        p = [p_good(v) for v in rows]
        old, share = share, (sum(p) + smooth * prior) / (len(rows) + smooth)
        for r in acc:
            for c in (0, 1):
                w = p if c else [1 - x for x in p]
                hit = sum(x for x, v in zip(w, rows, strict=True) if v[r] == c)
                miss = sum(x for x, v in zip(w, rows, strict=True) if v[r] == 1 - c)
                acc[r][c] = (hit + smooth * right[c]) / (hit + miss + smooth)
        if abs(share - old) < 1e-5:
            break
    return [p_good(v) for v in rows]


def kept_by_rules(docs):
    p = posteriors([votes(t) for _, t in docs])
    out = []
    for (_, t), x in zip(docs, p, strict=True):
        n, *_, repeat = base_counts(t)
        out.append(n >= 20 and 100 * repeat <= 30 * n and x >= 0.5)
    return out


def damage(turns):
    """(conv_id, turn, role, text) after damage; a null is one space, but for a row's own conv_id and turn."""
    import zlib

    out = []
    for conv, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repair(turns):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}: the cheapest and least edits by plain recursion."""
    from functools import lru_cache

    out = {}
    rows_of = defaultdict(list)
    for r in damage(turns):
        rows_of[r[0]].append(r[1:])
    for conv in {t[0] for t in turns}:
        rows = sorted(rows_of[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\f\r")[-1:]
            faults.append("b" if not end else "d" if (role, text) in seen else "" if end in ".!?" else "t")
            seen.add((role, text))
        # states by what may come next: s or u, u only (twice), a
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        name = {"u": "user", "a": "assistant"}

        @lru_cache(None)
        def best(i, state, inserts=0, rows=rows, faults=faults):
            found = []
            if i == len(rows) and state in (0, 3):
                found.append((0, "", ()))
            if i < len(rows):
                _, role, text = rows[i]
                c, a, t = best(i + 1, state)
                found.append((c + 2, "D" + a, t))
                if faults[i] not in ("b", "d"):
                    more = 5 * (faults[i] == "t")
                    for x, to in step[state].items():
                        if role[:1] == x:
                            c, a, t = best(i + 1, to)
                            found.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                        if x in name:
                            c, a, t = best(i + 1, to)
                            found.append((c + more + 1, "R" + a, (f"{name[x]}:{text}", *t)))
            if inserts < 3:
                for x, to in step[state].items():
                    if x in name:
                        got = best(i, to, inserts + 1)
                        if got:
                            found.append((got[0] + 5, "I" + got[1], (f"{name[x]}:", *got[2])))
            return min(found) if found else None

        cost, audit, lines = best(0, 0)
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def simhash(docs, links=4):
    """{doc_id: (fingerprint, component)} by all pairs."""
    import xxhash

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    prints = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(lower))
        shingles = [" ".join(w[a : a + 4]) for a in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= links:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def merkle(docs):
    """{doc_id: (leaf, subroot, root, proof, folded_root, verified)} for rows (doc_id, source, lang, n_chars, text) with distinct ids."""
    import zlib

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tower(nodes):
        """(root, for each node its path of (left, right))"""
        paths, at, up = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(up) > 1:
            for k in range(len(nodes)):
                a = at[k] // 3 * 3
                paths[k].append(("".join(up[a : at[k]]), "".join(up[at[k] + 1 : a + 3])))
                at[k] //= 3
            up = [h(*up[a : a + 3]) for a in range(0, len(up), 3)]
        return up[0], paths

    by_source = defaultdict(list)
    for r in docs:
        by_source[r[1]].append(r)
    subs, out = {}, {}
    for s, rows in by_source.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        subs[s] = tower([h(*map(field, r)) for r in rows])
    order = sorted(subs, key=lambda s: (s is not None, (s or "").encode()))
    root, above = tower([subs[s][0] for s in order])
    for s, rest in zip(order, above, strict=True):
        for r, path in zip(by_source[s], subs[s][1], strict=True):
            path = path + rest
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            fold = h(*map(field, (*r[:4], text)))
            for a, b in path:
                fold = h(a, fold, b)
            out[r[0]] = (h(*map(field, r)), subs[s][0], root, h(*[a + b for a, b in path]), fold, fold == root)
    return out
