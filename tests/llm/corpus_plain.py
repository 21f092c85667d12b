"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = "[\\x20\\x09-\\x0D]+"
WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
ALNUM = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def repeats(rows, window):
    docs = [(i, WORDS.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in docs for p in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def simhash(t, n=4):
    w = WORDS.findall(lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows, k=4):
    fp = [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= k:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(parent, i)].append(d)
    smallest = {r: min((d for d in v if d is not None), default=None) for r, v in least.items()}
    return [(d, f"{fp[i]:016x}", smallest[find(parent, i)]) for i, (d, _) in enumerate(rows)]


def exact(rows):
    groups = defaultdict(list)
    norm = [re.sub(SPACE, " ", t or "") for _, t in rows]
    for k, ((i, _), t) in enumerate(zip(rows, norm, strict=True)):
        groups[t].append((i is None, i if i is not None else 0, k, i))
    out = []
    for k, ((i, _), t) in enumerate(zip(rows, norm, strict=True)):
        head = min(groups[t])
        out.append((i, head[3], len(groups[t]), head[2] == k, hashlib.sha256(t.encode()).hexdigest()))
    return out


def hits(rows, items, n=10):
    grams = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t or ""))
        m = min(n, len(w))
        for s in range(len(w) - m + 1) if m else ():
            grams[tuple(w[s : s + m])] |= {str(item)} if item is not None else set()
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, who = [False] * len(w), set()
        for m in {len(g) for g in grams}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in grams:
                    hit[s : s + m] = [True] * m
                    who |= grams[tuple(w[s : s + m])]
        out.append((i, len(w), sum(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), any(hit)))
    return out


def pieces(tokenizer, rows, capacity=2048):
    import numpy as np

    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def jaccard(a, b, n=5):
    s = lambda t: {tuple(w[i : i + n]) for w in [WORDS.findall(lower(t or ""))] for i in range(max(1, len(w) - n + 1))}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)
