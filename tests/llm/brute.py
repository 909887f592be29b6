"""Plain Python forms of the operators, over lists of rows."""

from __future__ import annotations

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str) -> str:
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lines(docs, min_chars=40, min_docs=5):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(-(2**63) if i is None else i)
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        me = -(2**63) if i is None else i
        kept = [x for x in parts if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != me)]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def simhash(text, width=3):
    w = WORD.findall(low(text or ""))
    grams = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def groups(docs, distance=3):
    prints = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(i, f"{prints[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(docs)]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(x * 2, 10)) if j % 2 else x for j, x in enumerate(map(int, digits[::-1]))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if _holds(k, m.group())]


def windows(docs, window=20):
    """Documents in id order, each id one text; null ids may not share windows with one another."""
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda d: -(2**63) if d[0] is None else d[0]):
        w = WORD.findall(t or "")
        cover = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if seen.setdefault(x, (i, k)) != (i, k):
                cover[k : k + window] = [True] * window
        out[i, t] = (i, len(w), sum(cover), " ".join(x for x, c in zip(w, cover) if not c))
    return [out[d] for d in docs]


def hits(docs, items, window=10):
    owners = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            owners[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall(low(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if x := owners.get(tuple(w[k : k + n])):
                    found |= x
                    hit.update(range(k, k + n))
        found.discard(None)
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def topk(rows, k=20):
    import math

    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in usable if i % 20 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out
