"""Plain versions of the operators, one document at a time and all pairs where it takes pairs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WS_WORD = re.compile(r"[^\x20\x09-\x0D]+")
AN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs, length=20):
    """{doc_id: (n_words, n_removed, sha of kept)} of [(doc_id, text)] with unique ids."""
    words = {i: WS_WORD.findall(t or "") for i, t in docs}
    first, gone = {}, defaultdict(set)
    for i in sorted(words):
        w = words[i]
        for p in range(len(w) - length + 1):
            if first.setdefault(tuple(w[p : p + length]), (i, p)) != (i, p):
                gone[i].update(range(p, p + length))
    return {i: (len(w), len(gone[i]), sha(" ".join(x for p, x in enumerate(w) if p not in gone[i]))) for i, w in words.items()}


def simhash_of(text):
    w = WS_WORD.findall(lower(text))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    """{node: least node reachable}."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(docs, distance=4):
    fp = {i: simhash_of(t) for i, t in docs}
    least = {}
    for i in sorted(fp):
        least.setdefault(fp[i], i)
    kinds = list(least)
    linked = [(least[a], least[b]) for k, a in enumerate(kinds) for b in kinds[:k] if (a ^ b).bit_count() <= distance]
    name = groups(list(least.values()), linked)
    return {i: (f"{f:016x}", name[least[f]]) for i, f in fp.items()}


def decontaminate(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, sha of items, contaminated)}."""
    found = defaultdict(set)
    for item, text in items:
        w = AN_WORD.findall(lower(text))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            found[tuple(w[p : p + n])].add(str(item))
    sizes = {len(k) for k in found}
    out = {}
    for i, text in docs:
        w, hit, names = AN_WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in found:
                    hit.update(range(p, p + n))
                    names |= found[k]
        out[i] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
