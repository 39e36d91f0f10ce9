"""Brute-force versions of pipeline stages, in plain Python, for small fixtures."""

import re
import zlib

import numpy as np
import xxhash

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def of(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.of(i), self.of(j)
        self.up[max(i, j)] = min(i, j)


def line_dedup(docs):
    """{doc_id: text left} of {doc_id: text}; of each component of similar lines the first line of the least document stays."""
    first = {}
    for d in sorted(docs):
        for x in docs[d].split("\n"):
            if x := x.strip(" ").lower():
                first.setdefault(x, d)
    names = list(first)
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in names]
    groups = Groups(len(names))
    for i in range(len(names)):
        for j in range(i):
            if 0.8 * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j])):
                c = len(sets[i] & sets[j])
                if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c):
                    groups.join(i, j)
    of, keep = {x: groups.of(i) for i, x in enumerate(names)}, {}
    for x, g in of.items():
        keep[g] = min(keep.get(g, first[x]), first[x])
    out = {}
    for d, text in docs.items():
        seen, left = set(), []
        for x in text.split("\n"):
            g = of.get(x.strip(" ").lower())
            if g is None or keep[g] == d and g not in seen:
                left.append(x)
                seen.add(g)
        out[d] = "\n".join(left)
    return {d: t for d, t in out.items() if t.strip(" \n")}


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    h = [xxhash.xxh64_intdigest(x, 42) for x in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_dedup(docs):
    """The document of the least id of each component of fingerprints that differ in 3 bits at most."""
    ids = sorted(docs)
    prints, groups = [fingerprint(docs[d]) for d in ids], Groups(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    return {d: docs[d] for i, d in enumerate(ids) if groups.of(i) == i}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def decontaminated(docs, items):
    windows = {tuple(w[k : k + 10]) for t in items if (w := words(t)) for k in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return {d: t for d, t in docs.items() if not hit(words(t))}


def pieces(docs, encode, capacity=2048):
    """[(doc_id, piece, start, length, crc32)]"""
    out = []
    for d, text in docs.items():
        ids = np.array([*encode(text), 0], "<u4")
        n = len(ids)
        cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
        out += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out
