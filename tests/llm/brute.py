"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_of(pairs, nodes):
    """Node to the smallest node reachable."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def fingerprint(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs):
    """docs: (doc_id, text) with different ids."""
    prints = {d: fingerprint(t) for d, t in docs}
    some = sorted(set(prints.values()))
    pairs = [(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if (a ^ b).bit_count() <= 2]
    of = groups_of(pairs, some)
    head = defaultdict(list)
    for d, f in prints.items():
        head[of[f]].append(d)
    return {d: (f"{f:016x}", min(head[of[f]])) for d, f in prints.items()}


def line_dedup(docs):
    spaces = " \t\n\x0b\x0c\r"
    first = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(spaces).translate(LOWER)
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        keys = [x.strip(spaces).translate(LOWER) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if len(k) < 10 or first[k] == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def byte_dedup(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = True
            seen.add(piece)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def cosine_links(rows, least=0.93):
    """rows: (vec_id, vector, label), all valid. Set of (smaller, larger)."""
    out = set()
    by_label = defaultdict(list)
    for v, x, label in rows:
        by_label[label].append((v, np.array(x, float)))
    for some in by_label.values():
        ids = [v for v, _ in some]
        x = np.stack([x for _, x in some])
        n = np.linalg.norm(x, axis=1)
        a, b = np.nonzero(x @ x.T / (n[:, None] * n[None, :]) >= least)
        out |= {(ids[i], ids[j]) for i, j in zip(a, b, strict=True) if ids[i] < ids[j]}
    return out


def top_products(rows, k=20, every=20):
    out = set()
    weights = [(v, np.floor(64 * np.array(x, float))) for v, x in rows]
    for q, w in weights:
        if q % every == 0:
            scored = sorted((-int(w @ c), v) for v, c in weights if v != q)[:k]
            out |= {(q, i + 1, v, -s) for i, (s, v) in enumerate(scored)}
    return out


def license_scan(docs, rules, base):
    """docs: (doc_id, text). Every rule on every text, places compared pairwise."""
    out = {}
    for d, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        norm = " " + "".join(w + " " for w in words)
        phrases = [(i, label) for phrase, label in base.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        found = []
        for number, (label, _, priority, weight, text, _) in enumerate(rules):
            for m in re.finditer(rf"(?<= )(?:{text})(?= )", norm):
                found.append((norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), priority, number, label, weight))
        def rank(p):
            return p[0], -p[1], p[2], p[3]
        kept = [p for p in found if not any(rank(o) < rank(p) and o[0] <= p[0] and o[1] >= p[1] and o[2] <= p[2] for o in found)]
        starts = [i for i, _ in phrases]
        labels = {label for _, label in phrases}
        out[d] = (
            len(words), len(phrases), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {p[4] for p in kept})), max((p[5] for p in kept), default=0.0),
        )
    return out


def merkle(rows, tampered=7):
    """rows: (doc_id, source, lang, n_chars, text). One tuple for each row, in the order of the leaves."""
    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(last[i : i + 2]) for i in range(0, len(last), 2)])
        return levels

    def way(levels, i):
        for row in levels[:-1]:
            other = i ^ 1
            yield (other < i, row[other]) if other < len(row) else (False, "")
            i >>= 1

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by_lang[g], key=lambda x: x[:3])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for n, g in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(by_lang[g], key=lambda x: x[:3])):
            steps = [*way(trees[g], i), *way(top, n)]
            claim = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % tampered == 0 and r[3] is not None:
                claim = leaf((*r[:3], r[3] + 1, r[4]))
            for left, other in steps:
                claim = h([other, claim] if left else [claim, other])
            root = top[-1][0]
            out.append((r[0], own, trees[g][-1][0], root, h(o for _, o in steps), claim, claim == root))
    return out


def hard_negatives(rows, every=100, positives=5, negatives=5, scale=256):
    """rows: (vec_id, vector, label), all valid."""
    w = [(v, [int(np.floor(np.float64(scale) * np.float64(x))) for x in vec], label) for v, vec, label in rows]
    out = []
    for a, x, label in w:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), v, other) for v, y, other in w if v != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s][:negatives]
            out += [(a, p, i + 1, v, -s, -n) for i, (n, v, _) in enumerate(fits)]
    return out


def pack(pieces, capacity):
    """pieces: (doc_id, piece, size, source, cluster) in the order of packing; every bin is looked at for every piece."""
    bins, out = [], {}
    for step, (d, p, size, source, cluster) in enumerate(pieces):
        fits = [
            (capacity - b["used"], b["since"], i) for i, b in enumerate(bins)
            if b["used"] + size <= capacity and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])
        ]
        i = min(fits)[2] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "sources": set(), "clusters": set(), "since": 0})
        out[d, p] = (size, i, bins[i]["used"])
        bins[i]["used"] += size
        bins[i]["since"] = step
        bins[i]["sources"] |= {source} - {None}
        bins[i]["clusters"] |= {cluster} - {None}
    return out


def differenced(sizes, k):
    """Karmarkar-Karp with the members of every part written out; all partial partitions are sorted anew for each step."""
    made = len(sizes)
    held = [(i, [(s, i, [i])] + [(0, made, [])] * (k - 1)) for i, s in enumerate(sizes)]  # (order, parts)
    order = len(sizes)
    while len(held) > 1:
        held.sort(key=lambda x: (-(x[1][0][0] - x[1][-1][0]), x[0]))
        (_, a), (_, b) = held.pop(0), held.pop(0)
        joined = []
        for x, y in zip(a, reversed(b), strict=True):
            if x[2] and y[2]:
                joined.append((x[0] + y[0], made, x[2] + y[2]))
                made += 1
            else:
                joined.append(x if x[2] else y)
        joined.sort(key=lambda part: (not part[2], -part[0], part[1]))
        held.append((order, joined))
        order += 1
    return {i: number for number, (_, _, members) in enumerate(held[0][1]) for i in members}
