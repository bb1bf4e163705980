"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def stats(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def fingerprint(text, n=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def tables(text, n, salts, mix, size=3):
    """Fingerprints of a text in n tables, from the same hashes mixed anew."""
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return [0] * n
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))], np.uint64)
    out = []
    for t in range(n):
        x = mix(h ^ salts[t]) if t else h
        out.append(sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > len(x)))
    return out


def similar(texts, size=5, least=0.8):
    """For each text, the first of its class: classes of pairs whose sets of word shingles have the Jaccard similarity."""
    sets = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))))
    holders = collections.defaultdict(list)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]}:
            both = len(s & sets[j])
            if both >= least * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            holders[x].append(i)
    return [find(i) for i in range(len(texts))]


def components(fps, radius=3):
    """fps: one fingerprint a row, or one of each table; a pair near in any table is linked."""
    v = np.array(fps, np.uint64).reshape(len(fps), -1)
    label = np.arange(len(v))
    near = np.zeros((len(v), len(v)), bool)
    for column in v.T:
        near |= np.bitwise_count(column[:, None] ^ column[None, :]) <= radius
    while True:
        new = np.where(near, label[None, :], len(v)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def repeats(docs, length=100):
    """{id: (bytes, removed, spans, kept)} of (id, text) in order of ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                edge[i] += 1
                edge[i + length] -= 1
            seen.add(w)
        gone = np.cumsum(edge)[: len(b)] > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def water_fill(sizes, weights, budget, most):
    """{source: target}: fill, stop those above their cap, share what is left, until none is above."""
    target, free = {}, dict(weights)
    left = budget
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del free[s]
    return target


def binomial_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
