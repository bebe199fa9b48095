"""Slow and plain versions of what the operators return."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, window):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)} for (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[key] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, width):
    words = (text or "").encode().lower().split()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def components(rows, width, percent=80):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {k: shingles(t, width) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(set)
    for k in sorted(sets):
        near = Counter(o for s in sets[k] for o in held[s])
        for o, inter in near.items():
            if 100 * inter >= percent * (len(sets[k]) + len(sets[o]) - inter):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
        for s in sets[k]:
            held[s].add(k)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: target} by sharing again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_weight = sum(w[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and left * w[s] / open_weight > cap * sizes[s]}
        if not more:
            return {s: float(cap * sizes[s]) if s in capped else left * w[s] / open_weight for s in order}
        capped |= more


def binomial_bound(bad, n, error):
    """The largest rate at which ``bad`` or fewer of ``n`` have probability ``error`` or more, by bisection over whole sums."""
    from math import comb

    low, high = 0.0, 1.0
    if bad >= n:
        return 1.0
    for _ in range(50):
        p = (low + high) / 2
        tail = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1))
        low, high = (p, high) if tail > error else (low, p)
    return high


def quality_kept(docs, labels, cutoffs, limit=0.05, delta=0.05, weight=20):
    """[kept] for (doc_id, text, stratum) rows, trying every choice of one cutoff or none per rule."""
    from itertools import product

    truth = {}
    for key, quality in labels:
        if key is not None and quality is not None:
            truth[key] = min(quality, truth.get(key, quality))
    seen = []
    for key, text, stratum in docs:
        n, chars, symbols, dup, repeat = stats(text)
        share = lambda a, b: a * 1000 // b if b else 0
        seen.append((stratum, key, n < 50 or 100 * repeat > 50 * n, (share(symbols, chars), share(dup, n), share(repeat, n))))
    held = defaultdict(list)
    for stratum, key, failed, shares in seen:
        if not failed and key in truth:
            held[stratum].append((truth[key] >= 1, shares))
    choices = list(product([*cutoffs, None], repeat=3))
    error, chosen = delta / max(1, len(held) * len(choices)), {}
    rejects = lambda shares, choice: any(c is not None and s > c for s, c in zip(shares, choice, strict=True))
    bounds = {}
    for stratum, rows in held.items():
        best, n_good = 0, sum(g for g, _ in rows)
        grouped = Counter(rows)
        for choice in choices:
            good, bad = (sum(k for (g, shares), k in grouped.items() if g == want and rejects(shares, choice)) for want in (True, False))
            gain = bad - weight * good
            places = tuple(len(cutoffs) if c is None else cutoffs.index(c) for c in choice)
            order = (sum(places), places)
            if gain < best or gain <= 0:
                continue
            if (good, n_good) not in bounds:
                bounds[good, n_good] = binomial_bound(good, n_good, error)
            if bounds[good, n_good] <= limit and (gain > best or order > chosen[stratum][0]):
                best, chosen[stratum] = gain, (order, choice)
    return [not failed and not (stratum in chosen and rejects(shares, chosen[stratum][1])) for stratum, _, failed, shares in seen]
