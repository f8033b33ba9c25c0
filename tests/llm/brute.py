"""Plain-Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def similar(docs, n, num, den):
    """{doc_id: (set size, component, links)} for [(doc_id, text)] with distinct ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    ids, links, group = sorted(sets), collections.Counter(), Union()
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                group.join(a, b)
    return {i: (len(sets[i]), group.find(i), links[i]) for i in ids}


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def targets(sizes, weights, share, most):
    """{source: target} from {source: words}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more
