"""Plain code that the operators are compared with: one row after the other, no Spark."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa

from placeworks.llm import mixing, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toxic_score(model, text):
    """The classifier from its embeddings and kernels, filter by filter; only the bucket of a word is asked of the operator."""
    buckets = [next(toxicity.column_buckets(pa.array([w])))[0] for w in WORD.findall((text or "").translate(LOWER))]
    pad = max(toxicity.WIDTHS) - 1
    x = np.zeros((max(len(buckets), 1) + pad, toxicity.DIM))
    for i, parts in enumerate(buckets):
        x[i] = sum(model.embedding[b].astype(float) for b in parts)
    n, tops = len(x) - pad, []
    for width, kernel in zip(toxicity.WIDTHS, model.kernels, strict=True):
        for f in range(toxicity.FILTERS):
            tops.append(max(sum(float(x[i + j] @ kernel[j, :, f]) for j in range(width)) for i in range(n)))
    hidden = [max(t + float(b), 0.0) for t, b in zip(tops, model.bias, strict=True)]
    return 1 / (1 + math.exp(-(sum(h * float(w) for h, w in zip(hidden, model.weight, strict=True)) + model.offset)))


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def kept_of_near_duplicates(texts, k, percent):
    """The least ids of the components of (id, text), ids being unique."""
    sets = {d: shingles(t, k) for d, t in texts}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {d for d in ids if find(d) == d}


def windows(text, size=10):
    w = WORD.findall((text or "").translate(LOWER))
    return w, ([tuple(w[j : j + size]) for j in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else [])


def clean_of(texts, items):
    """Ids of the texts that hold no window of an item."""
    asked = {g for t in items for g in windows(t)[1]}
    sizes = {len(g) for g in asked}
    out = set()
    for d, t in texts:
        w = windows(t)[0]
        if not any(tuple(w[j : j + s]) in asked for s in sizes for j in range(len(w) - s + 1)):
            out.add(d)
    return out


def sampled(rows, rate):
    """Ids of (id, text, source, lang) that the raked weights take: three marginals in turn until nothing moves."""
    told = []
    for d, text, source, lang in rows:
        text = text or ""
        topic = next((name for name, pattern in mixing.TOPICS if re.search(pattern, text)), "prose")
        told.append((d, (source or "", lang or "", topic), max(len(re.findall(r"[^ \t\n\r\f]+", text)), 1)))
    cells = {}
    for _, c, n in told:
        cells[c] = cells.get(c, 0) + n
    total = sum(cells.values())
    share = lambda weights, at: {v: sum(w for c, w in weights.items() if c[at] == v) for v in {c[at] for c in weights}}
    goals = []
    for at, m in enumerate(mixing.KEYS):
        raised = {v: (n / total) ** mixing.POWERS[m] for v, n in share(cells, at).items()}
        goals.append({v: r / sum(raised.values()) for v, r in raised.items()})
    weights = {c: n / total for c, n in cells.items()}
    for _ in range(400):
        for at in (1, 2, 0):
            now = share(weights, at)
            weights = {c: w * goals[at][c[at]] / now[c[at]] for c, w in weights.items()}
    ratio = {c: weights[c] * total / cells[c] for c in cells}
    # The least common factor, by halving, at which the cells, whole ones at most, hold the share asked for.
    low, high = 0.0, 2.0 / min(ratio.values())
    for _ in range(200):
        middle = (low + high) / 2
        held = sum(n * min(ratio[c] * middle, 1.0) for c, n in cells.items())
        low, high = (middle, high) if held < rate * total else (low, middle)
    place = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:12], 16) / (1 << 48)
    return {d for d, c, _ in told if place(d) < min(ratio[c] * high, 1.0)}
