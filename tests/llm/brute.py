"""Plain Python versions of the text queries, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def near(rows):
    """(doc_id, text) -> {doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for key, text in rows:
        w = words(lower(text))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    at = defaultdict(list)
    for key, s in sets.items():
        for x in s:
            at[x].append(key)
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in {(a, b) for keys in at.values() for a in keys for b in keys if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


WORD7 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(text, items):
    """n_words, n_hit, n_items, items_sha256. items: [(item_id, text)]."""
    w = WORD7.findall(lower(text))
    hit, found = set(), set()
    grams = defaultdict(set)
    for key, item in items:
        v = WORD7.findall(lower(item))
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            grams[tuple(v[i : i + n])].add(key)
    for n in {len(g) for g in grams}:
        for i in range(len(w) - n + 1):
            if keys := grams.get(tuple(w[i : i + n])):
                found |= keys
                hit |= set(range(i, i + n))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))
    n = Counter(k for _, _, k, _ in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest(), said


def gru_score(model, ids):
    """log10 probability of one document, a word at a time."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p, n = {k: v.astype(float) for k, v in model.p.items()}, model.h
    h, before, out = [0.0] * n, model.n + 1, 0.0
    for y in ids:
        given, u = p["E"][before], [sum(h[i] * p["U"][i][j] for i in range(n)) for j in range(3 * n)]
        z, r = ([sigmoid(given[j + at] + u[j + at]) for j in range(n)] for at in (0, n))
        new = [math.tanh(given[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
        c = [sum(h[i] * p["C"][i][k] for i in range(n)) + p["c"][k] for k in range(len(p["c"]))]
        k = int(model.cls[y])
        out += c[k] - math.log(sum(map(math.exp, c)))
        if y < model.n:
            w = [sum(h[i] * p["W"][k][i][j] for i in range(n)) + p["w"][k][j] for j in range(model.m)]
            out += w[int(model.pos[y])] - math.log(sum(map(math.exp, w)))
        before = y
    return out / math.log(10)


def spark_hash(*values, seed=42):
    """xxhash64 of long, int (as ("int", x)), string and null columns, as a signed number."""
    import struct

    import xxhash

    for x in values:
        if x is not None:
            raw = x.encode() if isinstance(x, str) else struct.pack("<q", x) if isinstance(x, int) else struct.pack("<i", x[1])
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (seed >> 63 << 64)


def mixture(rows, block_tokens, most_blocks, seed, target_entropy=None, max_repeats=None, budget_share=1.0):
    """rows (doc_id, text, source) -> how often each (doc_id, epoch) is taken, source by source and document by document."""
    size = {i: len(words(t)) for i, t, _ in rows}
    of = Counter()
    for i, _, s in rows:
        of[s] += size[i]
    of = {s: n for s, n in of.items() if n}
    total = sum(of.values())

    def weights(a):
        power = {s: (n / total) ** a for s, n in of.items()}
        z = sum(power.values())
        return {s: x / z for s, x in power.items()}

    def too_flat(a):
        w = weights(a)
        over = max_repeats is not None and max(w[s] * total * budget_share / of[s] for s in of) > max_repeats * (1 + 1e-12)
        return over or target_entropy is not None and len(of) > 1 and -sum(x * math.log(x) for x in w.values()) > target_entropy * math.log(len(of))

    low, high = 0.0, 1.0
    for _ in range(60 if too_flat(0.0) else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    w, out = weights(high if too_flat(0.0) else 0.0), Counter()
    for s, n in of.items():
        budget = round(w[s] * total * budget_share)
        epochs, rest = divmod(budget, n)
        n_blocks = min(most_blocks, -(-n // block_tokens))
        blocks = defaultdict(list)
        for i, t, source in rows:
            if source == s:
                key = spark_hash(("int", seed), i, t)
                blocks[spark_hash(key, ("int", 1)) % n_blocks].append((key, i))
                for e in range(epochs):
                    out[i, e] += 1
        for b in sorted(blocks, key=lambda b: (spark_hash(b, ("int", seed)), b)):
            for _, i in sorted(blocks[b]):
                if rest > 0 and size[i]:
                    out[i, epochs] += 1
                    rest -= size[i]
    return out


def chunk_ends(data, gear, reach, most):
    """Ends by the rule itself: hashes of the last 16 bytes, least within reach, the first of equal ones."""
    h = [sum(int(gear[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**16 for i in range(len(data))]
    ends, last = [], 0
    for i in range(len(data)):
        near = h[max(0, i - reach) : i]
        cut = i + 1 == len(data) or all(x > h[i] for x in near) and all(x >= h[i] for x in h[i + 1 : i + 1 + reach])
        if cut:
            ends += [*range(last + most, i + 1, most), i + 1]
            last = i + 1
    return ends


def spans(rows, gear, reach, most, least):
    """(doc_id, text) -> {(doc_id, start, stop, n_chunks, first_doc)} of the chunks that two documents hold."""
    pieces, at = {}, defaultdict(set)
    for key, text in rows:
        raw, start = (text or "").encode(), 0
        pieces[key] = []
        for end in chunk_ends(raw, gear, reach, most):
            pieces[key].append((raw[start:end], start, end))
            at[raw[start:end]].add(key)
            start = end
    out = set()
    for key, text in rows:
        raw, run = (text or "").encode(), []
        for piece, start, end in [*pieces[key], (None, 0, 0)]:
            if piece is not None and len(at[piece]) > 1:
                run.append((piece, start, end))
                continue
            if run:
                a, b = (sum((x & 0xC0) != 0x80 for x in raw[:i]) for i in (run[0][1], run[-1][2]))
                if b - a >= least:
                    out.add((key, a, b, len(run), min(min(at[p]) for p, _, _ in run)))
            run = []
    return out


def chain(rows, vocabulary, categories, ridge, iterations):
    """rows (words, fold, labels by category) -> for each category the weights on words, earlier probabilities and bias, and
    the out-of-fold probabilities, by accelerated gradient steps in double precision."""
    folds = sorted({f for _, f, _ in rows})
    x = [[math.log1p(w.count(v)) for v in vocabulary] for w, _, _ in rows]
    weights, before = {}, [[] for _ in rows]

    def fit(z, y):
        z, y = np.array(z), np.array(y)
        if y.min() == y.max():
            return np.append(np.zeros(z.shape[1]), 40.0 if y[0] else -40.0)
        scale = np.sqrt((z**2).mean(0)).clip(1e-6)
        z = np.column_stack([z / scale, np.ones(len(z))])
        step = 1 / (0.25 * np.linalg.eigvalsh(z.T @ z / len(z))[-1] * 1.05 + ridge)
        w = look = np.zeros(z.shape[1])
        for i in range(iterations):
            p = 1 / (1 + np.exp(-z @ look))
            new = look - step * (z.T @ (p - y) / len(y) + ridge * np.append(look[:-1], 0))
            look, w = new + i / (i + 3) * (new - w), new
        return np.append(w[:-1] / scale, w[-1])

    for name in categories:
        z, y = [a + b for a, b in zip(x, before, strict=True)], [labels[name] for _, _, labels in rows]
        weights[name] = fit(z, y)
        p = [0.0] * len(rows)
        for f in folds:
            inside = [i for i, r in enumerate(rows) if r[1] != f]
            w = fit([z[i] for i in inside], [y[i] for i in inside])
            for i, r in enumerate(rows):
                if r[1] == f:
                    p[i] = float(1 / (1 + math.exp(-(np.dot(w[:-1], z[i]) + w[-1]))))
        before = [b + [q] for b, q in zip(before, p, strict=True)]
    return weights
