"""Density clusters against a hierarchy built edge by edge."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from geoloom.operators import archetypes as arch
from geoloom.plans import catalog  # noqa: F401
from geoloom.plans.registry import QUERIES


def brute(edges, points, samples, least):
    """HDBSCAN of directed edges (a, b, d): hierarchy by Kruskal, condensed from the top, chosen by stability -> {id: least id or None}."""
    near = {}
    for a, b, d in edges:
        near.setdefault(a, []).append((d, b))
    core = {a: sorted(x)[:samples][-1][0] for a, x in near.items()}
    weight = {}
    for a, b, d in edges:
        key = (min(a, b), max(a, b))
        w = max(d, core[a], core[b])
        weight[key] = min(w, weight.get(key, w))
    top, tree, size = {p: p for p in points}, {}, {p: 1 for p in points}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for w, a, b in sorted((max(w, 1e-12), *k) for k, w in weight.items()):
        x, y = find(a), find(b)
        if x != y:
            node = ("n", len(tree))
            tree[node] = (x, y, w)
            top[x] = top[y] = top[node] = node
            size[node] = size[x] + size[y]
    roots = sorted({find(p) for p in points}, key=str)

    def under(x):
        return [x] if x not in tree else under(tree[x][0]) + under(tree[x][1])

    clusters, of = {}, {}  # cluster -> (parent, stability, children)

    def descend(node, name, parent, birth):
        """Follows a cluster down until it splits in two large ones."""
        stability = 0.0
        clusters[name] = [parent, 0.0, []]
        if parent is not None and parent in clusters:
            clusters[parent][2].append(name)
        while node in tree:
            x, y, w = tree[node]
            large = [z for z in (x, y) if size[z] >= least]
            if len(large) == 1:
                for z in (x, y):
                    if z is not large[0]:
                        for p in under(z):
                            of[p] = name
                            stability += 1 / w - birth
                node = large[0]
                continue
            stability += size[node] * (1 / w - birth)
            if len(large) == 2:
                for i, z in enumerate(large):
                    descend(z, f"{name}.{i}", name, 1 / w)
            else:
                for p in under(node):
                    of[p] = name
            break
        clusters[name][1] = stability

    large_roots = [r for r in roots if size[r] >= least]
    for i, r in enumerate(large_roots):
        descend(r, f"r{i}", "root" if len(large_roots) > 1 else None, 0.0)
    chosen = set()

    def best(name):
        parent, value, below = clusters[name]
        inner = sum(best(c) for c in below)
        if parent is not None and (not below or value >= inner):
            for c in [c for c in chosen if c.startswith(name + ".")]:
                chosen.discard(c)
            chosen.add(name)
            return value
        return inner

    for name in [c for c in clusters if "." not in c]:
        best(name)
    label = {p: next((c for c in chosen if of.get(p) is not None and (of[p] + ".").startswith(c + ".")), None) for p in points}
    least_id = {}
    for p in points:
        if label[p] is not None:
            least_id[label[p]] = min(least_id.get(label[p], p), p)
    return {p: least_id.get(label[p]) for p in points}


def scattered(seed, n, dims=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (5, dims))
    x = np.concatenate([rng.normal(0, rng.uniform(0.2, 0.6), (n // 6, dims)) + c for c in centres] + [rng.uniform(-6, 6, (n - 5 * (n // 6), dims))])
    return x, np.linalg.norm(x[:, None] - x[None], axis=2)


def compare(spark, edges, points, samples, least):
    table = spark.createDataFrame(edges, "a string, b string, d double")
    got = arch.hdbscan(table, spark.createDataFrame([(p,) for p in points], "id string"), least, samples)
    got = {r.id: r.archetype for r in got.collect()}
    want = brute(edges, points, samples, least)
    assert got == want
    return want


@pytest.mark.parametrize(("n", "k", "least"), [(300, 9, 5), (500, 499, 8)], ids=["neighbours", "all pairs of 500"])
def test_labels_are_those_of_the_hierarchy(spark, n, k, least):
    _, d = scattered(n, n)
    points = [f"p{i:04}" for i in range(n)]
    edges = [(points[i], points[j], round(float(d[i, j]), 9)) for i in range(n) for j in np.argsort(d[i], kind="stable")[: k + 1] if i != j]
    want = compare(spark, edges, points, 5, least)
    assert len(set(want.values()) - {None}) >= 3 and sum(x is None for x in want.values()) > 10


def test_odd_graphs(spark):
    """Repeated points (lengths of 0), ties everywhere, a lone chain, points without edges."""
    rng = random.Random(5)
    spots = [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(40)] + [(20 + rng.randint(0, 2), 20) for _ in range(12)] + [(50 + i * i / 9, 0) for i in range(15)]
    points = [f"p{i:02}" for i in range(len(spots))]
    edges = [(points[i], points[j], math.dist(a, b)) for i, a in enumerate(spots) for j, b in enumerate(spots) if i != j and math.dist(a, b) < 9]
    compare(spark, edges, [*points, "z"], 3, 4)
    empty = spark.createDataFrame([], "a string, b string, d double")
    assert [tuple(r) for r in arch.hdbscan(empty, spark.createDataFrame([("z",)], "id string")).collect()] == [("z", None)]


def test_every_entity_has_a_row(spark, sf):
    rows = QUERIES["qc_archetypes"](spark, sf).collect()
    assert len(rows) == len({r.entity_id for r in rows}) == 500
