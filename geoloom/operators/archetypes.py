"""Density clusters of a weighted neighbour graph (HDBSCAN): mutual reachability, a minimum spanning forest, its condensed tree
and the clusters of most stability, in rounds over tables.

- ``reachability``: an edge weighs the largest of its length and of the core distances of its ends (to their ``samples``-th
  neighbour).
- ``spanning_forest``: Borůvka rounds. Each component takes its least edge, components are named by the end of the pointers that
  these edges make, and of parallel edges the least goes on. Edges have one order, (w, a, b), so the forest is unique.
- ``contracted``: what the condensed tree needs of the hierarchy is when each point came to a component of ``least`` points. A
  component that is smaller follows its least edge. If that way ends at a large one, everything on it has joined it, each part at
  the weight of its own edge; if it ends at two small ones that point to each other, these two merge, as they do in the hierarchy.
  So there are about ``least`` rounds, however long the chains are, and what remains are large components, the tree's leaves,
  and an edge for each but one of them.
- ``condensed``: the leaves' edges in order give the tree. This is the one step in a single task, over a row for each leaf; it
  makes intervals of weight for each leaf and its ancestors, into which the points fall by a join, and stabilities are sums.
- A cluster is chosen if it is more stable than the clusters chosen below it together; the root of all is none. Points outside
  of chosen clusters are noise.

A graph in several parts has a root above these, at an infinite weight. Points without edges, and parts of fewer than ``least``
points, are noise. Loops and edges with a null end or weight are left out; of repeated edges the least counts.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.lineage import table

TINY = 1e-12


def reachability(neighbours: DataFrame, samples: int) -> DataFrame:
    """a, b, w (a < b) of directed neighbour edges (a, b, d), each point's nearest samples others among them."""
    rows = neighbours.where("a <> b AND d IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    core = table(rows.withColumn("k", place).where(F.col("k") <= samples).groupBy("a").agg(F.max("d").alias("core")), "core")
    met = rows.join(core, "a").join(core.select(F.col("a").alias("b"), F.col("core").alias("core_b")), "b")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.greatest("d", "core", "core_b")).alias("w"))


def ends(pointers: DataFrame) -> DataFrame:
    """id, root: where the pointers (id, to) of each id end. Ids that point to themselves, or from which nothing points, are ends;
    two that point to each other end at the lesser. Each round looks twice as far."""
    back = pointers.select(F.col("id").alias("to"), F.col("to").alias("back"))
    now = pointers.join(back, "to", "left").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("root"))
    while True:
        now = table(now, "pointers")
        far = now.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = table(now.join(far, "root", "left").select("id", F.coalesce("far", "root").alias("far"), "root"), "pointers")
        if not step.where("far <> root").limit(1).count():
            return now
        now = step.select("id", F.col("far").alias("root"))


def _least_edges(edges: DataFrame) -> DataFrame:
    """id, e: the least edge (w, a, b, to) of each component in edges (ca, cb, w, a, b)."""
    both = [edges.select(F.col(x).alias("id"), F.struct("w", "a", "b", F.col(y).alias("to")).alias("e")) for x, y in (("ca", "cb"), ("cb", "ca"))]
    return both[0].unionByName(both[1]).groupBy("id").agg(F.min("e").alias("e"))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges with the components that names (id, root) gives, without those inside one."""
    for c in ("ca", "cb"):
        edges = edges.join(names.select(F.col("id").alias(c), F.col("root").alias(f"new_{c}")), c, "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    return edges.where("ca <> cb")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, w: the minimum spanning forest of edges (a, b, w)."""
    rows = edges.where("a <> b AND w IS NOT NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    now, forest = table(rows.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"), "boruvka"), None
    while True:
        least = table(_least_edges(now), "boruvka-least")
        if not least.limit(1).count():
            return rows.limit(0) if forest is None else forest
        found = least.select("e.a", "e.b", "e.w").distinct()
        forest = table(found if forest is None else forest.unionByName(found), "forest")
        moved = _renamed(now, ends(least.select("id", F.col("e.to").alias("to"))))
        pair = (F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
        now = table(moved.groupBy(*pair).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("ca", "cb", "e.*"), "boruvka")


def contracted(forest: DataFrame, points: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, leaf, e) of the points that come to a large component, with the edge (w, a, b) by which they do, and the edges (ca, cb, w, a, b)
    between leaves."""
    edges = table(forest.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"), "contract-edges")
    none = F.lit(None).cast("struct<w: double, a: string, b: string>")
    of = table(points.select("id", F.col("id").alias("part"), F.lit(False).alias("large"), none.alias("by")).distinct(), "contract-points")
    while True:
        parts = table(of.groupBy("part").agg(F.count("*").alias("n"), F.max("large").alias("large")), "contract-parts")
        small = parts.where("NOT large").select(F.col("part").alias("id"), "n")
        follow = table(_least_edges(edges).join(small, "id"), "contract-least")
        if not follow.limit(1).count():
            return of.where("large").select("id", F.col("part").alias("leaf"), F.col("by").alias("e")), edges
        to = follow.select("id", F.col("e.to").alias("to"), F.struct("e.w", "e.a", "e.b").alias("at"), "n")
        way = ends(to.select("id", "to"))
        big = parts.where("large").select(F.col("part").alias("root"), F.lit(True).alias("joins"))
        back = to.select(F.col("id").alias("to"), F.col("to").alias("back"), F.col("n").alias("n_back"))
        met = to.join(way, "id").join(big, "root", "left").join(back, "to", "left")
        pair = (F.col("back") == F.col("id")) & F.col("joins").isNull()
        sized = F.col("n") + F.col("n_back") >= least
        steps = met.select(
            "id", F.when(F.col("joins"), F.col("root")).when(pair, F.least("id", "to")).otherwise(F.col("id")).alias("root"),
            F.when(F.col("joins") | (pair & sized), F.col("at")).alias("at"), (F.coalesce("joins", F.lit(False)) | F.coalesce(pair & sized, F.lit(False))).alias("grown"),
        )
        steps = table(steps, "contract-steps")
        moved = of.join(steps.withColumnRenamed("id", "part"), "part", "left")
        of = table(moved.select("id", F.coalesce("root", "part").alias("part"), (F.col("large") | F.coalesce("grown", F.lit(False))).alias("large"), F.coalesce("by", "at").alias("by")), "contract-points")
        edges = table(_renamed(edges, steps), "contract-edges")


ENDLESS = (math.inf, "", "")


def _tree(leaves: pd.DataFrame) -> pd.DataFrame:
    """Rows of leaves (leaf, w, a, b) and edges (leaf, other, w, a, b) -> leaf, cluster, parent, and the edges at which the cluster
    begins (low_*) and ends (high_*), of each leaf and its ancestors."""
    alone = leaves.other.isna()
    nodes = {r.leaf: {"low": (r.w, r.a, r.b), "high": ENDLESS, "parent": None, "leaves": [r.leaf]} for r in leaves[alone].itertuples()}
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    of = {x: x for x in nodes}
    for i, r in enumerate(leaves[~alone].sort_values(["w", "a", "b"]).itertuples()):
        x, y, name, edge = find(r.leaf), find(r.other), f"+{i}", (r.w, r.a, r.b)
        for side in (of[x], of[y]):
            nodes[side] |= {"high": edge, "parent": name}
        nodes[name] = {"low": edge, "high": ENDLESS, "parent": None, "leaves": nodes[of[x]]["leaves"] + nodes[of[y]]["leaves"]}
        top[y], of[x] = x, name
    roots = [n for n, v in nodes.items() if v["parent"] is None]
    for n in roots:
        nodes[n]["parent"] = "root" if len(roots) > 1 else None
    rows = [(leaf, n, v["parent"], *v["low"], *v["high"]) for n, v in nodes.items() for leaf in v["leaves"]]
    return pd.DataFrame(rows, columns=["leaf", "cluster", "parent", *(f"{x}_{c}" for x in ("low", "high") for c in "wab")])


def _chosen(tree: pd.DataFrame) -> pd.DataFrame:
    """Rows of clusters (cluster, parent, stability) -> cluster, label: the chosen cluster that each lies in, or null."""
    value, parent = dict(zip(tree.cluster, tree.stability, strict=True)), {c: p if isinstance(p, str) else None for c, p in zip(tree.cluster, tree.parent, strict=True)}
    below: dict[str | None, list[str]] = {}
    for c, p in parent.items():
        below.setdefault(p, []).append(c)
    order = [c for c in parent if parent[c] is None or parent[c] == "root"]
    for c in order:
        order += below.get(c, [])
    best, own = {}, set()
    for c in reversed(order):
        under = sum(best[x] for x in below.get(c, []))
        if parent[c] is not None and (not below.get(c) or value[c] >= under):
            own.add(c)
            best[c] = value[c]
        else:
            best[c] = under
    label: dict[str, str | None] = {}
    for c in order:
        over = label.get(parent[c])
        label[c] = over if over is not None else c if c in own else None
    return pd.DataFrame({"cluster": order, "label": [label[c] for c in order]})


def condensed(of: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label (the chosen cluster, or null for noise) of the points in large components."""
    born = of.groupBy("leaf").agg(F.min("e").alias("e")).select("leaf", F.lit(None).cast("string").alias("other"), "e.*")
    links = edges.select(F.col("ca").alias("leaf"), F.col("cb").alias("other"), "w", "a", "b")
    tree = born.unionByName(links).groupBy().applyInPandas(_tree, "leaf string, cluster string, parent string, low_w double, low_a string, low_b string, high_w double, high_a string, high_b string")
    edge = lambda x: F.struct(*(F.col(f"{x}_{c}").alias(c) for c in "wab")).alias(x)
    tree = table(tree.select("leaf", "cluster", "parent", edge("low"), edge("high")), "condensed-tree")
    # a point counts in the cluster that it came to, from its own weight on, and in all above it, from their lowest weight on
    over = table(of.join(tree, "leaf").where(F.col("e") < F.col("high")), "condensed-points")
    gain = 1 / F.greatest("e.w", "low.w") - F.when(F.col("high.w") == math.inf, F.lit(0.0)).otherwise(1 / F.col("high.w"))
    sums = over.groupBy("cluster", "parent").agg(F.sum(gain).alias("stability"))
    labels = sums.groupBy().applyInPandas(_chosen, "cluster string, label string")
    return over.where(F.col("e") >= F.col("low")).select("id", "cluster").join(labels, "cluster", "left").select("id", "label")


def hdbscan(neighbours: DataFrame, points: DataFrame, least: int = 5, samples: int = 5) -> DataFrame:
    """id, archetype of the points (id): the least id of its cluster, or null for noise. neighbours: edges (a, b, d) to each
    point's nearest others, samples of them or more."""
    # ids are compared as text throughout, so that edges have one order
    near = neighbours.select(*(F.col(c).cast("string").alias(c) for c in "ab"), F.greatest(F.col("d").cast("double"), F.lit(TINY)).alias("d"))
    forest = spanning_forest(table(reachability(near, samples), "reachability"))
    labels = table(condensed(*contracted(forest, points.select(F.col("id").cast("string").alias("id")), least)), "labels")
    names = labels.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("archetype"))
    named = labels.join(names, "label").select(F.col("id").alias("_id"), "archetype")
    return points.join(named, F.col("id").cast("string") == F.col("_id"), "left").select("id", "archetype")
