"""Ranked lexical search for many queries at once, with common subexpressions evaluated once.

A document's score for an item is a sum over the item's terms, so items that share terms share parts of their sums. The
terms of a block of items are laid out as a query-sharing graph (see SharingPlan): terms that the same items hold make one
bundle; of the bundles, ordered by how many items hold them, neighbouring pairs that two items or more have in common are
mined round after round and become nodes. Over a batch of documents each node's accumulator is added up once, from the
terms' contributions or from its two parts, and an item adds the few nodes that are left of it.

Documents are read as texts once for each block, to the counts of the items' terms, which are written; document counts and
lengths come from that table by partial sums, scores from a second reading of it. A task keeps the k best documents of each
item and sends only those; they meet by parts of an item's list before the last cut, so no task takes all lists of an item.

Items are the stated query set: they come in blocks of about BLOCK_TERMS term occurrences by a hash of item_id, one block at
a time at the driver, and any number of blocks is gone through. An item's own terms are never divided.

Defined cases: null and empty texts have no terms; an item without terms, or whose terms no document holds, has no rows;
rows of one item_id are one item, null item_id is an item too; rows of one doc_id are documents of their own and may come
with the same doc_id at two ranks, null doc_id is after all others of its score; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import byte_rows, slices, table, tidied, written

K = 50
BLOCK_TERMS = 300_000
#: Accumulators held at once in a task, as numbers.
CELLS = 4_000_000
#: An item's lists meet in so many parts before the last cut.
MERGES = 32
#: Bytes of terms, A-Z lowered; all others become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class SharingPlan:
    """The graph of a block of items, given as sets of term numbers below n_terms.

    Nodes are numbered bundles first, then pairs. bundle[t] is the node of term t; pairs come in levels of (node, left, right)
    arrays, each of which needs earlier levels only; item i adds nodes[starts[i]:starts[i + 1]].
    """

    def __init__(self, sets: list[set[int]], n_terms: int):
        holders: list[list[int]] = [[] for _ in range(n_terms)]
        for i, terms in enumerate(sets):
            for t in terms:
                holders[t].append(i)
        bundles: dict[tuple[int, ...], int] = {}
        self.bundle = np.array([bundles.setdefault(tuple(h), len(bundles)) for h in holders], np.int64)
        lists: list[list[int]] = [[] for _ in sets]
        for held, node in sorted(bundles.items(), key=lambda x: (-len(x[0]), x[1])):
            for i in held:
                lists[i].append(node)
        self.n_bundles = self.n_nodes = len(bundles)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while pairs := self._pair(lists):
            made = np.array([(node, a, b) for (a, b), node in pairs.items()], np.int64)
            self.levels.append((made[:, 0], made[:, 1], made[:, 2]))
        self.nodes = np.array([x for nodes in lists for x in nodes], np.int64)
        self.starts = np.cumsum([0, *map(len, lists)])

    def _pair(self, lists: list[list[int]]) -> dict[tuple[int, int], int]:
        """Merges neighbours that two lists or more have in common; the more common of two overlapping pairs goes first."""
        common = {p: n for p, n in Counter(p for nodes in lists for p in zip(nodes, nodes[1:], strict=False)).items() if n > 1}
        made: dict[tuple[int, int], int] = {}
        for nodes in lists if common else ():
            at, out = 0, []
            while at < len(nodes):
                pair = tuple(nodes[at : at + 2])
                if common.get(pair, 0) > 0 and common[pair] >= common.get(tuple(nodes[at + 1 : at + 3]), 0):
                    if pair not in made:
                        made[pair], self.n_nodes = self.n_nodes, self.n_nodes + 1
                    out.append(made[pair])
                    at += 2
                else:
                    out.append(nodes[at])
                    at += 1
            nodes[:] = out
        return made

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int) -> np.ndarray:
        """(items, documents): the sums of the parts that terms give documents."""
        sums = np.zeros((self.n_nodes, n_docs), np.int64)
        np.add.at(sums.reshape(-1), self.bundle[term] * n_docs + doc, part)
        for node, left, right in self.levels:
            sums[node] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.nodes], self.starts[:-1], axis=0)


class Best:
    """The k best (score, doc_id) of each of n items so far; equal scores by doc_id, nulls last."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least = n, k, np.ones(n, np.int64)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def add(self, scores: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if len(item):
            self.rows = [np.concatenate(x) for x in zip(self.rows, (item, scores[item, doc], doc_id[doc], null[doc]), strict=True)]
            self.cut()

    def cut(self) -> None:
        item, score, doc_id, null = self.rows
        order = np.lexsort((doc_id, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.n))
        place = np.arange(len(item)) - first[item]
        kept = order[place < self.k]
        self.rows = [x[kept] for x in self.rows]
        last = place == self.k - 1
        self.least[item[last]] = score[order][last]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (binary, each once), for items with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [list(set(terms_of(x))) for x in byte_rows(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(tidied(run), "item_id long, terms array<binary>")
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def term_counts(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts of the numbered terms that a document holds. numbers: a broadcast
    mapping of terms to numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_terms = numbers.value, max(1, len(numbers.value))
        for batch in batches:
            for part in slices(batch):
                n, found, owners = [], [], []
                for text in byte_rows(part.column(1)):
                    words = terms_of(text)
                    own = [known[w] for w in words if w in known]
                    n.append(len(words))
                    found += own
                    owners.append(len(own))
                key, count = np.unique(np.repeat(np.arange(len(n)), owners) * n_terms + np.array(found, np.int64), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * n_terms), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % n_terms, count))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n long, terms array<int>, counts array<int>")


def best_of_tasks(counts: DataFrame, plan, weights, n_docs: int, length: int, n_items: int, k: int) -> DataFrame:
    """item (its place in the block), doc_id, score: each task's k best documents of each item. plan, weights: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, w, best = plan.value, weights.value, Best(n_items, k)
        for batch in batches:
            for part in slices(batch, max(1, min(4096, CELLS // shared.n_nodes))):
                doc_id, n, terms, tf = part.columns
                m = 50 + 50 * n.to_numpy() * n_docs // length
                doc = np.repeat(np.arange(len(part)), np.diff(terms.offsets.to_numpy()))
                term, tf = terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)
                gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                best.add(shared.scores(doc, term, gain, len(part)), doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False))
        item, score, key, null = best.rows
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(key, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return counts.where("size(terms) > 0").select("doc_id", "n", "terms", "counts").mapInArrow(tidied(run), "item int, doc_id long, score long")


def best(rows: DataFrame, k: int, *by) -> DataFrame:
    """The k best rows of each group with their rank; tasks keep k of each before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    listed = written(item_terms(items), "item-terms")
    blocks = max(1, math.ceil((listed.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_terms terms
        own.sort(key=lambda r: (r.item_id is not None, r.item_id))
        numbers: dict[bytes, int] = {}
        sets = [{numbers.setdefault(bytes(t), len(numbers)) for t in sorted(r.terms)} for r in own]
        if not sets:
            continue
        counts = written(term_counts(docs, spark.sparkContext.broadcast(numbers)), "term-counts")
        n_docs, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(numbers), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block at most
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        plan = spark.sparkContext.broadcast(SharingPlan(sets, len(numbers)))
        found = best_of_tasks(counts, plan, spark.sparkContext.broadcast(weight), n_docs, max(length, 1), len(sets), k)
        parts = best(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))), k, "item", "part").drop("rank")
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], "item int, item_id long")
        out = out.unionByName(best(parts, k, "item").join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS words FROM documents),
s AS (SELECT count(*) FILTER (len(words) > 0)::BIGINT AS n_docs, sum(len(words))::BIGINT AS length FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
g AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))) AS gain FROM t JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
