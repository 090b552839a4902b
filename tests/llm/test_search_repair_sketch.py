"""Operators 11 to 13 against plain Python: contracts on the small tables, odd cases, methods."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cases import EXTRA, none, odd  # noqa: F401

from geoloom.llm import conversation_repair as repair
from geoloom.llm import fingerprints as prints
from geoloom.llm import lexical_search as search
from geoloom.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


# --- ranked search --------------------------------------------------------------------------------------------------------


def ranked(docs, items, k):
    words = [(key, TERM.findall(lower(text))) for key, text in docs]
    n_docs, length = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    terms = {}
    for key, text in items:
        terms.setdefault(key, set()).update(TERM.findall(lower(text)))
    out = []
    for item, own in terms.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        found = []
        for key, w in words:
            tf, m = Counter(w), w and 100 - 50 + 50 * len(w) * n_docs // length
            score = sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -score) for i, (score, _, _, key) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_search(spark, sf):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    assert rows_of(QUERIES["op11_lexical_search"](spark, sf)) == ranked(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), 50)


def test_search_cases(spark, odd, none):  # noqa: F811
    texts = [r.text for r in odd.where("doc_id in (1, 6)").collect()]
    items = [(1, texts[0]), (2, texts[-1]), (2, "password ONE"), (3, None), (4, " .,"), (None, "one é"), (5, "nowhere"), (6, "é" * 5000), (7, "endoftext")]
    table = spark.createDataFrame([(*x, 5, 6) for x in items], "item_id long, text string, score int, rank int")
    want = ranked([(r.doc_id, r.text) for r in odd.collect()], items, 3)
    assert rows_of(search.search(odd, table, k=3)) == want
    assert rows_of(search.search(odd, table, k=3, block_terms=40)) == want
    assert search.search(none, table).count() == 0 == search.search(odd, table.limit(0)).count()


def test_ties_by_document(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (9, 4, 7, None, 4)] + [(1, "other")], "doc_id long, text string")
    got = rows_of(search.search(docs, spark.createDataFrame([(1, "same")], "item_id long, text string"), k=4))
    assert [(r, d) for _, r, d, _ in got] == [(1, 4), (2, 4), (3, 7), (4, 9)] and len({s for *_, s in got}) == 1


@pytest.mark.parametrize("seed", range(20))
def test_sharing_plan_adds_up(seed):
    rng = random.Random(seed)
    n_terms, common = rng.randint(1, 60), [set(rng.sample(range(200), 8)) for _ in range(5)]
    sets = [{t % n_terms for t in rng.sample(range(200), rng.randint(1, 9)) + list(rng.choice(common))} for _ in range(rng.randint(1, 30))]
    plan = search.SharingPlan(sets, n_terms)
    doc, term = np.array([(d, t) for d in range(7) for t in range(n_terms) if rng.random() < 0.5] or [(0, 0)]).T
    part = np.array([rng.randint(0, 10**12) for _ in doc], np.int64)
    want = [[sum(int(p) for d, t, p in zip(doc, term, part, strict=True) if d == i and t in s) for i in range(7)] for s in sets]
    assert plan.scores(doc, term, part, 7).tolist() == want


def test_shared_sets_are_added_once():
    """Items that are parts of each other cost one addition for each further part, not one for each term."""
    sets = [set(range(10 * (i + 1))) for i in range(12)]
    plan = search.SharingPlan(sets, 120)
    added = sum(len(level[0]) for level in plan.levels) + len(plan.nodes) - len(sets)
    assert plan.n_bundles == 12 and added < sum(range(12)) / 2


# --- conversations --------------------------------------------------------------------------------------------------------

MOVES = {("b", "s"): "s", ("b", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """rows: (role, text, must_go, truncated) -> (cost, audit), by a search over (row, state) in the order of (cost, audit)."""
    heap, seen = [(0, "", 0, "b")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in "ba":
            return cost, audit
        for x in "ua":
            if (state, x) in MOVES:
                heapq.heappush(heap, (cost + 2, audit + "I", i, MOVES[state, x]))
        if i < len(rows):
            role, _, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                if (state, role[:1]) in MOVES:
                    heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, MOVES[state, role[:1]]))
                for x in "ua":
                    if (state, x) in MOVES:
                        heapq.heappush(heap, (cost + truncated + 2, audit + "R", i + 1, MOVES[state, x]))
    raise AssertionError


def repaired_text(rows, audit):
    out, i, shift = [], 0, 0
    for edit in audit:
        due = ("user", "assistant")[(len(out) + shift) % 2]
        if edit == "I":
            out.append(f"{due}:")
            continue
        role, text, *_ = rows[i]
        i += 1
        if edit == "K":
            shift = shift or int(not out and role[:1] == "s")
            out.append(f"{role}:{text}")
        elif edit == "R":
            out.append(f"{due}:{text}")
    return "\n".join(out)


def conversation(rows, damage=True):
    """(conv_id, turn, role, text) of one conversation -> the query's row."""
    after = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        after += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, judged, counts = set(), [], Counter()
    for _, role, text in after:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in after if t is not None}
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
    cost, audit = cheapest(judged)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(repaired_text(judged, audit).encode()).hexdigest())


def conversations(rows, damage=True):
    every = {}
    for r in rows:
        every.setdefault(r[0], []).append(r)
    return {k: conversation(v, damage) for k, v in every.items()}


def found_in(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_conversations(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert found_in(QUERIES["op12_conversation_repair"](spark, sf)) == conversations(rows)


def odd_conversations(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "umpire", "User"], ["Fine.", "Why?", "cut off", "", " \n", None, "é!", "x" * 3000 + "."]
    turns = lambda: rng.choice([None, *range(-2, 9)])
    out = [(c, turns(), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.") for c in (None, *range(40)) for _ in range(rng.randint(1, 9))]
    return out + out[:5]


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_odd_conversations(spark, size):
    rows = odd_conversations(size)
    table = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "conv_id long, turn long, role string, text string, part int, digest string, n int").repartition(5)
    assert found_in(repair.repaired(repair.damaged(table), table, size)) == conversations(rows)
    empty = table.limit(0)
    assert repair.repaired(repair.damaged(empty), empty).count() == 0


def test_a_long_conversation_is_divided(spark):
    """One conversation of thousands of turns, in many ranges and portions, with edits all along; and texts of a megabyte."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Go on.", f"Turn {i}.", f"cut {i}", ""])) for i in range(2500)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", "y" * 1_000_000 + f" {i}.") for i in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = repair.portions(repair.judged(repair.damaged(table)), 100).collect()
    assert sum(p.conv_id == 1 for p in parts) > 20 and sum(p.n for p in parts) == repair.damaged(table).count()
    assert found_in(repair.repaired(repair.damaged(table), table, 100)) == conversations(rows)


def test_every_edit_sequence_of_short_conversations():
    """The stack graph's choice against all edit sequences, with up to two inserts between rows."""
    grammar = re.compile("(s?(ua)+)?")
    for initials in itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(4)):
        for cut in {(False,) * len(initials), tuple(i % 2 == 0 for i in range(len(initials)))}:
            options = [[("D", 3, "")] + [("K", t, x)] + [("R", 2 + t, y) for y in "ua"] for x, t in zip(initials, cut, strict=True)]
            inserts = [("I" * len(x), 2 * len(x), x) for x in ("", "u", "a", "ua", "au")]
            best = (99, "")
            for chosen in itertools.product(inserts, *(itertools.product(o, inserts) for o in options)):
                steps = [chosen[0], *(s for pair in chosen[1:] for s in pair)]
                if grammar.fullmatch("".join(s[2] for s in steps)):
                    best = min(best, (sum(s[1] for s in steps), "".join(s[0] for s in steps)))
            graph = repair.StackGraph()
            for x, t in zip(initials, cut, strict=True):
                graph.read(x, False, t)
            assert graph.best() == best


# --- fingerprints ---------------------------------------------------------------------------------------------------------


def sketch(text, k=prints.K, width=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    grams = {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return sorted(hashlib.md5(g.encode()).hexdigest()[:16] for g in grams)[:k]


def alike(a, b, k=prints.K):
    both = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*both}) / len(both) if both else 1.0


def printed(rows):
    """(doc_id, text) in the query's order -> the query's rows."""
    out = []
    for i, (key, text) in enumerate(rows):
        after, text = rows[(i + 1) % len(rows)][1] or "", text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, c)))
    return sorted(out, key=str)


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints(spark, sf):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda r: -r[0])
    assert sorted((tuple(r[c] for c in FIELDS) for r in QUERIES["op13_fingerprints"](spark, sf).collect()), key=str) == printed(rows)


def test_fingerprint_cases(spark, odd, none):  # noqa: F811
    order = {(r.doc_id, r.text): r.h for r in odd.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), order[r]))
    for size in (2, 2048):
        assert sorted((tuple(r[c] for c in FIELDS) for r in prints.fingerprints(odd, size).collect()), key=str) == printed(rows)
    assert prints.fingerprints(none).count() == 0
    alone = spark.createDataFrame([(3, "one two three")], "doc_id long, text string")
    assert prints.fingerprints(alone).first().near_next == 1.0
    repeated = spark.createDataFrame([(1, "a b c d e " * 4000 + " ".join(map(str, range(300))))], "doc_id long, text string")
    assert prints.fingerprints(repeated).first().fingerprint == "".join(sketch(repeated.first().text))


def test_fingerprints_are_native(spark, sf):
    plan = QUERIES["op13_fingerprints"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_merged_sketches_and_estimates(spark):
    """The sketch of parts is the sketch of their union; estimates are near the true values."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(9000)]
    shingles = lambda a, b: {" ".join(words[i : i + 5]) for i in range(a, b - 4)}
    left, right = (0, 6000), (3000, 9000)
    parts = [(k, " ".join(words[i : min(i + 504, b)])) for k, (a, b) in (("l", left), ("r", right)) for i in range(a, b, 500)]
    rng.shuffle(parts)
    made = prints.with_sketch(spark.createDataFrame(parts, "k string, text string"), "text", "sketch")
    both = {r.k: r.sketch for r in prints.merged(made, "sketch", "k").collect()}
    want = {k: sketch(" ".join(words[a:b])) for k, (a, b) in (("l", left), ("r", right))}
    assert both == want
    one = spark.createDataFrame([(both["l"], both["r"])], "a array<string>, b array<string>")
    got = one.select(*(f.alias(n) for n, f in (("count", prints.shingle_count("a")), ("j", prints.resemblance("a", "b")), ("c", prints.containment("a", "b"))))).first()
    a, b = shingles(*left), shingles(*right)
    assert got["count"] == pytest.approx(len(a), rel=0.4) and got.j == pytest.approx(len(a & b) / len(a | b), abs=0.2) and got.c == pytest.approx(len(a & b) / len(a), abs=0.25)
