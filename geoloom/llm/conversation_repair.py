"""Repair of a conversation's structure by generalised LR parsing with weighted edits.

Role initials of a conversation have to spell ``(s?(ua)+)?``, given as a grammar with its LR tables below. A graph-structured
stack reads the rows: every row may be kept, reroled or deleted, and turns with empty texts may be inserted anywhere. Stacks
with one state at their top share that top; what lies beneath is shared too, and of histories that lead to equal stacks the
one of least (cost, audit) goes on. The audit names the edits in order (K, R, D, I); at the end the least of the stacks that
the grammar accepts is taken. An audit gives its repair: the n-th turn that is left has the role of its place.

Rows are sorted by conversation and turn in ranges, so that a long conversation is divided between tasks. Tasks go through
their range as a stream and sum up portions of at most PORTION rows: for every stack at a portion's start that the grammar
admits, the least edits to every stack at its end. A conversation within one portion is done there; the portions of others
are put together in order, a portion's sums being a byte for each row, and their rows are hashed as a sorted stream (a
digest is made from front to back, by one task for each conversation). Repeats of a text come from the least turn of each
(conversation, role, text), not from a conversation's rows in memory.

Defined cases: null role and text count as one space, so do null conv_id and turn in the damage's key; null turns come
first, rows of one turn by role and then by the digest of the text; rows that are equal are copies, kept all; a null conv_id
is a conversation too; roles with other initials than s, u, a can't be kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import SPACES, table, tidied, written

# Conv -> (nothing) | Turns | s Turns;  Turns -> Pair | Turns Pair;  Pair -> u a
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 6, (3, "u"): 2, (5, "u"): 2}
REDUCE = {4: ("Turns", 1), 6: ("Pair", 2), 7: ("Turns", 2)}
GOTO = {(0, "Turns"): 3, (0, "Pair"): 4, (1, "Turns"): 5, (1, "Pair"): 4, (3, "Pair"): 7, (5, "Pair"): 7}
#: States in which the end of the conversation completes Conv.
ACCEPT = {0, 3, 5}

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NAMES = {"u": "user", "a": "assistant"}
PORTION = 1024
PORTION_BYTES = 4_000_000

Stack = tuple  # (state, the stack beneath or None)
Label = tuple[int, str]  # (cost, audit)


def pushed(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a symbol, with all reductions made; None where the grammar doesn't admit it."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        made, length = REDUCE[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (GOTO[stack[0], made], stack)
    return stack


def _admitted() -> list[Stack]:
    found = [(0, None)]
    for stack in found:
        found += [x for s in "sua" if (x := pushed(stack, s)) and x not in found]
    return found


#: The stacks between two rows; the grammar has but a few.
ADMITTED = _admitted()


class StackGraph:
    """Tops by state, each with the stacks beneath it and the least label of the histories through that edge."""

    def __init__(self, stack: Stack = (0, None)):
        self.tops: dict[int, dict[Stack | None, Label]] = {}
        self.merge(stack, (0, ""))

    def merge(self, stack: Stack, label: Label) -> bool:
        edges = self.tops.setdefault(stack[0], {})
        if stack[1] in edges and edges[stack[1]] <= label:
            return False
        edges[stack[1]] = label
        return True

    def stacks(self) -> list[tuple[Stack, Label]]:
        return [((state, below), label) for state, edges in self.tops.items() for below, label in edges.items()]

    def insert(self) -> None:
        """All inserts before the next row."""
        todo = self.stacks()
        while todo:
            stack, (cost, audit) = todo.pop()
            for symbol in NAMES:
                if after := pushed(stack, symbol):
                    label = (cost + INSERT, audit + "I")
                    if self.merge(after, label):
                        todo.append((after, label))

    def read(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.insert()
        before, self.tops = self.stacks(), {}
        kept = truncated * TRUNCATED
        for stack, (cost, audit) in before:
            self.merge(stack, (cost + DELETE, audit + "D"))
            if not must_go:
                if after := pushed(stack, initial):
                    self.merge(after, (cost + kept, audit + "K"))
                for symbol in NAMES:
                    if after := pushed(stack, symbol):
                        self.merge(after, (cost + kept + REROLE, audit + "R"))

    def best(self) -> Label:
        self.insert()
        return min(label for stack, label in self.stacks() if stack[0] in ACCEPT)


class Repaired:
    """The digest of a conversation's repair, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.turns, self.shift, self.digest = audit, 0, 0, 0, hashlib.sha256()

    def _turn(self, role: str | None, text: str) -> None:
        role = role if role is not None else NAMES["ua"[(self.turns + self.shift) % 2]]
        self.digest.update(("\n" * (self.turns > 0) + f"{role}:{text}").encode())
        self.turns += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._turn(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            if not self.turns and role[:1] == "s":
                self.shift = 1
            self._turn(role, text)
        elif edit == "R":
            self._turn(None, text)

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


# --- damage and faults ----------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of each row's key deals out."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(fate == 4, "user").otherwise(said("role"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.where(fate != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies).drop("copy")


ORDER = ("conv_id", "turn", "role", "digest")
ROWS = ["conv_id", "turn", "role", "text", "digest", "blank", "repeats", "truncated"]


def judged(rows: DataFrame) -> DataFrame:
    """ROWS: digest of the text, whether it is blank, whether an earlier turn has role and text, whether it is cut off."""
    bare = F.translate("text", SPACES, "")
    last = F.substring(bare, -1, 1)
    out = rows.select("conv_id", "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"), (bare == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    when = F.min(F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"))).alias("first")
    often = out.groupBy("conv_id", "role", "digest").agg(when, F.count("*").alias("n")).where("n > 1")
    often = often.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = out.join(often, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    earlier = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))  # copies within the first turn meet in the stream
    return met.withColumn("repeats", F.coalesce(earlier, F.lit(False))).select(*ROWS)


# --- portions -------------------------------------------------------------------------------------------------------------

PATHS = "paths array<struct<entry: int, leave: int, cost: long, audit: string>>"
PORTIONS = f"conv_id long, part int, no int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, {PATHS}, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class Portion:
    """Counts and paths of neighbouring rows of one conversation. entries: the stacks that may lie before it."""

    def __init__(self, conv_id: int | None, entries: list[Stack], size: int):
        self.size, self.conv_id, self.graphs, self.rows, self.bytes = size, conv_id, [(e, StackGraph(e)) for e in entries], [], 0
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn, role: str, text: str, blank: bool, repeats: bool, truncated: bool) -> None:
        initial = role[:1]
        repeats, truncated = repeats and not blank, truncated and not blank and not repeats
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeats, self.truncated + truncated
        if self.n:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last, self.n = initial, self.n + 1
        for _, graph in self.graphs:
            graph.read(initial, blank or repeats, truncated)
        self.rows.append((role, text))
        self.bytes += len(text)

    def full(self) -> bool:
        return self.n >= self.size or self.bytes >= PORTION_BYTES

    def row(self, part: int, no: int, whole: bool) -> dict:
        paths, digest = [], None
        if whole:
            cost, audit = self.graphs[0][1].best()
            repaired = Repaired(audit)
            for role, text in self.rows:
                repaired.row(role, text)
            paths, digest = [{"entry": 0, "leave": 0, "cost": cost, "audit": audit}], repaired.end()
        else:
            for entry, graph in self.graphs:
                paths += [{"entry": ADMITTED.index(entry), "leave": ADMITTED.index(stack), "cost": cost, "audit": audit} for stack, (cost, audit) in graph.stacks()]
        counts = {k: getattr(self, k) for k in ("conv_id", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")}
        return counts | {"part": part, "no": no, "paths": paths, "repaired_sha256": digest}


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def portions(rows: DataFrame, size: int = PORTION) -> DataFrame:
    """Rows in ranges of their order, summed up by portions (PORTIONS). One with repaired_sha256 is a whole conversation."""
    kinds = _arrow(PORTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, now, done, before, whole = TaskContext.get().partitionId(), 0, None, [], None, False

        def close(ends: bool) -> None:
            nonlocal no
            done.append(now.row(part, no, whole and ends))
            no += 1

        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[c] for c in ORDER)
                if now is None or now.conv_id != r["conv_id"]:
                    # the first conversation of a range may have begun in the range before
                    if now is not None:
                        close(True)
                    whole = now is not None
                    now = Portion(r["conv_id"], ADMITTED[:1] if whole else ADMITTED, size)
                elif now.full():
                    close(False)
                    whole, now = False, Portion(r["conv_id"], ADMITTED, size)
                now.add(r["turn"], r["role"], r["text"], r["blank"], r["repeats"] or key == before, r["truncated"])
                before = key
                if len(done) >= 2000:
                    yield pa.RecordBatch.from_pylist(done, schema=kinds)
                    done.clear()
        if now is not None:
            close(False)  # and the last may go on in the range behind
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(tidied(run), PORTIONS)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def joined(parts: DataFrame) -> DataFrame:
    """The portions of each conversation put together in order: RESULT."""

    def join(key, rows):
        import pandas as pd

        rows = rows.sort_values(["part", "no"])
        labels = {0: (0, "")}
        for paths in rows.paths:
            after: dict[int, Label] = {}
            for p in paths:
                if p["entry"] in labels:
                    cost, audit = labels[p["entry"]]
                    label = (cost + p["cost"], audit + p["audit"])
                    after[p["leave"]] = min(after.get(p["leave"], label), label)
            labels = after
        end = StackGraph()
        end.tops = {}
        for i, label in labels.items():
            end.merge(ADMITTED[i], label)
        cost, audit = end.best()
        counts = {k: int(rows[k].sum()) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        counts["illegal"] += sum(a + b not in LEGAL for a, b in zip(rows["last"][:-1], rows["first"][1:], strict=True))
        turns = [(int(a), int(b)) for a, b in zip(rows.low, rows.high, strict=True) if not pd.isna(a)]
        own = counts.pop("turns") - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
        gaps = turns[-1][1] - turns[0][0] + 1 - own if turns else 0
        return pd.DataFrame([{"conv_id": key[0], "gaps": gaps, **counts, "cost": cost, "audit": audit}])

    return parts.groupBy("conv_id").applyInPandas(join, RESULT)


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the conversations in audits (conv_id, audit): a stream of each one's audit and rows."""
    kinds = _arrow("conv_id long, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": now.end()}], schema=kinds)

        for batch in batches:
            for r in batch.to_pylist():
                if r["audit"] is not None:
                    if now is not None:
                        yield made()
                    now, conv = Repaired(r["audit"]), r["conv_id"]
                else:
                    now.row(r["role"], r["text"])
        if now is not None:
            yield made()

    own = rows.join(audits.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    columns = ("conv_id", "turn", "role", "digest", "text")
    heads = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), "audit")
    both = heads.unionByName(own.select(*columns, F.lit(None).cast("string").alias("audit")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER[1:]).mapInArrow(tidied(run), "conv_id long, repaired_sha256 string")


def repaired(rows: DataFrame, every: DataFrame, size: int = PORTION) -> DataFrame:
    """The faults and the cheapest repair of rows (conv_id, turn, role, text), for the conv_ids in every: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. size: the rows of a portion."""
    rows = written(judged(rows), "turns")
    summed = written(portions(rows, size), "portions")
    long = lambda c: F.col(c).cast("long").alias(c)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    head = F.get("paths", F.lit(0))
    whole = summed.where("repaired_sha256 is not null").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", head.cost.alias("cost"), head.audit.alias("audit"), "repaired_sha256")
    rest = written(joined(summed.where("repaired_sha256 is null")), "joined-portions")
    hashed = digests(rows, rest).withColumnRenamed("conv_id", "c")
    rest = rest.join(hashed, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    found = whole.unionByName(rest)
    ids = every.select(F.col("conv_id").cast("long").alias("c")).distinct()
    out = ids.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    count = lambda c: F.coalesce(long(c), F.lit(0).cast("long")).alias(c)

    def text(c: str, empty: Column) -> Column:
        return F.coalesce(c, empty).alias(c)

    return out.select(F.col("c").alias("conv_id"), *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), text("audit", F.lit("")), text("repaired_sha256", F.sha2(F.lit(""), 256)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired(damaged(rows), rows)


# --- SQL: the grammar as four states, b (nothing), s, u (a reply is due), a (a pair is complete) ----------------------------

_MOVES = ", ".join(f"('{a}', '{x}', '{b}')" for a, x, b in ("bss", "buu", "suu", "uaa", "auu"))
_INSERTS = ", ".join(f"('{a}', '{b}', {2 * n}, '{'I' * n}')" for a, b, n in [*((x, x, 0) for x in "bsua"), ("b", "u", 1), ("s", "u", 1), ("u", "a", 1), ("a", "u", 1), ("b", "a", 2), ("s", "a", 2), ("u", "u", 2), ("a", "a", 2)])
OP12_SQL = f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: unicode(key[i]))::BIGINT[]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fate FROM raw),
dam AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE fate <> 0),
ord AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER c AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k, lag(left(role, 1)) OVER c AS prev
  FROM dam WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
r AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT blank AND k > 1 AS dup, NOT blank AND k = 1 AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM ord),
m(a, x, b) AS (VALUES {_MOVES}), ins(a, b, c, o) AS (VALUES {_INSERTS}),
step AS (SELECT conv_id, i, m.a, m.b, cut::INT AS c, 'K' AS o FROM r JOIN m ON x = ini WHERE NOT blank AND NOT dup UNION ALL
  SELECT conv_id, i, m.a, m.b, 2 + cut::INT, 'R' FROM r, m WHERE x <> 's' AND NOT blank AND NOT dup UNION ALL SELECT conv_id, i, s, s, 3, 'D' FROM r, (VALUES ('b'), ('s'), ('u'), ('a')) t(s)),
full_step AS (SELECT conv_id, i, ins.a, step.b, ins.c + step.c AS c, ins.o || step.o AS o FROM step JOIN ins ON ins.b = step.a),
dp(conv_id, i, st, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 'b', {{'c': 0::BIGINT, 'o': ''}} FROM r UNION ALL
  SELECT d.conv_id, d.i + 1, f.b, min({{'c': d.best.c + f.c, 'o': d.best.o || f.o}}) FROM dp d JOIN full_step f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 AND f.a = d.st GROUP BY d.conv_id, d.i, f.b),
agg AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated, count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
fin AS (SELECT a.conv_id, min({{'c': best.c + ins.c, 'o': best.o || ins.o}}) AS best FROM agg a JOIN dp ON dp.conv_id IS NOT DISTINCT FROM a.conv_id AND dp.i = a.n JOIN ins ON ins.a = dp.st AND ins.b IN ('b', 'a') GROUP BY a.conv_id),
ops AS (SELECT conv_id, unnest(regexp_extract_all(best.o, 'I*[KRD]|I+$')) AS piece, generate_subscripts(regexp_extract_all(best.o, 'I*[KRD]|I+$'), 1) AS i FROM fin),
turns AS (SELECT ops.conv_id, ops.i, j, substr(piece, j, 1) AS o, r.role, r.text, r.ini FROM ops, LATERAL (SELECT unnest(range(1, length(piece) + 1)) AS j) LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ops.conv_id AND r.i = ops.i),
left_ AS (SELECT *, row_number() OVER w - 1 AS e, first_value(CASE WHEN o = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER w AS shift FROM turns WHERE o <> 'D' WINDOW w AS (PARTITION BY conv_id ORDER BY i, j)),
said AS (SELECT conv_id, sha256(string_agg(CASE WHEN o = 'K' THEN role WHEN (e + shift) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN o = 'I' THEN '' ELSE text END, chr(10) ORDER BY i, j)) AS h FROM left_ GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(fin.best.c, 0)::BIGINT AS cost, coalesce(fin.best.o, '') AS audit, coalesce(said.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM c.conv_id
"""
