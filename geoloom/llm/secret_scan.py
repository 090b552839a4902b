"""Secret scans through a trigram index, in DataFrame functions.

Of each rule's expression a Boolean query of trigrams is derived (see trigrams). The index holds a posting (text, trigram)
for every text and every trigram that some query names; a rule's conjunctions are intersected on it by one aggregation, and
the rule's expression runs only over the texts that remain. Rules without mandatory trigrams (runs of hex digits) are
matched against every text, in the same pass, and have a posting of their own. Texts are named by a digest: postings of
copies meet in one group, copies are verified each, and one set of spans is kept for them.

Spans come from the lengths of the pieces between matches, so matches are leftmost and do not overlap within a kind;
matches below a rule's length are dropped after that. Positions are code points, ends are exclusive.

Defined cases: null counts as empty and has no spans; each row gives a row, whatever its doc_id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import table, written
from geoloom.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at_least characters. prefilter: what every counted match contains, if tighter.

    No expression starts with an unbounded run, nor has one that further starts lie in and that may fail behind it: each start
    would go through the run anew, and a long run of letters or digits would take time with its square."""

    kind: str
    regex: str
    at_least: int = 1
    group: int = 0
    prefilter: str = ""


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 8, 2), Rule("access", r"AKIA[A-Z0-9]+", 16), Rule("hex", r"[0-9a-f]+", 32, prefilter="[0-9a-f]{32}"))
#: Published forms of keys and tokens (fixed values).
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("forge_fine", r"github_pat_[A-Za-z0-9_]+", 60),
    Rule("forge_lab", r"glpat-[A-Za-z0-9_-]+", 26),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("chat_hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+", 60),
    Rule("chat_bot", r"[0-9]{1,20}:AA[A-Za-z0-9_-]+", 43, prefilter=r"[0-9]:AA[A-Za-z0-9_-]{30}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{1,500}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("age_key", r"AGE-SECRET-KEY-1[A-Z0-9]+", 74),
    Rule("cloud_api", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("cloud_oauth", r"ya29\.[A-Za-z0-9_-]+", 30),
    Rule("cloud_session", r"ASIA[A-Z0-9]+", 20),
    Rule("cloud_account", r"AccountKey=[A-Za-z0-9+/=]+", 60),
    Rule("cloud_droplet", r"do[por]_v1_[a-f0-9]+", 70),
    Rule("pay", r"[sr]k_(?:live|test)_[A-Za-z0-9]+", 24),
    Rule("shop", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]+", 38),
    Rule("square", r"sq0(?:atp|csp)-[A-Za-z0-9_-]+", 29),
    Rule("mail", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
    Rule("mail_gun", r"key-[a-f0-9]+", 36),
    Rule("package", r"npm_[A-Za-z0-9]+", 40),
    Rule("package_index", r"pypi-AgE[A-Za-z0-9_-]+", 60),
    Rule("model_hub", r"hf_[A-Za-z]+", 37),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]+", 28),
    Rule("url_login", r"[a-z]{1,20}://[A-Za-z0-9_.-]+:[^\x20\x09-\x0D/@:\"'<>]+@[A-Za-z0-9.-]+", 12),
)


def postings(texts: DataFrame, grams: list[str], others: dict[str, str]) -> DataFrame:
    """(digest, gram) for the grams that occur in the texts, in either case; others: expressions that have a posting by name."""
    low = texts.select("digest", "text", F.lower("text").alias("low"))
    present = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams] + [F.when(F.col("text").rlike(x), F.lit(name)) for name, x in others.items()]
    return low.select("digest", F.explode(F.array_compact(F.array(*present))).alias("gram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(digest, kinds): the rules whose query a text's postings satisfy; rules without a query are matched themselves."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    alone = {f"rule {r.kind}": r.prefilter or r.regex for r in rules if queries[r.kind] is None}
    terms = [(kind, i, g, 1 << j, (1 << len(clause)) - 1) for kind, query in queries.items() for i, clause in enumerate(query or ()) for j, g in enumerate(sorted(clause))]
    terms += [(r.kind, 0, f"rule {r.kind}", 1, 1) for r in rules if queries[r.kind] is None]
    listed = texts.sparkSession.createDataFrame(terms, "kind string, clause int, gram string, bit long, full long")  # as long as the rules
    grams = sorted({t[2] for t in terms} - set(alone))
    met = postings(texts, grams, alone).join(F.broadcast(listed), "gram").groupBy("digest", "kind", "clause").agg(F.bit_or("bit").alias("bits"), F.max("full").alias("full"))
    return met.where("bits = full").groupBy("digest").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, order: int) -> Column:
    """array<struct(ord, kind, before, len, ok)> of the matches in text, in order."""
    hits, pieces = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0)), F.split("text", rule.regex, -1)
    judged = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)) if rule.group else hits
    counted = F.zip_with(hits, judged, lambda h, g: F.struct(F.length(h).alias("len"), (F.length(g) >= rule.at_least).alias("ok")))
    named = F.zip_with(counted, pieces, lambda m, p: F.when(m.isNotNull(), F.struct(F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), F.length(p).alias("before"), m.len.alias("len"), m.ok.alias("ok"))))
    return F.when(F.array_contains("kinds", rule.kind), F.array_compact(named)).otherwise(F.array())


def find_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, digest) by row, and (digest, ord, kind, start, end) by span of each distinct text."""
    texts = docs.select("doc_id", F.unhex(F.sha1(F.coalesce("text", F.lit("")))).alias("digest"), "text").where("text is not null")
    found = written(candidates(texts, rules), "secret-candidates")
    matched = texts.join(found, "digest").select("digest", F.flatten(F.array(*(_matches(r, i) for i, r in enumerate(rules)))).alias("m")).where("size(m) > 0")
    one = written(matched, "secret-matches").groupBy("digest").agg(F.first("m").alias("m")).select("digest", F.posexplode("m").alias("pos", "m")).select("digest", "pos", "m.*")
    w = Window.partitionBy("digest", "ord").orderBy("pos")
    end = F.sum(F.col("before") + F.col("len")).over(w)
    spans = one.withColumn("end", end).where("ok").select("digest", "ord", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    rows = docs.select("doc_id", F.unhex(F.sha1(F.coalesce("text", F.lit("")))).alias("digest"))
    return rows, spans


def scan_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per document row: doc_id, n_<kind> of the base rules, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    rows, spans = find_spans(docs, base + more)
    n = len(base)
    listed = spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "kind", "end"))).alias("all"))
    say = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("all", lambda x: x.ord == k)).cast("long").alias(f"n_{base[k].kind}")

    listed = listed.select("digest", *map(count, range(n)), F.sha2(say(F.filter("all", lambda x: x.ord < n)), 256).alias("base_sha256"), say("all").alias("spans"))
    out = rows.join(listed, "digest", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *(F.coalesce(f"n_{r.kind}", zero).alias(f"n_{r.kind}") for r in base), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def check_sql(base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> str:
    """DuckDB SQL for scan_secrets: matches and the pieces between them, added up."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules, n = base + more, len(base)
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {r.at_least} AS least, regexp_extract_all(text, {quoted(r.regex)}) AS hits, regexp_extract_all(text, {quoted(r.regex)}, {r.group}) AS judged, string_split_regex(text, {quoted(r.regex)}) AS parts FROM t WHERE regexp_matches(text, {quoted(r.prefilter or r.regex)})"
        for i, r in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(base))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({found}), x AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
y AS (SELECT doc_id, ord, kind, least, i, length(hits[i]) AS size, length(judged[i]) AS judged, length(parts[i]) AS before FROM x),
z AS (SELECT *, sum(before + size) OVER (PARTITION BY doc_id, ord ORDER BY i)::BIGINT AS stop FROM y),
s AS (SELECT doc_id, ord, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS said FROM z WHERE judged >= least),
g AS (SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY start, ord) FILTER (ord < {n}) AS base, string_agg(said, ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""


OP8_SQL = check_sql()
