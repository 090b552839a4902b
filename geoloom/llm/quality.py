"""Line-first quality rules in DataFrame functions.

Each line is judged by itself, and failing lines are removed:
- punctuation: it does not end in a full stop or the like, or over MAX_MARKS of its visible characters are ASCII marks;
- navigation: it has three or more separators (| » › > ·), or it is a menu of at most four words with a menu word;
- boilerplate: it has a phrase of BOILERPLATE (cookie notices, rights, sharing links and the like);
- shouting: over MAX_CAPITALS of its letters are capitals, in a line of 20 letters or more.
A document that loses more than MAX_LOSS of its characters in lines is rejected, as is one that fails the base rules
(fewer than MIN_WORDS words, or over MAX_REPEATS of its words in repeated three-word windows).

All of it is a projection of the row: there is no shuffle, and a text's arrays are the only state. Windows are told apart
by 64-bit hashes of their three words, within one text only.

Defined cases: null and empty texts have no words and fail; rows are judged one by one, so repeated rows, ties and null
doc_ids are kept as they are; an empty table gives no rows; other columns are ignored by the query, kept by clean_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import SPACE_CLASS, table

MIN_WORDS = 50
MAX_REPEATS = 0.5
MAX_LOSS = 0.5
MAX_MARKS = 0.12
MAX_CAPITALS = 0.6
SYMBOLS = r"[^#*$%&|<>]+"

ENDS_WELL = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
SEPARATORS = "|»›>·"
MOST_SEPARATORS = 2
MENU = r"(?i)^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){0,3}(?:home|menu|login|log in|sign in|sign up|contact|about us|search|sitemap|next|previous|read more|back to top|share|subscribe)[\x20\x09-\x0D.!:]*$"
BOILERPLATE = r"(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|use of cookies|accept cookies|enable javascript|lorem ipsum|click here|share this|powered by|subscribe to our)"


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the rules."""
    visible = F.length(F.regexp_replace(line, rf"{SPACE_CLASS}+", ""))
    marks = F.length(F.regexp_replace(line, r"[^!-/:-@\[-`{-~]+", ""))
    letters, capitals = F.length(F.regexp_replace(line, r"\P{L}+", "")), F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    return (
        ~line.rlike(ENDS_WELL)
        | (marks > visible * F.lit(MAX_MARKS))
        | (F.length(line) - F.length(F.translate(line, SEPARATORS, "")) > MOST_SEPARATORS)
        | line.rlike(MENU)
        | line.rlike(BOILERPLATE)
        | ((letters >= 20) & (capitals > letters * F.lit(MAX_CAPITALS)))
    )


def passing(lines: Column) -> Column:
    """The lines, each with a word, without those that fail a rule."""
    return F.filter(lines, lambda line: ~line_fails(line))


def clean_lines(docs: DataFrame, text: str = "text", into: str = "clean_text") -> DataFrame:
    """docs with the text of its lines that pass; lines without a word pass, null stays null."""
    word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn(into, F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line: ~word(line) | ~line_fails(line)), "\n"))


def _neighbours(column: str, step) -> Column:
    """step(a, b) for all neighbours in an array."""
    n = F.greatest(F.size(column) - 1, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, 2, n), step)


def quality(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_share."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = text.select("*", F.array_remove(F.split("text", rf"{SPACE_CLASS}+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    counted = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        F.length(F.array_join("lines", "")).alias("line_chars"),
        F.length(F.array_join(passing(F.col("lines")), "")).alias("clean_chars"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    ordered = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = counted.withColumn("ordered", ordered).drop("windows")
    twice = _neighbours("ordered", lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    starts = ordered.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(twice)))).drop("ordered")
    spread = _neighbours("starts", lambda a, b: F.least(F.lit(3), b - a))
    n_repeat = F.when(F.size("starts") > 0, F.aggregate(spread, F.lit(3).cast("long"), lambda n, x: n + x)).otherwise(F.lit(0).cast("long"))
    out = starts.withColumn("n_repeat_words", n_repeat)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(MAX_REPEATS))
    out = out.withColumn("base_failed", failed).withColumn("lost_share", F.when(F.col("line_chars") > 0, (F.col("line_chars") - F.col("clean_chars")) / F.col("line_chars")).otherwise(F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOSS)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("lost_share", 6).alias("lost_share"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
w AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM p WHERE len(words) >= 3),
v AS (SELECT doc_id, i, words[i:i+2] AS g FROM w),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM v) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM p),
f AS (SELECT doc_id, line,
  length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS visible,
  length(regexp_replace(line, '[^!-/:-@\[-`{-~]+', '', 'g')) AS marks,
  length(regexp_replace(line, '\P{L}+', '', 'g')) AS letters,
  length(regexp_replace(line, '\P{Lu}+', '', 'g')) AS capitals FROM l),
x AS (SELECT doc_id, sum(length(line)) AS line_chars, sum(CASE WHEN
    NOT regexp_matches(line, '[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}:;]["''\x{201D}\x{2019}\x{00BB})\]]*[\x20\x09-\x0D]*$')
    OR marks > visible * 0.12::DOUBLE
    OR regexp_matches(line, '(?:[|\x{00BB}\x{203A}>\x{00B7}][^|\x{00BB}\x{203A}>\x{00B7}]*){3,}')
    OR regexp_matches(line, '(?i)^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){0,3}(?:home|menu|login|log in|sign in|sign up|contact|about us|search|sitemap|next|previous|read more|back to top|share|subscribe)[\x20\x09-\x0D.!:]*$')
    OR regexp_matches(line, '(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|use of cookies|accept cookies|enable javascript|lorem ipsum|click here|share this|powered by|subscribe to our)')
    OR (letters >= 20 AND capitals > letters * 0.6::DOUBLE) THEN length(line) ELSE 0 END) AS lost_chars FROM f GROUP BY doc_id),
b AS (SELECT p.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, CASE WHEN line_chars > 0 THEN lost_chars::DOUBLE / line_chars ELSE 0.0 END AS lost
  FROM p LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 AS kept, round(lost, 6) AS lost_share FROM b
"""
