"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions.

A text's set is its distinct shingles of WIDTH words (runs other than 0x20 and 0x09-0x0D, only A-Z lowered); with fewer words
the whole sequence is one shingle. A shingle's hash is the first 16 hex digits of its MD5; the K least hashes in order, put
together, are the fingerprint, which is the whole set where it has fewer. So the fingerprint of a union is the K least of both
fingerprints (merged: parts of a document, or documents of a source), and two fingerprints tell the resemblance and the
containment of their sets and the number of their shingles.

Of a long text only hashes below a bound that leaves about 2 K of them are sorted; where repeated shingles leave fewer than K,
all are, so the result is exact always.

The query needs the document behind each one in descending doc_id. Documents are dealt into ranges of doc_id, cut at approximate
quantiles; a range's rows meet their neighbours in one window, and the first row of the next range comes along as a guest. So
texts are shuffled once, with the fingerprints that were made before.

Defined cases: null text counts as empty, of which n_chars is 0 and the fingerprint empty; two empty sets are alike to 1, an
empty one and another to 0; null doc_ids come last, rows of one doc_id in the order of their texts' hashes (in one range: doc_ids
are taken to be nearly unique); the only document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import SPACES, table

K = 64
WIDTH = 5
DIGITS = 16
RANGE_ROWS = 2048
MOST_RANGES = 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_sketch(df: DataFrame, text: str, into: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """df with the k least shingle hashes of a text, ascending, as an array; other columns stay."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + SPACES[1:], LOWER + " " * (len(SPACES) - 1))
    hashed = df.withColumn(into, F.array_remove(F.split(spaced, " "), ""))
    n = F.greatest(F.size(into) - (width - 1), F.lit(1))
    shingle = lambda w, i: F.concat_ws(" ", w, *(F.get(into, i + j) for j in range(1, width)))
    hashed = hashed.withColumn(into, F.transform(F.slice(into, 1, n), lambda w, i: F.substring(F.md5(shingle(w, i)), 1, DIGITS)))
    share = F.lit(2.0 * k) / F.greatest(F.size(into), F.lit(4 * k))
    bound = F.lpad(F.lower(F.hex((share * F.lit(2.0**60)).cast("long"))), 15, "0")
    hashed = hashed.withColumn(into, F.struct(F.col(into).alias("every"), bound.alias("bound")))
    few = F.array_distinct(F.when(F.size(f"{into}.every") > 4 * k, F.filter(f"{into}.every", lambda h: h < F.col(f"{into}.bound"))))
    hashed = hashed.withColumn(into, F.struct(f"{into}.every", few.alias("few")))
    chosen = F.when(F.size(f"{into}.few") >= k, F.col(f"{into}.few")).otherwise(F.array_distinct(f"{into}.every"))
    return hashed.withColumn(into, F.slice(F.sort_array(chosen), 1, k))


def packed(hashes: Column | str) -> Column:
    """Hashes as bytes, half as long as their digits."""
    return F.unhex(F.array_join(hashes, ""))


def fingerprint(pack: Column | str) -> Column:
    return F.lower(F.hex(pack))


def hashes(pack: Column | str) -> Column:
    """The hashes of a packed sketch or of a fingerprint's bytes."""
    size = DIGITS // 2
    return F.when(F.length(pack) > 0, F.transform(F.sequence(F.lit(0), (F.length(pack) / F.lit(size)).cast("int") - 1), lambda i: F.substring(pack, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def resemblance(a: str, b: str, k: int = K) -> Column:
    """The share of the k least hashes of both sets that both have: an estimate of intersection over union."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) > 0, shared / F.size(both)).otherwise(F.lit(1.0))


def shingle_count(a: str, k: int = K) -> Column:
    """The number of distinct shingles of a sketch in digits: exact below k, else from the k-th least hash."""
    highest = F.conv(F.substring(F.try_element_at(a, F.lit(-1)), 1, 15), 16, 10).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**60) / F.greatest(highest, F.lit(1.0)))


def containment(a: str, b: str, k: int = K) -> Column:
    """The share of a's shingles that b has too; sketches in digits."""
    j = resemblance(a, b, k)
    common = j / (1 + j) * (shingle_count(a, k) + shingle_count(b, k))
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), common / shingle_count(a, k))).otherwise(F.lit(1.0))


def merged(sketches: DataFrame, sketch: str, *by: str, k: int = K) -> DataFrame:
    """by, and the sketch of the union of each group's sets; tasks keep k hashes of a group before the shuffle."""
    # outer, as a plain explode's filter would be pushed below the sketches and make them twice
    rows = sketches.select(*by, F.explode_outer(sketch).alias(sketch)).where(F.col(sketch).isNotNull())
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(sketch))
    least = rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place").distinct()
    return least.groupBy(*by).agg(F.sort_array(F.collect_list(sketch)).alias(sketch))  # k hashes


def _ranges(docs: DataFrame, rows: int) -> Column:
    """The number of a doc_id's range: descending ids have descending numbers, null the least. Two steps of bounds."""
    n = docs.count()
    wanted = min(MOST_RANGES, math.ceil(n / rows))
    shares = [i / wanted for i in range(1, wanted)]
    found = docs.agg(F.approx_percentile(F.col("doc_id"), shares, max(10_000, 4 * wanted))).first()[0] if shares else None
    bounds = sorted(set(found or ()))
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    coarse = below(longs([p[0] for p in parts[1:]]))
    fine = below(F.get(F.array(*map(longs, parts)), coarse))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(coarse * (step + 1) + fine)


def with_next(docs: DataFrame, prepare, columns: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """prepare(docs), which has doc_id, order and the columns, with next_<column> of the row behind each one in descending
    doc_id; the first follows the last. order: what decides between rows of one doc_id."""
    ranged = docs.withColumn("range", _ranges(docs.select("doc_id"), rows))
    first = F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), (-F.col("order").cast("decimal(20,0)")).alias("o"))).alias("first")
    starts = sorted(ranged.groupBy("range").agg(first).collect(), key=lambda r: -r.range)  # a row for each range: MOST_RANGES at most
    guests = [(r.range, int(r.first.id), int(-r.first.o), starts[i - 1].range) for i, r in enumerate(starts)]
    guests = docs.sparkSession.createDataFrame(guests, "range int, id long, o long, host int")
    guest = ranged.join(F.broadcast(guests), "range").where((F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("order") == F.col("o")))
    guest = guest.groupBy("host").agg(*(F.any_value(c).alias(c) for c in docs.columns)).withColumnRenamed("host", "range")
    both = prepare(ranged.withColumn("guest", F.lit(False)).unionByName(guest.withColumn("guest", F.lit(True))))
    w = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "order")
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("not guest").drop("guest", "range")


def fingerprints(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("order"))
    met = with_next(own, lambda df: with_sketch(df, "text", "pack").withColumn("pack", packed("pack")), ["text", "pack"], rows)
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring("next_text", F.lit(1), third))
    met = with_sketch(met.select("doc_id", n.alias("n_chars"), "pack", "next_pack", edited.alias("edited")), "edited", "edited_pack")
    met = met.select("*", packed("edited_pack").alias("edited_bytes")).withColumns({c: hashes(x) for c, x in (("a", "pack"), ("b", "edited_bytes"), ("c", "next_pack"))})
    return met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("pack").alias("fingerprint"), fingerprint("edited_bytes").alias("edited_fingerprint"), resemblance("a", "b").alias("near_edited"), resemblance("a", "c").alias("near_next"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"


def _sketch_sql(words: str) -> str:
    beside = ", ".join([words, *(f"{words}[{i}:]" for i in range(2, WIDTH + 1))])
    said = ", ".join(f"z[{i}]" for i in range(1, WIDTH + 1))
    n = f"CASE WHEN len({words}) > 0 THEN greatest(len({words}) - {WIDTH - 1}, 1) ELSE 0 END"
    return f"list_sort(list_distinct(list_transform(list_zip({beside})[1:{n}], lambda z: left(md5(concat_ws(' ', {said})), {DIGITS}))))[1:{K}]"


def _like_sql(a: str, b: str) -> str:
    both = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{K}]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect({a}, {b}), {both}))::DOUBLE / len({both}) END"


OP13_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM t WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(next, length(text) // 3) AS edited FROM n),
x AS (SELECT *, {_words_sql("text")} AS x, {_words_sql("edited")} AS y, {_words_sql("next")} AS z FROM e),
s AS (SELECT *, {_sketch_sql("x")} AS a, {_sketch_sql("y")} AS b, {_sketch_sql("z")} AS c FROM x)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  {_like_sql("a", "b")} AS near_edited, {_like_sql("a", "c")} AS near_next FROM s
"""
