"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns; and methods against plain Python."""

from __future__ import annotations

import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from geoloom.llm import decontaminate, gru, lm_score, mixing, near_dedup, pfor, quality, secret_scan, substring_dedup, token_files, toxicity, trigrams, warc
from geoloom.llm.common import new_path

CLASHES = ("gone", "gone_id", "gone_text", "hit_digest", "cut_doc", "cut", "_cut_doc", "_cut", "mix_block", "mix_weight", "mix_tokens", "doc", "p", "row", "original", "w_source", "start", "value")
EXTRA = "text string, doc_id long, source string, lang string, n_chars long, key string, digest string, rep long, component long, tokens long, block long, fold int, place long, label int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "re", "is"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls in any column, empty, blank and long texts, repeated rows and ids, and clashing columns."""
    rng = random.Random(5)
    a, b = prose(rng, 120), prose(rng, 90)
    texts = [(1, a), (1, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (None, b), (None, None), (6, b), (7, "one"), (8, "one"), (9, prose(rng, 60_000)), (1, b), (10, "é" * 5000), (11, "x\x01y <|endoftext|> <|ENDOFTEXT|> Ünï"), (12, "password = abcdefgh12 AKIA1234567890ABCD " + "0a" * 20)]
    rows = [(t, k, None if i % 3 else "s", None, None, "k", None, 7, None, 1, None, 0, None, 1) for i, (k, t) in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA).repartition(3).withColumns({c: F.lit(3) for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA).withColumns({c: F.lit(3) for c in CLASHES})


def by(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_quality(odd, none):
    got, want = by(quality.quality(odd).collect(), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), by([{"doc_id": r.doc_id, "q": brute.quality(r.text)} for r in odd.collect()], "doc_id", "q")
    assert got == sorted(((k, *q) for k, q in want), key=str)
    assert quality.quality(none).count() == 0
    assert set(odd.columns) < set(quality.clean_lines(odd).columns)


def test_quality_lines(spark):
    text = "\n".join(["A whole sentence of prose that ends well.", "Home | About | Contact | More.", "All rights reserved 2020.", "no end here", "### *** $$$ %%%."])
    assert quality.clean_lines(spark.createDataFrame([(text,)], "text string")).first().clean_text == "A whole sentence of prose that ends well."


def test_near(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.n_shingles == 0:
            assert r.component_id == r.doc_id and r.kept
    ones = [r for r in got if r.doc_id in (7, 8)]
    assert {r.component_id for r in ones} == {7} and [r.kept for r in sorted(ones)] == [True, False]
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_joined_documents(spark, monkeypatch):
    """Near copies with links of all strengths, against all pairs; with and without the bitmap, and with tiny blocks."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = prose(rng, 60 + 20 * g).split()
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(["alpha", "beta", "gamma"])
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: c for k, (_, c) in brute.near(rows).items()}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == want
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(near_dedup, "BITMAP_CLASSES", 0)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == want


def test_decontaminate(spark, odd, none):
    rng = random.Random(3)
    items = [(1, prose(rng, 30)), (2, prose(rng, 12)), (3, "one"), (4, None), (5, ""), (None, "one"), (6, "four short words here"), (3, "two words")]
    docs = [(i, prose(rng, 20) + " " + (items[i % 2][1] if i % 3 else "") + " Four SHORT words, here " * (i % 4 == 1)) for i in range(20)] + [(20, None), (21, "ONE"), (None, "one")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = sorted(((k, *brute.contaminated(t, [x for x in items if x[0] is not None])) for k, t in docs), key=str)
    for limit in (1 << 20, 0):
        got = decontaminate.decontaminate(df, bench, limit)
        assert by(got.collect(), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want
        assert sorted(decontaminate.drop_contaminated(df, bench, limit).select("doc_id").collect(), key=str) == sorted(got.where("not contaminated").select("doc_id").collect(), key=str)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, empty).where("contaminated").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    for limit in (1 << 20, 0):
        assert decontaminate.drop_contaminated(odd, bench, limit).columns == odd.columns


def test_decontaminate_repeated_words(spark):
    """Long runs of one word, and one passage in 1,000 items, cost no more than other texts; both ways agree."""
    import time

    rng = random.Random(31)
    shared = prose(rng, 14)
    items = [(i, f"{prose(rng, 6)} {shared}") for i in range(1000)] + [(2000, "no " * 4000), (2001, "no " * 9)]
    benchmark = decontaminate.Benchmark([(k, t.encode()) for k, t in items])
    began = time.time()
    hit, found = benchmark.hits([b"no"] * 60_000)
    assert hit.all() and found == {2000, 2001} and time.time() - began < 1
    docs = [(0, "no " * 300), (1, f"{prose(rng, 30)} {shared} {shared}"), (2, prose(rng, 50)), (1, None), (3, "no " * 9), (3, "no " * 8)]
    want = sorted(((k, *brute.contaminated(t, items)) for k, t in docs), key=str)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 24, 0):
        assert by(decontaminate.decontaminate(df, bench, limit).collect(), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want


def test_winnow_keeps_a_hash_of_each_window():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 50, 300).astype(np.uint64)
    kept = set(decontaminate.winnow(grams).tolist())
    assert all(kept & set(range(i, i + decontaminate.WINNOW)) for i in range(len(grams) - decontaminate.WINNOW + 1))


def took(df):
    import time

    began = time.time()
    rows = df.collect()
    return time.time() - began, rows


HOSTILE = {
    "separators": "words | " * 1_000_000,
    "stops": "." * 1_000_000 + ")" * 1_000_000 + "x",
    "spaces": "home" + " " * 1_000_000 + "x",
    "letters": "http://x " + "://" + "a" * 1_000_000,
    "scheme": "a" * 1_000_000 + "://b:c d",
    "digits": "1:AA " + "9" * 1_000_000 + ":AA" + "z" * 10,
    "headers": "eyJ" * 100_000 + "." + "a" * 100_000,
    "assignments": "token" * 200_000 + " " * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_time_in_proportion(spark, name):
    """A line of a million separators, runs of a million letters or digits: no recursion, no squares."""
    text = spark.createDataFrame([(1, HOSTILE[name])], "doc_id long, text string")
    quality.quality(text.limit(0)).collect(), secret_scan.scan_secrets(text.limit(0)).collect()
    seconds, rows = took(quality.quality(text))
    assert seconds < 20 and rows[0].n_symbols == sum(HOSTILE[name].count(c) for c in "#*$%&|<>")
    seconds, rows = took(secret_scan.scan_secrets(text))
    assert seconds < 20 and rows[0].n_assign + rows[0].n_access + rows[0].n_hex == sum(brute.secrets(HOSTILE[name])[:3])


def test_wordless_texts_are_in_whole_epochs_only(spark):
    docs = spark.createDataFrame([(i, "" if i % 3 else "a b c d", "s") for i in range(90)], "doc_id long, text string, source string")
    taken = lambda share: Counter(r.mix_tokens for r in mixing.mix_sources(docs, max_repeats=4.0, budget_share=share).collect())
    assert taken(0.9)[0] == 0 and taken(0.9)[4] == 27
    assert taken(1.5)[0] == 60 and taken(1.5)[4] == 45


def test_secrets(odd, none):
    got = by(secret_scan.scan_secrets(odd).collect(), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == sorted(((r.doc_id, *brute.secrets(r.text)[:4]) for r in odd.collect()), key=str)
    assert secret_scan.scan_secrets(none).count() == 0


def test_secrets_overlap(spark):
    texts = ["secret: token: abcdefgh1", "api_key=12345678 apikey = 'short' API_KEY:\"longer_value\"", "AKIA" * 5, "PASSWORD=password=12345678", "tokens = ghp_" + "a1" * 20, "f" * 31 + "g" + "0" * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan_secrets(df).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(texts[r.doc_id])[:4]


def test_more_rules_through_the_index(spark):
    """A text for each rule is found through its trigrams, as by matching every rule against every text."""
    import re

    made = {"forge": "ghp_" + "a1" * 20, "forge_fine": "github_pat_" + "a1" * 30, "forge_lab": "glpat-" + "a1" * 10, "chat": "xoxb-" + "1a" * 10, "chat_hook": "https://hooks.slack.com/services/" + "T0/" * 12, "chat_bot": "123456789:AA" + "b2" * 20, "jwt": "eyJ" + "a1" * 10 + "." + "b2" * 10 + "." + "c3" * 10, "private_key": "-----BEGIN RSA PRIVATE KEY-----", "age_key": "AGE-SECRET-KEY-1" + "Q2" * 29, "cloud_api": "AIza" + "b1" * 18, "cloud_oauth": "ya29." + "b1" * 15, "cloud_session": "ASIA" + "B1" * 8, "cloud_account": "AccountKey=" + "b1" * 30, "cloud_droplet": "dop_v1_" + "b1" * 32, "pay": "sk_live_" + "b1" * 12, "shop": "shpat_" + "b1" * 16, "square": "sq0atp-" + "b1" * 11, "mail": "SG." + "b1" * 15 + "." + "c1" * 15, "mail_gun": "key-" + "b1" * 16, "package": "npm_" + "b1" * 18, "package_index": "pypi-AgE" + "b1" * 30, "model_hub": "hf_" + "bC" * 18, "vault": "hvs." + "b1" * 12, "url_login": "ftp://me:pass1@host.org"}
    assert set(made) == {r.kind for r in secret_scan.MORE} and len(secret_scan.BASE + secret_scan.MORE) > 20
    texts = [f"x {t} y" for t in made.values()] + [t[:9] for t in made.values()]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    rules = secret_scan.BASE + secret_scan.MORE
    for i, t in enumerate(texts):
        found = [(m.start(), k, f"{r.kind}:{m.start()}:{m.end()}") for k, r in enumerate(rules) for m in re.finditer(r.regex, t) if len(m[r.group]) >= r.at_least]
        assert got[i] == ",".join(x for _, _, x in sorted(found))
        assert i >= len(made) or f"{list(made)[i]}:" in got[i]


def test_trigram_queries():
    assert trigrams.trigram_query("[0-9a-f]+") is None
    assert trigrams.trigram_query("abc") == [frozenset({"abc"})]
    got = trigrams.trigram_query(secret_scan.ASSIGN)
    assert frozenset({"api", "pik", "ike", "key"}) in got and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in got and len(got) == 6
    assert trigrams.trigram_query("ab(c|d)?ef") == sorted([frozenset({"abe", "bef"}), frozenset({"abc", "bce", "cef"}), frozenset({"abd", "bde", "def"})], key=sorted)


def test_pfor_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), np.full(600, 49407, np.uint32), rng.integers(0, 2**32, 1000, dtype=np.uint32), np.where(rng.random(5000) < 0.05, 2**32 - 1, rng.integers(0, 300, 5000)).astype(np.uint32)):
        assert (pfor.decode_ids(*pfor.encode_ids(ids), len(ids)) == ids).all()
    shard = pfor.encode_shard([3, None], [2, 1], np.array([1, 2, 3], np.uint32))
    keys, lengths, ids = pfor.decode_shard(shard)
    assert keys == [3, None] and lengths.tolist() == [2, 1] and ids.tolist() == [1, 2, 3]


def test_encoder_on_random_texts(monkeypatch):
    """10,000 texts of marks behind capitals, special tokens, control characters and any other code points."""
    rng, bound = random.Random(21), 300
    monkeypatch.setattr(token_files, "PIECES", bound)
    odd = [*"abcXYZTHWJ .,'’\n\t\x01\x85 <|>-0129ßÄéΣσςKΩﬁİı가中", *map(chr, (0x300, 0x308, 0x331, 0x30A, 0x30C, 0x323, 0x345, 0x1100, 0x1161, 0x11A8, 0x200D, 0x2028, 0x1F600)), "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "Don't", "T\u0308", "H\u0331", "W\u030a"]
    ranges = ((1, 0x7F), (0x80, 0x24F), (0x300, 0x36F), (0x370, 0xD7FF), (0xE000, 0x1FFFF))
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) if i % 2 else "".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 25))) for i in range(10_000)]
    encoder = token_files.Encoder(token_files.tokenizer_path())
    assert encoder.by_pieces
    for i in range(0, len(texts), 100):
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts[i : i + 100], add_special_tokens=False)]
        assert encoder.encode([t.encode() for t in texts[i : i + 100]]) == want


def test_encoder_of_another_form():
    """A tokenizer that keeps white space encodes whole texts."""
    encoder = token_files.Encoder(token_files.tokenizer_path("byte_bpe_50k.json"))
    assert not encoder.by_pieces
    texts = ["Two  words\n", "", "T\u0308 <|endoftext|> x"]
    assert encoder.encode([t.encode() for t in texts]) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    want = Counter((r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in odd.collect())
    out = new_path(spark, "tokens")
    got = token_files.read_token_files(spark, out, token_files.write_token_files(odd, out, token_files.tokenizer_path(), shard_ids=100)).orderBy("start").collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got])[:-1]).tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got[:2]] == [None, None]
    assert token_files.tokenized(spark, none).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é" * 3000, "<p>a</p>"]
    rows = [(i, None if i == 1 else f"http://h/{i}", h, "zz") for i, h in enumerate(html)] + [(None, "u", "h", "zz"), (None, "u", "<p>a</p>", "zz"), (6, "http://h/6", "<p>a</p>", "yy"), (6, "http://h/6", "<p>a</p>", "yy")]
    pages, path = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumns({c: F.lit(3) for c in CLASHES}), new_path(spark, "warc")
    warc.write_archives(pages, path, captures=2)
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got}) and all(r.request is not None and r.metadata is not None for r in got)
    key = lambda r: bytes(r.metadata.payload).decode().removeprefix("capture-key: ").strip()
    assert Counter(map(key, got)) == Counter("" if k is None else str(k) for k, *_ in rows)
    revisits = [r for r in got if r.capture.record_type == "revisit"]
    responses = {r.record_id: r for r in got if r.capture.record_type == "response"}
    assert len(revisits) == 6 and {key(responses[r.capture.refers_to]) for r in revisits} == {"3", "6"}
    assert sorted(bytes(r.capture.payload).decode() for r in responses.values()) == sorted({h or "" for h in html} | {"h"})
    assert {r.request.http_head for r in got} == {f"GET {u or ''} HTTP/1.1" for _, u, *_ in rows}
    empty = new_path(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(9)
    a, b = prose(rng, 400).encode(), prose(rng, 80).encode()
    whole, moved = substring_dedup.cuts(a), substring_dedup.cuts(b + a)
    assert whole[-1] == len(a) and (np.diff(whole, prepend=0) > 0).all()
    shared = {int(x) + len(b) for x in whole if x > 60} & set(moved.tolist())
    assert len(shared) >= len([x for x in whole if x > 60]) - 1
    assert len(substring_dedup.cuts(b"")) == 0 and substring_dedup.cuts(b"a" * 5000)[-1] == 5000
    h, data = substring_dedup.gear_hashes(np.frombuffer(a, np.uint8)), list(a)
    for i in (0, 3, 20, 500):
        assert int(h[i]) == sum(int(substring_dedup.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**16


def test_spans_chunk_by_chunk(spark):
    rng = random.Random(19)
    shared = [prose(rng, n) for n in (20, 40, 60)]
    rows = [(i, f"{prose(rng, rng.randint(5, 60))} {shared[i % 3] if i % 4 else ''} é {prose(rng, 10)} {shared[i % 2] if i % 5 == 0 else ''}") for i in range(40)] + [(90, None), (91, ""), (92, "a" * 3000), (93, "a" * 3000)]
    for least in (1, substring_dedup.MIN_CHARS):
        got = {(r.doc_id, r.start, r.stop, r.n_chunks, r.first_doc) for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
        assert got == brute.spans(rows, substring_dedup.GEAR, substring_dedup.REACH, substring_dedup.MOST, least)


def test_repeated_passages(spark, odd, none):
    rng = random.Random(4)
    passage = prose(rng, 55)
    rows = [(i, f"{prose(rng, 100 + i)} {passage if i < 3 else ''} {prose(rng, 50)}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(df).collect()}
    assert set(got) == {0, 1, 2} and {r.first_doc for r in got.values()} == {0}
    for k, r in got.items():
        assert rows[k][1][r.start : r.stop] in passage + " " + rows[k][1] and r.stop - r.start > len(passage) / 3
    clean = {r.doc_id: r.text for r in substring_dedup.deduplicated(df).collect()}
    assert len(clean) == 10 and clean[0] == rows[0][1] and len(clean[1]) < len(rows[1][1]) and clean[5] == rows[5][1]
    assert substring_dedup.deduplicated(odd).columns == odd.columns and substring_dedup.deduplicated(odd).count() == odd.count()
    assert substring_dedup.repeated_spans(none).count() == 0


def test_repeated_rows_have_the_spans_of_one(spark):
    """Rows that occur two and three times, and a second text of a doc_id, don't break or mix spans."""
    rng = random.Random(14)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 40 + i)} {passage} {prose(rng, 30)}") for i in range(4)]
    other = (2, prose(rng, 70))
    spans = lambda x: sorted((r.doc_id, r.start, r.stop, r.n_chunks, r.first_doc) for r in substring_dedup.repeated_spans(spark.createDataFrame(x, "doc_id long, text string")).collect())
    want = spans(rows)
    assert {k for k, *_ in want} == {0, 1, 2, 3}
    many = [*rows, rows[1], rows[2], rows[2], other]
    assert spans(many) == want
    clean = Counter(tuple(r) for r in substring_dedup.deduplicated(spark.createDataFrame(many, "doc_id long, text string")).collect())
    once = {r.doc_id: r.text for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean == Counter([*once.items(), (1, once[1]), (2, once[2]), (2, once[2]), other])


def test_toxicity(spark, odd, none):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic, low = i % 4 == 0, i % 7 == 0
        text = prose(rng, 60) + (" vile scum rude" if toxic else "") + (" ### ###" if low else "") + (" spam spam" if low else "")
        rows.append((i, text))
        if i < 300:
            labels.append((i, int(not low), int(toxic)))
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, y)
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    held = [i for i in range(300, 400)]
    assert sum((got[i].p_toxic >= 0.5) == (i % 4 == 0) for i in held) >= 97
    kept = {r.doc_id for r in toxicity.keep_clean(df, chain).collect()}
    assert kept == {i for i, r in got.items() if r.p_toxic < toxicity.THRESHOLD}
    assert toxicity.score(odd, chain).count() == odd.count() and toxicity.score(none, chain).count() == 0
    blank = toxicity.train(odd, y.limit(0))
    assert toxicity.keep_clean(odd, blank).count() == odd.count()


def test_toxicity_chain_step_by_step(spark):
    """200 documents: the chain's weights and probabilities against plain gradient steps over the same words and folds."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(200):
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        rows.append((i, prose(rng, 20) + " vile" * (toxic and rng.random() < 0.9) + " rude" * (rng.random() < (0.6 if toxic else 0.1)) + " junk" * (low and rng.random() < 0.9)))
        labels.append((i, int(not low), int(toxic)))
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, y)
    vocabulary = list(chain.index)
    assert {b"vile", b"rude", b"junk"} <= set(vocabulary)
    sample = toxicity.labelled(df, y).collect()
    assert len(sample) == 200 and {r.fold for r in sample} == {0, 1, 2}
    plain = [(r.text.lower().replace(".", " ").split(), r.fold, {c: int(r[f"y_{c}"]) for c in toxicity.CATEGORIES}) for r in sample]
    want = brute.chain(plain, [w.decode() for w in vocabulary], list(toxicity.CATEGORIES), toxicity.RIDGE, toxicity.ITERATIONS)
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    for (w, _, _), r in zip(plain, sample, strict=True):
        x, p = [math.log1p(w.count(v.decode())) for v in vocabulary], []
        for c in toxicity.CATEGORIES:
            p.append(1 / (1 + math.exp(-(np.dot(want[c][:-1], x + p) + want[c][-1]))))
        assert [got[r.doc_id].p_low_quality, got[r.doc_id].p_toxic] == pytest.approx(p, abs=0.01)


def test_logistic_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = (x @ [2, -1, 0] + 0.5 + rng.logistic(size=2000) > 0).astype(float)
    w = toxicity.fit(np.column_stack([x, np.ones(len(x))]), y, iterations=300, ridge=0.0)
    assert w == pytest.approx([2, -1, 0, 0.5], abs=0.25)


@pytest.mark.parametrize("target", [{"target_entropy": 0.9, "max_repeats": 4.0}, {"max_repeats": 2.0}, {"max_repeats": 1.0, "budget_share": 0.9}, {}])
def test_mixing_row_by_row(spark, target):
    rng = random.Random(23)
    rows = [(i, prose(rng, rng.randint(1, 60)) if i % 17 else None, f"s{min(int(rng.expovariate(0.9)), 4)}" if i % 31 else None) for i in range(500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=250, **target)
    assert Counter((r.doc_id, r.mix_epoch) for r in got.collect()) == brute.mixture(rows, 250, mixing.MOST_BLOCKS, mixing.SEED, **target)


def test_mixing(spark, odd, none):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 80)), f"s{min(int(rng.expovariate(1)), 5)}", "x", 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_block string, n_tokens long")
    size = {i: len(t.split()) for i, t, *_ in rows}
    of = Counter()
    for i, _, s, *_ in rows:
        of[s] += size[i]
    total = sum(of.values())
    for target in ({"target_entropy": 0.9}, {"max_repeats": 2.0}, {"max_repeats": 1.0, "budget_share": 0.8}, {}):
        got = mixing.mix_sources(df, block_tokens=300, **target).collect()
        share, budget = target.get("budget_share", 1.0), Counter()
        weights = {r.source: r.mix_weight for r in got}
        a = [math.log(weights[s] / weights["s0"]) / math.log(of[s] / of["s0"]) for s in of if of[s] != of["s0"]]
        assert max(a) - min(a) < 1e-9 and sum(weights.values()) == pytest.approx(1)
        if "target_entropy" in target:
            assert -sum(w * math.log(w) for w in weights.values()) / math.log(len(of)) == pytest.approx(0.9, abs=1e-6)
        taken = Counter((r.doc_id, r.mix_epoch) for r in got)
        assert set(taken.values()) == {1}
        for r in got:
            budget[r.source] += size[r.doc_id]
        for s, n in of.items():
            want = round(weights[s] * total * share)
            assert want <= budget[s] < want + 80  # the last document may go over
            epochs = Counter(r.doc_id for r in got if r.source == s)
            assert max(epochs.values()) - min([*epochs.values(), want // n]) <= 1
            if "max_repeats" in target:
                assert want / n <= target["max_repeats"] + 0.01
    with pytest.raises(ValueError):
        mixing.mix_sources(df, max_repeats=0.5)
    kept = mixing.mixture(odd, target_entropy=0.99)
    assert kept.columns[0] == "doc" and kept.select("doc.*").columns == odd.columns
    again = mixing.mix_sources(df.repartition(7), block_tokens=300)
    assert again.count() == mixing.mix_sources(df, block_tokens=300).count()
    assert mixing.mix_sources(none, target_entropy=0.9).count() == 0
    assert set(mixing.mix_sources(odd, target_entropy=0.99).columns) == {*odd.columns, "mix_tokens", "mix_epoch", "mix_block", "mix_weight"}


def test_gru_gradients():
    """Training steps follow the slope of the likelihood: a small step along one weight's gradient changes it as expected."""
    rng = np.random.default_rng(0)
    model = gru.Gru(np.array([9.0, 7, 5, 3, 2, 1]), 2.0, hidden=4, per_class=2)
    for name, x in model.p.items():
        model.p[name] = (x + rng.normal(0, 0.3, x.shape)).astype(np.float64)
    ids = rng.integers(0, 7, 40)
    docs = [ids]

    def loss(m):
        return -float(m.score(docs)[0]) * math.log(10)

    seen = {}
    x, y = np.append(7, ids[:-1])[:, None], ids[:, None]
    keep, live = np.ones((40, 1)), np.ones((40, 1))
    keep[0] = 0
    before = {k: v.copy() for k, v in model.p.items()}
    model.squares = {k: np.full_like(v, 1e12) for k, v in model.p.items()}
    model._window(np.zeros((4, 1)), x, y, keep, live)
    for name, w in model.p.items():
        seen[name] = (before[name] - w) / gru.RATE * 1e6  # the step was RATE * g / 1e6
    model.p = {k: v.copy() for k, v in before.items()}
    for name in ("E", "U", "C", "c", "W", "w"):
        at = np.unravel_index(np.argmax(np.abs(seen[name])), seen[name].shape)
        for sign in (1, -1):
            model.p[name][at] = before[name][at] + sign * 1e-3
            seen[name, sign] = loss(model)
        model.p[name][at] = before[name][at]
        assert (seen[name, 1] - seen[name, -1]) / 2e-3 == pytest.approx(seen[name][at], rel=0.05, abs=4e-3), name


def test_gru_scores_do_not_depend_on_lanes():
    rng = np.random.default_rng(5)
    model = gru.Gru(np.array([9.0, 7, 5, 3, 2, 1]), 2.0, hidden=4, per_class=2)
    model.p["C"] += rng.normal(0, 0.5, model.p["C"].shape).astype(np.float32)
    docs = [rng.integers(0, 7, n) for n in (1, 200, 3, 64, 65, 129, 2, 1)]
    one = [model.score([d])[0] for d in docs]
    assert model.score(docs, lanes=3) == pytest.approx(one, rel=1e-4) and model.score(docs) == pytest.approx(one, rel=1e-4)


def test_gru_scores_word_by_word():
    """Scores against plain loops over the recurrence, in Python floats."""
    rng = np.random.default_rng(8)
    model = gru.Gru(np.array([9.0, 7, 5, 3, 2, 1, 1]), 2.0, hidden=3, per_class=3)
    for name, x in model.p.items():
        model.p[name] = (x + rng.normal(0, 0.4, x.shape)).astype(np.float32)
    docs = [rng.integers(0, 8, n) for n in (1, 5, 90)]
    assert model.score(docs) == pytest.approx([brute.gru_score(model, d.tolist()) for d in docs], rel=1e-5)


def test_gru_vector_round_trip():
    a, b = (gru.Gru(np.array([3.0, 2, 1]), 1.0, hidden=2, seed=s) for s in (1, 2))
    a.train(np.array([0, 1, 2, 3, 0]), np.array([True, False, False, True, False]))
    b.load(a.vector())
    assert (a.vector() == b.vector()).all()


def test_lm_model_does_not_depend_on_partitions(spark, monkeypatch):
    """Several shards and rounds; texts with a pattern that a unigram model can't see; any number of tasks."""
    rng = random.Random(16)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 3000)
    nouns = ["an", "er", "th", "on"]
    rows = [(i, " ".join(f"{w} {w}s" for w in (rng.choice(nouns) for _ in range(rng.randint(20, 60))))) for i in range(240)] + [(1000, None), (None, "an ans")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: r for r in lm_score.lm_scores(df.repartition(n)).collect()} for n in (2, 7))
    for k, r in one.items():
        assert two[k].score == pytest.approx(r.score, rel=1e-6)
    held = [r for r in one.values() if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores(spark, odd, none, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(5, 120))) for i in range(120)] + [(None, "er th"), (200, None), (201, None), (7, "an an unknownword")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k"))
    count, held = Counter(), {}
    for k, t in rows:
        held[k] = zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
        if not held[k]:
            count.update([*brute.words(brute.lower(t)), ""])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for k, t in rows:
        w = [*brute.words(brute.lower(t)), ""]
        want[k, held[k], len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    for bound in (lm_score.DICTIONARY, 20):
        monkeypatch.setattr(lm_score, "DICTIONARY", bound)
        got = lm_score.lm_scores(df).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm_score.lm_scores(odd).count() == odd.count()
    assert lm_score.lm_scores(none).count() == 0


def test_lm_model_words_follow_the_coverage():
    """Flat counts, where a fixed number of words would leave most tokens to the tail."""
    for n in (1500, 3000, 9000):
        ranked = [(b"w%d" % i, 9 + (i < 50)) for i in range(n)]
        total = sum(c for _, c in ranked) + 500  # and words beyond the dictionary
        words = lm_score.Words(ranked, total)
        assert words.k >= min(n, 2048) and sum(c for _, c in ranked[: words.k]) >= lm_score.COVERAGE * total
        assert words.tail == total - sum(c for _, c in ranked[: words.k])
        k, _, m = words.model().p["W"].shape
        assert k * m >= words.k and abs(k - m) <= 1


def test_substring_recall_by_length():
    """Which shared passages hold 80 characters of whole chunks, by length in bytes; printed with -s."""

    def text(rng, n):
        return " ".join("".join(rng.choice("etaoinshrdlucmfwypvbg") for _ in range(rng.randint(2, 9))) for _ in range(n))[:n]

    def chunks(x):
        ends = substring_dedup.cuts(x.encode()).tolist()
        return [(b - a, x[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def found(rng, n):
        passage = text(rng, n)
        one, other = (chunks(f"{text(rng, rng.randint(100, 400))} {passage} {text(rng, rng.randint(100, 400))}") for _ in range(2))
        held, run, best = {x for _, x in other}, 0, 0
        for size, x in one:
            run = run + size if x in held else 0
            best = max(best, run)
        return best >= substring_dedup.MIN_CHARS

    share = {}
    for n in (100, 150, 180, 200, 220, 250, 300):
        rng = random.Random(n)
        share[n] = sum(found(rng, n) for _ in range(500)) / 500
    print(share)
    assert share[250] >= 0.99 and share[300] >= 0.99 and share[200] >= 0.9
