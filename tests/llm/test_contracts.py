"""The numbered queries against plain Python on a whole small table."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from geoloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()


def test_op1_base(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(d.text)
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted([tuple(r) for r in cur.fetchall()], key=str)
    got = sorted([tuple(r) for r in QUERIES[name](spark, sf).select(*names).collect()], key=str)
    assert got == want


def test_op3(spark, sf, docs):
    want = brute.near([(d.doc_id, d.text) for d in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_near_dedup"](spark, sf).collect()}
    assert got == want


def test_op7(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op7_decontaminate"](spark, sf).collect()}
    assert any(r.contaminated for r in got.values())
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute.contaminated(d.text, items)
        assert r.contaminated == (r.n_hit > 0)


def test_op8(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op8_secret_scan"](spark, sf).collect()}
    for d in docs:
        r = got[d.doc_id]
        *want, said = brute.secrets(d.text)
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_op10(spark, sf, docs):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from geoloom.llm.token_files import tokenizer_path

    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_files"](spark, sf).collect()}
    for d in docs:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert got[d.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
