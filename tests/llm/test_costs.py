"""Work that is done once where it was done many times."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import common, gru, lm_score, token_files, warc


def test_sha1_is_taken_once_for_its_letters(spark):
    rng = random.Random(1)
    payloads = [b"", b"a", "é\x00".encode(), *(rng.randbytes(rng.randint(1, 300)) for _ in range(300))]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, p binary")
    found = df.select("i", warc.base32_sha1(F.col("p")).alias("d"))
    assert {r.i: r.d for r in found.collect()} == {i: base64.b32encode(hashlib.sha1(p).digest()).decode() for i, p in enumerate(payloads)}
    assert found._jdf.queryExecution().analyzed().toString().count("sha1(") == 1


def test_words_with_marks_behind_are_not_new_pieces():
    encoder = token_files.Encoder(token_files.tokenizer_path())
    texts = [t.encode() for t in ("thesblest*** thesblest%%% Thesblest!? thesblest", "straße, straße... STRASSE. a÷b. ÿ! Éa, éa,", "á!! a.́ á <|endoftext|>. a<|. b|>.")]
    assert encoder.encode(texts) == [x.tobytes() for x in encoder._ids(encoder.tokenizer, [t.decode() for t in texts])]
    assert {b"thesblest", b"***", b"%%%", b"!?", b"..."} <= set(encoder.young)


def test_a_word_and_its_marks_are_remembered_apart():
    encoder = token_files.Encoder(token_files.tokenizer_path())
    texts = [b"", b" \n ", "straße!, Straße. schön!, SCHÖN. été! x÷! ... ×.".encode(), b"broken\xc3! \xe9. \xc3\xa9.", b"a%%% a"]
    assert encoder.encode([]) == [] and encoder.encode([b""]) == [b""]
    assert encoder.encode(texts) == [x.tobytes() for x in encoder._ids(encoder.tokenizer, [t.decode("utf-8", "replace") for t in texts])]
    assert {"straße".encode(), "schön".encode(), b"a", b"!,", b"."} <= set(encoder.young)
    assert not {"straße!,".encode(), "schön!,".encode(), b"a%%%"} & set(encoder.young)


def test_a_round_reads_its_documents_alone(spark, monkeypatch):
    """The table of ids has a folder for each round, with ids as bytes, and few jobs find the dictionary's limit."""
    kept, jobs = {}, []

    def written(df, name, *by):
        kept[name] = out = common.written(df, name, *by)
        return out

    monkeypatch.setattr(lm_score, "written", written)
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(30))) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, None), (200, " \n"), (201, " Two words ")], "doc_id long, text string")
    assert lm_score.lm_scores(df).count() == 203
    folders = {x.split("/")[-2] for x in kept["lm-ids"].inputFiles()}
    assert folders == {f"round={i}" for i in range(-1, lm_score.ROUNDS)}
    assert dict(kept["lm-ids"].dtypes)["ids"] == "binary"
    found = {r.doc_id: (r.n_tokens, r.held_out, r.round) for r in kept["lm-ids"].collect()}
    assert found[None][0] == found[200][0] == 1 and found[201][0] == 3 and all(t == 31 for k, (t, _, _) in found.items() if k is not None and k < 200)
    assert all(out == (turn < 0) for _, out, turn in found.values())
    counts = spark.range(1, 3001).select(F.expr("cast(3000000 / id as long)").alias("n"))
    monkeypatch.setattr(type(counts), "agg", lambda self, *a, agg=type(counts).agg: jobs.append(1) or agg(self, *a))
    assert lm_score.dictionary_limit(counts, 1000) == 2997  # of 3,000,000 // 1001
    assert len(jobs) <= 5


def test_tokens_by_arrow_are_those_of_bytes():
    texts = [b"", b"  ", b"A b\x1ca", b"\tb  B\n", "É é  x".encode(), b"\xff Z"]
    different, codes, sizes = lm_score.coded_tokens(texts)
    assert [different.to_pylist()[i] for i in codes] == [w for t in texts for w in lm_score.tokens(t)] and sizes.tolist() == [len(lm_score.tokens(t)) for t in texts]
    assert [x.tolist() for x in lm_score.coded_tokens([])] == [[lm_score.END], [], []]


def test_words_are_counted_in_arrow(spark, monkeypatch):
    """No text becomes a list of words; counts that are sent on in parts add up."""

    def cut(text):
        raise AssertionError("a text was cut in Python")

    rng = random.Random(4)
    texts = [None, "", " \n\t", "A a\x0bÉ é", *(" ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randint(1, 60))) for _ in range(3000))]
    want = Counter(w for t in texts for w in lm_score.tokens((t or "").encode()))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    monkeypatch.setattr(lm_score, "tokens", cut)
    for most in (lm_score.COUNTED, 900, 1):
        monkeypatch.setattr(lm_score, "COUNTED", most)
        assert {bytes(r.word): r.n for r in lm_score.count_words(df).collect()} == want
    assert lm_score.count_words(df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [[1], [1, 1, 2], [gru.MANY - 1, gru.MANY, gru.MANY + 1], [400, 3, 1, 1, 15, 14, 2], [5000, 70]])
def test_rows_of_frequent_words_are_added_as_products(times):
    """The most frequent words come first."""
    rng = np.random.default_rng(2)
    for far in (0, 1 << 17):
        keys = rng.permutation(np.repeat(far + 3 * rng.permutation(len(times)), times))
        rows = rng.normal(size=(len(keys), 6))
        found, sums = gru._summed(keys, rows)
        assert sorted(found) == sorted(set(keys.tolist())) and [int((keys == k).sum()) for k in found] == sorted(times, reverse=True)
        assert sums == pytest.approx(np.array([rows[keys == k].sum(0) for k in found]))


def test_biases_are_weighed_by_a_feature_of_ones():
    """Softmaxes are products alone, and ids of 16 bits reach the word that opens a document."""
    model = gru.Gru(np.ones((1 << 16) - 1), 1.0, hidden=2)
    states = model._steps(np.zeros((2, 3), np.float32), np.full((4, 3), model.n + 1), np.ones((4, 3), np.float32))
    assert states.shape == (4, 3, 3) and (states[:, 2] == 1).all()
    docs = [np.array([5, (1 << 16) - 1, 7]), np.array([(1 << 16) - 1])]
    assert (model.score([d.astype("<u2") for d in docs]) == model.score(docs)).all()
