"""The pipeline's stages, each on its own input, against plain Python."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from geoloom.llm import mixing, toxicity


def _write(spark, tmp_path):
    import random

    from test_cases import prose

    rng = random.Random(12)
    items = [(1, prose(rng, 30)), (2, prose(rng, 25))]
    docs, labels = [], []
    for i in range(240):
        toxic = i % 5 == 0
        text = prose(rng, 80) + (" vile scum rude" if toxic else "") + (" " + items[i % 2][1] if i % 8 == 1 else "")
        docs.append((i, text, "en", f"s{i % 3 * (i % 2)}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[2 + i][1] + " more", "en", "s0", 1) for i in range(2)] + [(400, None, None, None, None), (None, "lone row", None, "s9", 8)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, tmp_path):
    path, items = _write(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, path)
        after = out.collect()
        if k < 4:
            assert out.columns == docs.columns and set(after) <= set(before)
        gone = {r.doc_id for r in before} - {r.doc_id for r in after}
        if name == "toxicity":
            assert gone == {i for i in range(240) if i % 5 == 0}
        elif name == "near_dedup":
            parts = brute.near([(r.doc_id, r.text) for r in before if r.doc_id is not None])
            assert gone == {i for i, (_, c) in parts.items() if c != i}
        elif name == "decontamination":
            assert gone == {r.doc_id for r in before if brute.contaminated(r.text, items)[1]}
        elif name == "mixing":
            size = lambda rows: sum(len(brute.words(r.text)) for r in rows)
            assert len({r.doc_id for r in after}) == len(after)
            assert 0.9 * size(before) - 10 <= size(after) <= size(before)
        else:
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(r.doc_id for r in before if r.doc_id is not None)
            ordered = sorted(after, key=lambda r: r.start)
            assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
        if k < 4:
            docs = spark.createDataFrame(after, docs.schema)


def test_near_dedup_judges_each_text_of_an_id(spark, tmp_path):
    import random

    from test_cases import prose

    rng = random.Random(15)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(5, a), (5, b), (2, b), (9, a), (None, a)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()), key=str) == sorted([(2, b), (5, a), (None, a)], key=str)


def test_columns_with_the_stages_names(spark, tmp_path):
    """Extra columns keep their names and values, whatever the stages call theirs."""
    from test_cases import CLASHES

    path, _ = _write(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(3) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "token_ids":
            assert out.columns == docs.columns and out.select(*CLASHES).distinct().collect() == [(3,) * len(CLASHES)], name
        assert out.count() > 0


def test_run_applies_the_stages(spark, tmp_path):
    path, _ = _write(spark, tmp_path)
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert got and not got & {i for i in range(240) if i % 5 == 0}


def test_empty(spark, tmp_path):
    path, _ = _write(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0, name


def test_bounds_are_parameters():
    assert toxicity.MAX_LABELLED > 0 and mixing.MOST_BLOCKS > 0
