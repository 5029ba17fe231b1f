"""The pipeline stage by stage against brute force, on documents with planted cases."""

import random

import pandas as pd
import pytest

import corpus_pipeline as cp
from test_dedup import brute as brute_components
from test_substrings import brute as brute_spans
from test_substrings import words_of


def planted(tmp_path):
    """40 clean documents with copies, near copies, a shared passage, benchmark passages, junk."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(30) for _ in range(5)]
    passage = text(60)
    docs: list[list[str]] = [text(rng.randint(80, 250)) for _ in range(40)]
    docs.append(list(docs[0]))  # 40: a copy
    docs.append([*docs[1], "more"])  # 41: a near copy
    docs += [[*text(40), *passage, *text(40)] for _ in range(3)]  # 42-44: share a passage
    docs += [[*text(50), *items[k], *text(50)] for k in range(2)]  # 45, 46: contaminated
    junk = [[w.upper() + "###" for w in text(100)] for _ in range(40)]  # 47-86
    texts = [" ".join(d) for d in [*docs, *junk]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    pd.DataFrame(rows, columns=cp.COLUMNS).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(i, int(i < 47), 0) for i in range(0, 87, 1)], columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame([(k, " ".join(w)) for k, w in enumerate(items)], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf = planted(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        after[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == cp.COLUMNS
    assert set(after["quality"].doc_id) == set(range(47))
    assert set(after["near_dedup"].doc_id) == set(range(47)) - {40, 41}
    cut = after["substring_dedup"].set_index("doc_id")
    assert len(cut) == 45 and len(words_of(cut.text[42])) == 140 and all(len(words_of(cut.text[i])) == 80 for i in (43, 44))
    assert (cut.text.str.len() == cut.n_chars).all()
    assert set(after["decontamination"].doc_id) == set(range(45)) - {40, 41}
    packed = after["packing"]
    assert set(packed.doc_id) == set(after["decontamination"].doc_id)
    assert len(cp.run(spark, sf).toPandas()) == len(packed)


@pytest.mark.parametrize("size", ["sf0.001"])
def test_on_documents(spark, size):
    sf = f"/root/testdata/{size}"
    docs = cp.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).toPandas()
    left = cp.near_dedup(spark, spark.createDataFrame(docs), sf).toPandas()
    component = brute_components(docs, 5)
    assert sorted(left.doc_id) == sorted(d for d, (_, c) in component.items() if d == c)
    cut = cp.substring_dedup(spark, spark.createDataFrame(left), sf).toPandas()
    spans = brute_spans(left, cp.MIN_WORDS)
    assert {d: len(words_of(t)) for d, t in zip(cut.doc_id, cut.text)} == {d: n - gone for (d, _), (n, gone, _) in spans.items()}


def test_empty_and_null(spark, tmp_path):
    sf = planted(tmp_path)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, 3), (2, "", "en", None, 0), (None, "some words", None, None, 10), (3, "x " * 5000, None, "s", 10000), (3, "x " * 5000, None, "s", 10000)]):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
            docs.count()


@pytest.mark.parametrize("stage", ["quality", "packing"])
def test_heaps_shrink(spark, tmp_path, stage):
    """A stage first has the executors' garbage collected, so that what earlier stages filled isn't held beside its Python workers."""
    sf = planted(tmp_path)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: {b.getName(): b.getCollectionCount() for b in beans()}["G1 Old Generation"]
    before = full()
    dict(cp.STAGES)[stage](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert full() > before
