"""Licenses, rules, classifier, packing and sharding against brute force."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from grovewright.llm import licenses, nbsvm, packing, queries, rules, sharding

SF = "/root/testdata/sf0.01"
ASCII = str.maketrans(licenses.UPPER, licenses.LOWER)


def text_of(t):
    return "" if t is None or t != t else t


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text_of(t).translate(ASCII))
    found = [(i, label) for label, p in licenses.BASE for p in [p.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def check_license(got, docs):
    want = sorted(((r.doc_id, *brute_license(r.text)) for r in docs.itertuples()), key=str)
    have = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    clean = lambda rows: sorted(str(tuple(None if x is None or x != x else int(x) if isinstance(x, float) else x for x in r)) for r in rows)
    assert clean(have) == clean(want)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license(spark, odd, odd_docs, documents, empty_docs):
    check_license(licenses.label_documents(odd_docs).collect(), odd)
    check_license(queries.op3_license_scan(spark, SF).collect(), documents)
    assert licenses.label_documents(empty_docs).count() == 0


def test_license_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(licenses.sql()).fetchall()
    got = [tuple(r) for r in queries.op3_license_scan(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_license_near(spark):
    rows = [(1, "Redistribution, and use, in source and binary form with or without any modification are permitted"), (2, "the gnu general widget public license")]
    got = {r.doc_id: r for r in licenses.label_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "bsd" and got[1].n_base == 0 and 0.5 < got[1].score < 1
    assert got[2].labels == ""


def brute_counts(t):
    t = text_of(t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_rule_counts(spark, odd, odd_docs, documents, empty_docs):
    for df, docs in ((odd_docs, odd), (spark.read.parquet(f"{SF}/documents.parquet"), documents)):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.counts(df).collect()), key=str)
        want = sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), *brute_counts(r.text)) for r in docs.itertuples()), key=str)
        assert got == want
    assert rules.counts(empty_docs).count() == 0


def test_rules(spark, empty_docs):
    judged = queries.op6_quality_rules(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    both = judged.merge(labels, on="doc_id")
    held = both[[zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]]
    good = held[held.quality == 1]
    assert (good.kept | good.base_failed).mean() > 0.97
    assert held[held.quality == 0].kept.mean() < 0.1
    assert not (judged.kept & judged.base_failed).any()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.judge(empty_docs, none).count() == 0
    assert rules.judge(spark.createDataFrame([(1, "w " * 60), (2, None)], "doc_id long, text string"), none).count() == 2


def test_classifier(spark, odd_docs, empty_docs):
    got = queries.op2_quality_classifier(spark, SF).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    both = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)], "doc_id long, quality int")
    model = nbsvm.fit(odd_docs, labels)
    out = nbsvm.score(odd_docs, model)
    assert out.count() == 15 and out.columns.count("score") == 1
    assert nbsvm.score(empty_docs, nbsvm.fit(empty_docs, labels)).count() == 0


def check_packed(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = [text_of(x) for x in docs.text]
    want = Counter()
    tokens = 0
    for i, e in zip(docs.doc_id, t.encode_batch(texts, add_special_tokens=False)):
        ids = [*e.ids, 0]
        tokens += len(ids)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[None if i is None or i != i else int(i), k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-tokens // 2048) * 1.02 + 2


def test_packing(spark, odd, odd_docs, documents, empty_docs):
    path = packing.tokenizer_path()
    check_packed(packing.pack_digests(odd_docs, path).collect(), odd)
    check_packed(queries.op7_best_fit_packing(spark, SF).collect(), documents)
    assert packing.pack_digests(empty_docs, path).count() == 0
    full = packing.pack(odd_docs, path).collect()
    assert len(full) == packing.pack_digests(odd_docs, path).count() and all(zlib.crc32(r.ids) == r.ids_crc32 for r in full)


@pytest.mark.parametrize("lengths", [[5] * 7, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [10, 10, 10], [6, 4, 6, 4, 5, 5], list(range(1, 11)) * 13, []])
def test_best_fit(lengths):
    plan = packing.best_fit(Counter(lengths), 10)
    made = Counter()
    for one, n in plan:
        assert sum(k * v for k, v in one.items()) <= 10
        for k, v in one.items():
            made[k] += v * n
    assert made == Counter(lengths) and sum(n for _, n in plan) <= -(-sum(lengths) // 10) * 1.2 + 1


def check_shards(rows, docs, near):
    want = Counter((None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id), len(text_of(r.text).encode()) + 8, zlib.crc32(text_of(r.text).encode())) for r in docs.itertuples())
    assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    slots: dict = {}
    for r in rows:
        assert 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if near:
        load = Counter()
        for r in rows:
            load[r.shard] += r["size"]
        assert max(load.values()) / min(load.values()) < near


def test_sharding(spark, odd, odd_docs, documents, empty_docs):
    check_shards(sharding.shard_documents(odd_docs).collect(), odd, 0)
    check_shards(queries.op10_sharding(spark, SF).collect(), documents, 1.05)
    assert sharding.shard_documents(empty_docs).count() == 0
    hot = [(i, "the same text") for i in range(3000)] + [(i + 3000, f"text {i} " * (i % 9)) for i in range(3000)]
    rows = sharding.shard_documents(spark.createDataFrame(hot, "doc_id long, text string")).collect()
    check_shards(rows, pd.DataFrame(hot, columns=["doc_id", "text"]), 1.02)
    load = Counter(r.shard for r in rows)
    assert max(load.values()) < 1.5 * min(load.values())


def test_frequent_words_stay(monkeypatch):
    """Rare words push out rare words, not those that come again and again; the cache holds two generations at most."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 16)
    words, seen = packing.Words(packing.tokenizer_path()), []
    whole, merges = Tokenizer.from_file(packing.tokenizer_path()), words.merges

    class Counted:
        def tokenize(self, text):
            seen.append(text)
            return merges.tokenize(text)

    words.merges = Counted()
    for i in range(300):
        rare = "".join(chr(97 + int(d)) for d in f"{i:04d}")
        for w in ("often", "often.", f"{rare},", f"été{rare}", "Σ", "don't", "Ünd", "a<|b"):
            assert np.frombuffer(words[w.encode()], np.uint32).tolist() == whole.encode(w, add_special_tokens=False).ids
    assert seen.count("often") == 1 and len(seen) < 700
    assert len(words) <= 16 and len(words.old) <= 16
