"""Near-duplicates against all pairs, components against a plain union-find."""

import re

import numpy as np
import pandas as pd
import pytest

from grovewright.llm import minhash, queries
from grovewright.llm.components import connected_components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", ("" if t is None or t != t else t).translate(ASCII))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


def brute(docs, k, percent=80):
    """doc_id -> (size, component) by all pairs that share a shingle."""
    sets = {int(r.doc_id): shingle_set(r.text, k) for r in docs.itertuples() if r.doc_id == r.doc_id}
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    u = Union()
    for a in sorted(sets):
        shared: dict = {}
        for x in sets[a]:
            for b in where[x]:
                if b > a:
                    shared[b] = shared.get(b, 0) + 1
        for b, n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                u.join(a, b)
    return {d: (len(s), u.top(d)) for d, s in sets.items()}


def check(rows, docs, k):
    want = brute(docs, k)
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None and r.kept


@pytest.mark.parametrize("k", [2, 5])
def test_documents(spark, documents, k):
    if k == 2:
        check(queries.op1_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect(), documents, 2)
    else:
        check(minhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect(), pd.read_parquet("/root/testdata/sf0.001/documents.parquet"), 5)


def test_odd(spark, odd, odd_docs, empty_docs):
    check(minhash.near_duplicates(odd_docs, k=2).collect(), odd, 2)
    assert minhash.near_duplicates(empty_docs).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_chains(spark, monkeypatch, block):
    """A drifting text: neighbours are alike, the ends are not; a bucket's leader is alike to few."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(120):
        words = list(words)
        words[int(rng.integers(60))] = f"x{i}"
        rows.append((i * 7 % 120, " ".join(words)))
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect(), docs, 2)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (3, 40, 400, 3000):
        for _ in range(5):
            both, a, b = (rng.integers(0, 1 << 63, m, dtype=np.uint64) for m in (n, n // 4, n // 4))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            true = n / (n + 2 * (n // 4))
            errors.append((minhash.signature(x, 200) == minhash.signature(y, 200)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = minhash.signature(np.array([5], np.uint64), 200)
    assert sorted(one >> 32) == list(range(200))


def test_dense_and_sparse_steps_agree():
    h = np.random.default_rng(2).integers(0, 1 << 63, 511, dtype=np.uint64)
    small = minhash.signature(h, 200)
    many = minhash.signature(np.concatenate([h, h[:300]]), 200)  # repeated elements change nothing
    assert (small == many).all()


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, 2001 + i) for i in range(500)] + [(7, 7)]
    u = Union()
    for a, b in links:
        if a != b:
            u.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: u.top(n) for n in list(u)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
