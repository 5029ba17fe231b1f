"""Operators that SQL can't express against plain versions of themselves."""

import numpy as np
import pandas as pd

from grovewright.llm import decontamination, nbsvm, queries, sharding
from grovewright.llm.decontamination import N, SHARE, SPLIT, PlainHash, align
from grovewright.llm.common import ngrams


def test_decontamination_query(spark):
    """All items with all documents, by alignment over the whole text wherever a pair has N words in a row in common."""
    sf = "/root/testdata/sf0.001"
    docs, items = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    hashed = PlainHash()
    of = lambda t: hashed.of(SPLIT.sub(b" ", ("" if t is None else t).encode()).split())
    known = [(i, w, set(ngrams(w, min(N, len(w))).tolist())) for i, w in zip(items.item_id, map(of, items.text)) if len(w)]
    got = {r.doc_id: r for r in queries.op4_benchmark_decontamination(spark, sf).collect()}
    assert len(got) == len(docs)
    found = 0
    for d, t in zip(docs.doc_id, docs.text):
        h = of(t)
        grams = {n: set(ngrams(h, n).tolist()) for n in range(1, N + 1)}
        want = {}
        for i, w, g in known:
            if g & grams[min(N, len(w))]:
                share = align(w, h)[0] / len(w)
                if share >= SHARE:
                    want[i] = share
        found += len(want)
        assert sorted(got[d].item_ids) == sorted(want) and got[d].contaminated == bool(want), d
        if want:
            assert abs(got[d].score - max(want.values())) < 1e-9
    assert found


def test_dual_coordinate_descent():
    """The objective reached against many steps of plain projected gradient on the dual."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        n, m = 40, 12
        rows = [np.flatnonzero(rng.random(m) < 0.4) for _ in range(n)]
        values, y, c = rng.standard_normal(m), np.where(rng.random(n) < 0.5, 1.0, -1.0), np.full(n, 0.7)
        x = np.zeros((n, m + 1))
        for i, f in enumerate(rows):
            x[i, f] = values[f] / np.sqrt(max(1, len(f)))
        x[:, m] = 1.0
        q = (y[:, None] * x) @ (y[:, None] * x).T
        alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q).max()
        for _ in range(20_000):
            alpha = np.clip(alpha - step * (q @ alpha - 1), 0, c)
        primal = lambda w: w @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w))).sum()
        w, b = nbsvm.descend(rows, values, y, c, passes=400)
        assert primal(np.append(w, b)) <= primal(x.T @ (alpha * y)) * 1.01 + 1e-6


def test_place():
    """Every vector goes where the dot product with the capacity left is highest, by plain loops."""
    rng = np.random.default_rng(1)
    for shards in (2, 5):
        v = rng.integers(1, 100, (60, 3)).astype(float)
        share = v / v.sum(axis=0)
        left = [[1 / shards] * 3 for _ in range(shards)]
        want = {}
        for i in sorted(range(len(v)), key=lambda i: (-share[i].max(), i)):
            s = max(range(shards), key=lambda s: (sum(a * b for a, b in zip(left[s], share[i])), -s))
            want[i] = s
            left[s] = [a - b for a, b in zip(left[s], share[i])]
        got = sharding.place(v, shards)
        assert sum(int(got[i]) != s for i, s in want.items()) <= 1  # sums may round otherwise in a tie
