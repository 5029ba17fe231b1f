"""LM scoring: base scores by brute force, the model by its sums and by held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from grovewright.llm import lm, queries

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", ("" if t is None or t != t else t).translate(ASCII)), None]


def held_out(i):
    return i is None or i != i or zlib.crc32(str(int(i)).encode()) % 10 == 0


def check(rows, docs):
    texts = [(None if i is None or i != i else int(i), tokens_of(t)) for i, t in zip(docs.doc_id, docs.text)]
    c = Counter(x for i, t in texts if not held_out(i) for x in t)
    n = sum(c.values())
    z = math.log10(n + 0.1 * (len(c) + 1))
    want = sorted(((i, held_out(i), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10(c[x] + 0.1) - z for x in t)) for i, t in texts), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    for a, b in zip(sorted(got, key=lambda x: str(x[:5]) + f"{x[5]:.6f}"), sorted(want, key=lambda x: str(x[:5]) + f"{x[5]:.6f}"), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-6)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_documents(spark, documents, monkeypatch):
    rows = queries.op8_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    check(rows, documents)
    held = [r for r in rows if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.02


def test_small_head(spark, odd, odd_docs, empty_docs, monkeypatch):
    for name, value in (("HEAD", 9), ("TOP", 4), ("ENDINGS", 3), ("INPUTS", 5)):
        monkeypatch.setattr(lm, name, value)
    rows = lm.score_corpus(odd_docs.withColumnRenamed("score", "held_out")).collect()
    check(rows, odd)
    assert lm.score_corpus(empty_docs).count() == 0
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    check(lm.score_corpus(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect(), docs)


def test_partitions(spark, monkeypatch):
    """The model depends on the rows, not on their partitions, with one training part and with several."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for tokens in (10**9, 20_000):
        monkeypatch.setattr(lm, "PART_TOKENS", tokens)
        got = [{r.doc_id: r.score for r in lm.score_corpus(docs.repartition(n)).collect()} for n in (1, 6, 50)]
        for other in got[1:]:
            assert all(math.isclose(got[0][i], other[i], rel_tol=1e-6) for i in got[0])


def plain_scores(docs, v, model, counts):
    """score by loops over tokens: log10 of the class's softmax and of the word's share of its class."""
    c = {r.h: r.c for r in counts.collect()}
    hashed, codes, out = lm.WordHash(), lm.Codes(v), {}
    for i, t in docs:
        words = (t or "").encode().lower().split()
        code = [v.start] * lm.CONTEXT + [codes[w] for w in words] + [v.end]
        total = 0.0
        for k, w in enumerate([*words, None]):
            p = sum(model.r[v.input_of[code[k + lm.CONTEXT - 1 - d]]].astype(float) * model.c[d] for d in range(lm.CONTEXT))
            logits = model.q.astype(float) @ p + model.b
            y = v.class_of[code[k + lm.CONTEXT]]
            own = c.get(None, 0) if w is None else c.get(int(hashed.of([w]).view(np.int64)[0]), 0)
            total += (logits[y] - math.log(np.exp(logits).sum())) / math.log(10) + math.log10(own + 0.1) - v.log_mass[y]
        out[i] = total
    return out


def test_score_by_brute_force(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").head(40)
    df = spark.createDataFrame([(int(i), t) for i, t in zip(docs.doc_id, docs.text)], "doc_id long, text string")
    counts = lm.stored(lm.word_counts(df.where("doc_id % 3 > 0")))
    v = lm.vocabulary(counts)
    model = lm.train(df.where("doc_id % 3 > 0"), v)
    want = plain_scores(list(zip(docs.doc_id, docs.text)), v, model, counts)
    for r in lm.score(df, counts, v, model).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-4)


def test_normalised(spark):
    """All outcomes of the next token, the unknown word of each class among them, sum to 1."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7} ab cd{i % 3} the end a") for i in range(60)], "doc_id long, text string")
    counts = lm.word_counts(docs)
    v = lm.vocabulary(counts)
    model = lm.train(docs, v)
    laid, at = lm.laid_out([b"a b zz".split()], lm.Codes(v))
    p = np.zeros(len(at))
    for c in range(len(v.noise)):
        p += 10 ** model.log_class(v.input_of[laid], np.full(len(laid), c), at)
    assert np.allclose(p, 1, atol=1e-5)
    mass: Counter = Counter()
    for r in counts.collect():
        code = v.end if r.h is None else lm.Codes(v).head[r.h + (1 << 64) if r.h < 0 else r.h]
        mass[int(v.class_of[code])] += r.c + 0.1
    for c, m in enumerate(10**v.log_mass):
        unknown = 0.1 if min(lm.TOP, v.head) <= c < len(v.noise) - 1 else 0
        assert math.isclose(m, mass[c] + unknown, rel_tol=1e-9)


def test_sizes():
    """The context reaches three words back; 128 words and 63 endings are classes of their own."""
    model = lm.Model(np.eye(8, lm.DIM, dtype=np.float32), np.ones((lm.CONTEXT, lm.DIM), np.float32), *[np.zeros(1, np.float32)] * 2)
    near, far = np.array([1, *[2] * 3]), np.array([5, *[2] * 3])
    assert not np.array_equal(model.contexts(near, np.array([3]))[1], model.contexts(far, np.array([3]))[1])
    assert lm.TOP >= 128 and lm.ENDINGS >= 63


def test_step_follows_the_gradient():
    """A numeric derivative of the objective against the update's direction."""
    rng = np.random.default_rng(0)
    v = 6
    model = lm.Model(*(rng.standard_normal(s).astype(np.float32) * 0.3 for s in ((7, 2), (lm.CONTEXT, 2), (v, 2), (v,))))
    inputs, classes = rng.integers(0, 7, 30), rng.integers(0, v, 30)
    at, noise, draw = np.arange(lm.CONTEXT, 30), np.full(v, 1 / v, np.float32), np.array([0, 3, 3, 5])

    def objective(m):
        p = sum(m.r[inputs[at - 1 - i]] * m.c[i] for i in range(lm.CONTEXT)).astype(float)
        d = lambda s, c: s - np.log(len(draw) * noise[c])
        pos, neg = d((p * m.q[classes[at]]).sum(1) + m.b[classes[at]], classes[at]), d(p @ m.q[draw].T + m.b[draw], draw)
        return -np.log1p(np.exp(-pos)).sum() - np.log1p(np.exp(neg)).sum()

    flat = model.flat().astype(float)
    numeric = np.array([(objective(model.of(flat + e)) - objective(model.of(flat - e))) / 2e-2 for e in np.eye(len(flat)) * 1e-2])
    moved = model.of(flat.astype(np.float32))
    moved.g = [np.full_like(x, 1e12) for x in (moved.r, moved.c, moved.q, moved.b)]
    moved.r, moved.c, moved.q, moved.b = (x.astype(np.float64) for x in (moved.r, moved.c, moved.q, moved.b))
    before = np.concatenate([x.ravel().copy() for x in (moved.r, moved.c, moved.q, moved.b)])
    moved.step(inputs, classes, at, noise, draw)
    step = np.concatenate([x.ravel() for x in (moved.r, moved.c, moved.q, moved.b)]) - before
    assert step @ numeric / np.linalg.norm(step) / np.linalg.norm(numeric) > 0.999
