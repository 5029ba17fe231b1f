"""Substring dedup against brute force, the automaton against plain search."""

import hashlib
import random
import re

import pandas as pd

from grovewright.llm import queries, substrings


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "" if t is None or t != t else t)


def brute(docs, least=20):
    """{(doc_id, text): digest}; documents are the distinct pairs of id and text, in the order of ids (and, within an id, the one given)."""
    seen, out = set(), {}
    for r in docs.sort_values("doc_id", kind="stable").itertuples():
        if r.doc_id != r.doc_id or (r.doc_id, r.text) in out:
            continue
        w = words_of(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                gone[i : i + least] = [True] * least
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[r.doc_id, r.text] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def check(rows, docs, least=20):
    """As multisets, rows with a null id apart."""
    want = brute(docs, least)
    assert len(rows) == len(docs)
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows if r.doc_id is not None)
    assert got == sorted((i, *want[i, t]) for i, t in zip(docs.doc_id, docs.text) if i == i)


def test_documents(spark, documents):
    check(queries.op9_substring_dedup(spark, "/root/testdata/sf0.01").collect(), documents)


def test_odd(spark, odd, odd_docs, empty_docs):
    check(substrings.digests(odd_docs).collect(), odd)
    assert substrings.digests(empty_docs).count() == 0


def run_of(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_repeated_ids(spark):
    """Rows that share an id and not the text are cut each by itself; repeated rows alike."""
    first = run_of("w", 30)
    rows = [(1, first), (5, "head " + first), (5, "other text entirely"), (5, "head " + first), (7, first), (7, first), (2, None), (2, "")]
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])
    check(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), docs)
    # of two texts of an id that share a passage, just one keeps it
    rows = [(3, first + " a"), (3, first + " b")]
    got = substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 30]


def test_names_and_kinds_of_ids(spark):
    """Extra columns pass through whatever they are called; ids need not be numbers."""
    first = run_of("w", 30)
    names = ["doc_id", "text", "copy", "spans", "__id", "id", "tie", "hash", "__hash", "h", "src"]
    rows = [("b", first, *range(9)), ("a", "x " + first, *range(9)), ("c", first, *range(9)), (None, first, *range(9)), ("d", None, *range(9))]
    out = substrings.remove(spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('doc_id', 'text') else 'int'}" for n in names)))
    assert out.columns == names
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(tuple(r)[2:] == tuple(range(9)) for r in got.values()) and got[None]["text"] == first and got["d"]["text"] is None
    left = [got[i]["text"] for i in "abc"]  # one of the three keeps the passage
    assert sum("w7 w8" in t for t in left) == 1
    small = spark.createDataFrame([(i, first if i else "q " + first) for i in range(3)], "doc_id int, text string")
    assert [r.n_removed for r in sorted(substrings.digests(small).collect())] == [0, 30, 30] and substrings.digests(small).schema["doc_id"].dataType.simpleString() == "int"


def test_long_texts(spark):
    """Texts above 1 MB, parts and wholes that repeat, across the blocks of a reference."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**9)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, "x " + " ".join(long[20_000:100_000]) + " y"), (3, " ".join(long)), (4, " ".join(long[32_750:32_790])), (5, "short")]
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])
    check(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect(), docs)


def test_small_alphabet(spark, monkeypatch):
    """Repeats that overlap themselves, and many shards and salts."""
    monkeypatch.setattr(substrings, "BLOCK", 16)
    monkeypatch.setattr(substrings, "LOAD_WORDS", 300)
    rng = random.Random(6)
    rows = []
    for d in range(120):
        w = [rng.choice("ab") if d % 3 else "a" for _ in range(rng.randint(0, 60))]
        if d % 4 == 0:
            w[5:5] = "the one passage that many of these documents share word for word".split()
        rows.append((d, " ".join(w)))
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])
    for least in (5, 6):
        check(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"), least).collect(), docs, least)


def test_automaton():
    rng = random.Random(2)
    for _ in range(200):
        parts = [[rng.choice("abc") for _ in range(rng.randint(0, 15))] for _ in range(3)]
        auto, at, ends = substrings.Automaton(), 0, {}
        for p in parts:
            auto.separate()
            auto.extend(p, at)
            for i in range(len(p) - 2):
                ends.setdefault(tuple(p[i : i + 3]), at + i + 2)
            at += len(p)
        q = [rng.choice("abcd") for _ in range(20)]
        want = [(i, ends[tuple(q[i - 2 : i + 1])]) for i in range(2, 20) if tuple(q[i - 2 : i + 1]) in ends]
        assert list(auto.matches(q, 3)) == want


def test_remove(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"start\n\nof  one {passage}\nend", 1), (2, f"  two\n {passage}\n\nrest of\ttwo", 2), (3, None, 3)]
    got = {r.doc_id: (r.text, r.x) for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()}
    assert got == {1: (rows[0][1], 1), 2: ("  two\n rest of\ttwo", 2), 3: (None, 3)}
