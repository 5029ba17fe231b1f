"""Decontamination and HTML extraction."""

import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd

from grovewright.llm import decontamination as dc
from grovewright.llm import html, queries


def brute_align(a, b, match=2, cost=1):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (match if a[i] == b[j] else -cost), h[i, j + 1] - cost, h[i + 1, j] - cost)
    return h.max()


def test_align():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 30))
        matched, lo, hi = dc.align(a, b)
        assert 0 <= lo <= hi <= len(b) and matched <= min(len(a), hi - lo)
        assert 2 * matched >= brute_align(a, b)
    assert dc.align(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 8, 3, 4, 9])) == (4, 1, 6)


def planted(seed=4, n=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [[word() for _ in range(rng.randint(2 if i < 3 else 15, 50))] for i in range(30)]
    docs, leaks = [], {}
    for d in range(n):
        text = [word() for _ in range(rng.randint(0, 400))]
        if d % 5 == 0:
            k = rng.randrange(len(items))
            passage = [w for w in items[k] if len(items[k]) < 15 or rng.random() > 0.08]
            passage = [word() if len(items[k]) >= 15 and rng.random() < 0.1 else w.upper() for w in passage]
            at = rng.randint(0, len(text))
            text[at:at] = passage
            leaks[d] = k
        docs.append((d, " ".join(text)))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)], leaks


def test_planted(spark, monkeypatch):
    docs, items, leaks = planted()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in dc.flag(df, bench).collect()}
    assert {d for d, r in got.items() if r.contaminated} == set(leaks)
    assert all(leaks[d] in got[d].item_ids for d in leaks)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 200)
    again = {r.doc_id: r for r in dc.flag(df, bench).collect()}
    assert {d: (r.score, sorted(r.item_ids)) for d, r in again.items()} == {d: (r.score, sorted(r.item_ids)) for d, r in got.items()}


def test_hot_item(spark):
    docs, items, _ = planted()
    hot = [(1000 + i, f"lead {i} " + items[9][1] + f" tail {i}") for i in range(400)]
    got = dc.flag(spark.createDataFrame(docs + hot, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.where("doc_id >= 1000 and contaminated").count() == 400


def test_edited_copies_beside_a_whole_one(spark):
    """The n-grams that the copies share are far more frequent than those of the whole copy."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(7))
    item = [word() for _ in range(40)]
    edited = lambda: [word() if i % 4 == 3 else w for i, w in enumerate(item)]
    docs = [(0, " ".join(item))] + [(d, " ".join([word() for _ in range(30)] + edited() + [word() for _ in range(30)])) for d in range(1, 201)]
    docs += [(1000 + d, " ".join([word() for _ in range(60)] + item[:3])) for d in range(200)]  # a phrase of it is no leak
    got = {r.doc_id: r for r in dc.flag(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert {d for d, r in got.items() if r.contaminated} == set(range(201))
    assert got[0].score == 1 and all(got[d].score == 0.75 for d in range(1, 201)) and all(got[d].score == 0 for d in range(1000, 1200))


def test_decontamination_odd(spark, odd_docs, empty_docs):
    bench = spark.createDataFrame([(1, None), (2, " "), (3, "one two three")], "item_id long, text string")
    got = dc.flag(odd_docs, bench).collect()
    assert len(got) == 15 and {r.doc_id for r in got if r.contaminated} == {5, 6}
    assert dc.flag(empty_docs, bench).count() == 0
    assert dc.flag(odd_docs, bench.limit(0)).where("contaminated").count() == 0


def test_pages(spark):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in queries.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    for p in pages.itertuples():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [re.sub(r"<[a-z/][^>]*>", lambda m: " " if "br" in m[0] else "", x) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        want = "\n".join(x for x in (" ".join(unescape(x).split()) for x in parts) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


HARD = """<html><head><title>T</title></head><body><header class="site">Top words here</header><div id="cookie-notice">We use cookies now</div>
<nav><a href=x>Home page</a></nav><main><h1>Head &amp; line</h1><p>First   <b>bold</b>&nbsp;words, a < b and 3 > 2 here.<p>Second one<br>with break &#233;.
<aside>Side bar words many words</aside><div class="ad-box">Buy this now please</div><ul><li>Point one here<li>Point two here</ul><form>Your name</form>
<p>Last of all words in it.</p><script>var x = "<p>no</p>";</script></main><section class="comments"><p>Nice post, thank you all</p></section><footer>End words</footer>"""


def test_hard_page(spark):
    table = [(1, "u", HARD), (2, "u", None), (3, None, ""), (4, "u", "<p>"), (5, "u", "plain words only"), (5, "u", "plain words only"), (6, "u", "<div><<a <p>x y z</div>" * 500), (7, "u", "<script>never closed")]
    df = spark.createDataFrame([(*r, 1) for r in table], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert html.extract(df).count() == len(table)
    assert got[1].split("\n") == ["Head & line", "First bold words, a < b and 3 > 2 here.", "Second one with break é.", "Point one here", "Point two here", "Last of all words in it."]
    assert got[2] == got[3] == got[4] == got[7] == "" and got[5] == "plain words only" and "x y z" in got[6]
    assert html.extract(df.limit(0)).count() == 0


def test_long_inserts():
    """Barred elements in an article, longer than what stands before or after them."""
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    counts = Counter()
    for _ in range(50):
        counts.update(html.counted(f"<body><nav>{words(9, 'n')}</nav><div class=ad>{words(40, 'a')}</div><article><h1>{words(8, 'h')}</h1><p>{words(90, 'p')}</p></article><div>{words(20, 'd')}</div><footer>{words(9, 'f')}</footer></body>"))
    weights = html.Weights(counts)
    head, lead, middle, last = words(11, "h"), words(30, "l"), words(40, "m"), words(12, "z")
    for insert in (f"<div class=ad>{words(300, 'x')}</div>", f"<aside><p>{words(300, 'x')}</p></aside>", f"<form><label>{words(200, 'x')}</label><input><input></form>", "<script>x</script><div class=promo><img/><br/></div>" * 60):
        page = f"<body><nav>{words(9, 'n')}</nav><article><h1>{head}</h1>{insert}<p>{lead}</p>{insert}<p>{middle}</p>{insert}<p>{last}</p></article><div>{words(20, 'd')}</div>{insert}</body>"
        assert html.main_text(page, weights).split("\n") == [head, lead, middle, last]
