"""HTML extraction on hand-made pages; the scan against all regions."""

import random
import time

import pytest

from grovewright.llm import html
from grovewright.llm.html import Page, Weights, main_text, region

A = "The first sentence of the article has some nine or ten words."
B = "Another paragraph follows it with a dozen more words for good measure here."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
FOOT = "<footer><p>All rights reserved by someone or other since long ago.</p></footer>"
LONG = " ".join(["word"] * 60)

PAGES = {
    # wrappers and parts whose class, id or role holds a word of the list
    "no-sidebar": (f'{NAV}<div class="content no-sidebar"><article><p>{A}</p><p>{B}</p></article></div>{FOOT}', [A, B]),
    "page-with-header": (f'<div id="page-with-header"><article><p>{A}</p><p>{B}</p></article></div>', [A, B]),
    "post social": (f'<div class="post social"><article><p>{A}</p><p>{B}</p></article></div>', [A, B]),
    "elementor-widget": (f'<div class="elementor-widget"><article><p>{A}</p></article></div>', [A]),
    "related-work": (f'<article><p>{A}</p><p class="related-work">{B}</p><p>{A}</p></article>', [A, B, A]),
    "wrapper without article": (f'{NAV}<div class="widget"><p>{A}</p><p>{B}</p></div>{FOOT}', [A, B]),
    "role": (f'<div role="search main"><main><p>{A}</p></main></div>', [A]),
    "marked body": (f'<body class="header sidebar"><article><p>{A}</p></article></body>', [A]),
    "section-header in article": (f'<article><div class="section-header"><h2>Part one</h2></div><p>{A}</p></article>', ["Part one", A]),
    "sidebar": (f'<article><p>{A}</p></article><div class="sidebar"><p>{LONG}</p></div>', [A]),
    "right-sidebar": (f'<div class="right-sidebar"><p>Buy now, offers end soon.</p></div><article><p>{A}</p></article>', [A]),
    "advert in article": (f'<article><h1>A title of some eleven words that stands before an advert</h1><div class="ad">{LONG}</div><p>{A}</p></article>', ["A title of some eleven words that stands before an advert", A]),
    "ad-slot in mid-article": (f'<article><p>{A}</p><div class="ad-slot">{LONG}</div><p>{B}</p></article>', [A, B]),
    "p class ad": (f'<article><p>{A}</p><p class="ad">{LONG}</p><p>{B}</p></article>', [A, B]),
    "aside in article": (f"<article><p>{A}</p><aside><p>{LONG}</p></aside><p>{B}</p></article>", [A, B]),
    "form in article": (f"<article><p>{A}</p><form><p>{LONG}</p><label>Mail</label><input name=m></form><p>{B}</p></article>", [A, B]),
    "cookie notice": (f'<div class="cookie-notice"><p>{LONG}</p></div><article><p>{A}</p></article>', [A]),
    "social-share": (f'<article><p>{A}</p><ul class="social-share"><li>Tweet</li></ul><p>{B}</p></article>', [A, B]),
    # comments of readers
    "comments": (f'<article><p>{A}</p></article><section id="comments"><p>{LONG}</p><p>{LONG}</p></section>', [A]),
    "comment articles": (f'<article><p>{A}</p><p>{B}</p></article><ol class="commentlist"><li><article class="comment-body"><p>{LONG}</p></article></li></ol>', [A, B]),
    "comments within": (f'<main><p>{A}</p><div class="comments"><p>{LONG}</p></div></main>', [A]),
    # pages that name no main element
    "plain": (f"{NAV}<div><h1>Title</h1><p>{A}</p><p>{B}</p></div>{FOOT}", ["Title", A, B]),
    "plain with advert": (f'<h1>Title</h1><div class=ad>{LONG}</div><p>{A}</p>', ["Title", A]),
    "bare text": (A, [A]),
    "leading list": (f"<ul><li>one point made</li><li>two points made</li></ul><p>{A}</p>", ["one point made", "two points made", A]),
    # lists and tables inside an article
    "list first": (f"<article><ul><li>one</li><li>two</li></ul><p>{A}</p></article>", ["one", "two", A]),
    "cell first": (f"<article><table><tr><td>x</td><td>y</td></tr></table><p>{A}</p></article>", ["x", "y", A]),
    "list last": (f"<article><p>{A}</p><ol><li>one<li>two</ol></article>", [A, "one", "two"]),
    "links": (f'<article><p><a href="/a">{A}</a></p></article><p><a href="/b">Read more of this here and there</a></p>', [A]),
    # attributes
    "apostrophe in unquoted value": (f"<article><p title=it's>{A} don't</p><p>{B}</p></article>", [A + " don't", B]),
    "unquoted class": (f"<article><p>{A}</p><div class=ad>{LONG}</div></article>", [A]),
    "sign in quoted value": (f"<article><p title='a > b'>{A}</p></article>", [A]),
    "class in another attribute's value": (f'<article><div data-x="class=ad" data-id="ad"><p>{A}</p></div></article>', [A]),
    "quote without a value": (f'<article><p "odd">{A}</p></article>', [A]),
    # markup that is not well formed, references
    "unclosed": (f"<article><p>{A}<p>{B}", [A, B]),
    "stray ends": (f"</div></p><article></b><p>{A}</p></article></div>", [A]),
    "signs": ("<article><p>a < b and 3 <4 &amp; &eacute;&#33; &lt;p&gt;</p></article>", ["a < b and 3 <4 & é! <p>"]),
    "white space": ("<article><p> a\n\t b&nbsp;c<br>d </p>\n\n<p></p></article>", ["a b c d"]),
    "script": (f"<article><script>var t='</p><p>x</p>';</script><p>{A}</p><style>p{{}}</style></article>", [A]),
    "comment markup": (f"<article><!-- <p>no</p> --><p>{A}</p><!-- open", [A]),
    "inline": ("<article><p>bo<b>l</b>d <i>and</i> <span>so on</span></p></article>", ["bold and so on"]),
    "empty": ("", []),
    "only tags": ("<article><p></p></article>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    for weights in (Weights({}), Weights(learned())):
        assert main_text(page, weights) == "\n".join(want)


def learned():
    """Counts as of labelled pages: paragraphs and a heading within the article, navigation and a footer without."""
    return {("w:p", True): 90_000, ("w:h1", True): 3000, ("w:-li~", False): 9000, ("w:-div", False): 3000, ("t:p", True): 9000, ("t:article", True): 900, ("t:h1", True): 900, ("t:div", False): 900, ("c:ad", False): 3000, ("c:notice", True): 900}


def test_class_words_are_learned():
    """Where labelled pages show a word inside main elements, it bars nothing."""
    page = f'<article><p>{A}</p><div class="notice"><p>{B}</p></div><p>{A}</p><p>{A}</p></article>'
    assert B not in main_text(page, Weights({})) and B in main_text(page, Weights(learned()))
    counts = html.counted(f'<article><p>{A}</p><div class="notice"><p>{B}</p></div></article><div class="ad">x y</div>')
    assert counts["c:notice", True] == len(B.split()) and counts["c:ad", False] == 2


def plain_region(page, weights):
    """The best sum over all regions, by trying each."""
    named, values = bool(page.mains), []
    for kind, name, text, k in page.tokens:
        element = page.element[k]
        if element.startswith("-"):
            values.append(0.0)
        elif kind == "t":
            w = len(text.split())
            values.append(w * (weights.word(element) + (0 if not named else 4.0 if page.main[k] else -4.0)) if w else 0.0)
        else:
            values.append(-0.02 if named and page.main[k] else weights.tag(name))
    sums = [(sum(values[i:j]), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    return max((s for s, _, _ in sums), default=0.0), values


def test_scan_finds_the_best_region():
    rng = random.Random(5)
    for round_ in range(150):
        parts = []
        for _ in range(rng.randint(1, 14)):
            tag = rng.choice(["p", "div", "li", "ul", "h1", "td", "aside", "article", "a", "section"])
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag}>{' w' * rng.randint(0, 9)}</{tag}>", " x y"]))
        page, weights = Page("".join(parts)), Weights(learned() if round_ % 2 else {})
        best, values = plain_region(page, weights)
        lo, hi = region(page, weights)
        assert abs(sum(values[lo:hi]) - max(best, 0.0)) < 1e-9


def test_deep_pages():
    for page in ("<div>" * 100_000 + "x y z", "<b>" * 100_000 + "x", "<p class=a><span>" * 50_000, "<div class=ad>" * 50_000 + "x", '<p a="' * 30_000):
        began = time.process_time()
        main_text(page, Weights({}))
        assert time.process_time() - began < 5


def test_edges(spark):
    rows = [(1, "u", None, 1.0), (2, "u", "", 2.0), (3, None, f"<article><p>{A}</p></article>", 3.0), (3, None, f"<article><p>{A}</p></article>", 3.0), (None, "u", "<p>x " * 200_000, 4.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text double")
    got = html.extract(pages).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id) == [(1, "u", "", 0), (2, "u", "", 0), (3, None, A, len(A)), (3, None, A, len(A))]
    assert [r.text for r in got if r.page_id is None] == ["\n".join(["x"] * 200_000)]
    assert html.extract(pages.limit(0)).count() == 0
