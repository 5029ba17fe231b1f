"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and runs of words. Each word has a weight that
depends on the element it stands in (and on whether it is a link), each tag one that
depends on its name; both come from labelled pages (pages whose markup names exactly one
main element), as log-odds of standing inside against outside, over all such pages. Where
a page names main elements, standing in one or not is a further feature. A linear scan
finds the contiguous region with the highest sum.

Elements that never belong to an article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments of readers) are barred: their words and tags
weigh nothing, so that one inside an article, however long, doesn't part it, and they are
left out of the text. An element is barred by its name or by a word of its class, id or
role. The latter doesn't hold

* for words that labelled pages show to stand in main elements more often than not;
* for ancestors of the page's main element, and for an element (not of comments) that
  holds most of the words in paragraphs;
* for parts of a compound that is negated ("no-sidebar"), or that names a paragraph, a
  heading, a list item or a cell ("related-work"): these are barred by a whole name only.

Null, empty and word-free pages give an empty text. Repeated rows get a row each. Pages
are of any length and depth; unclosed and stray tags are allowed. Without labelled pages,
fixed weights apply; an empty table gives an empty result. Extra columns are ignored. One
narrow aggregate is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, tidied

# Element names by the HTML standard.
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements in which no main text stands.
NEVER = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "title", "head", "menu", "button", "select", "textarea", "dialog"}
#: Words of class, id or role that mark such an element, whatever its name.
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "footer", "header", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
READERS = {"comment", "comments", "commentlist", "replies", "reply"}
FRAMES = {"header", "footer", "widget"}  # words that are also used for parts of an article, in compounds
NEGATED = {"no", "not", "without", "with", "has", "hide", "hidden"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt", "pre", "blockquote", "figcaption", "caption"}
MAIN = ("article", "main")
INLINE = {"a", "abbr", "b", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}
NAMED = BLOCKS | VOID | NEVER | INLINE

#: Attributes as the standard has them: a quote counts at the start of a value only.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s]*)))?""")
PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def marks(attributes: str) -> tuple[set[str], set[str]]:
    """Words of MARKED among the names of class, id and role: (whole names, parts of compounds that aren't negated)."""
    whole: set[str] = set()
    parts: set[str] = set()
    low = attributes.lower()
    if "class" in low or "id" in low or "role" in low:
        for m in ATTRIBUTE.finditer(low):
            if m[1] in ("class", "id", "role"):
                for name in (m[2] or m[3] or m[4] or "").split():
                    some = [x for x in PART.split(name) if x]
                    if len(some) == 1:
                        whole.update(x for x in some if x in MARKED or x in READERS)
                    elif not NEGATED.intersection(some):
                        parts.update(x for x in some if x in MARKED or x in READERS)
    return whole, parts


class Page:
    """tokens (kind, name, text, node): kind 't' is text, 'o' an opening and 'c' a closing tag; nodes are elements, 0 the page.

    element: by node, the innermost block; with "~" at its end inside a link, with "-"
    before it in a barred element. main: by node, whether it lies in a main element.
    """

    def __init__(self, html: str, ignored: frozenset[str] = frozenset()):
        self.tokens: list[tuple[str, str, str, int]] = []
        self.parent, self.name, self.element = [0], ["body"], ["body"]
        self.whole: dict[int, set[str]] = {}
        self.parts: dict[int, set[str]] = {}
        self.ignored = ignored
        self.parse(html)
        self.judge()

    def parse(self, html: str) -> None:
        tokens, stack = self.tokens, [0]
        open_: Counter = Counter()
        at, n, ends = 0, len(html), html.rfind(">")

        def node(name: str, attributes: str) -> int:
            above = stack[-1]
            k = len(self.name)
            self.parent.append(above)
            self.name.append(name)
            around = self.element[above]
            self.element.append(name if name in BLOCKS else around if name != "a" or around.endswith("~") else around + "~")
            if attributes:
                whole, parts = marks(attributes)
                if whole:
                    self.whole[k] = whole
                if parts:
                    self.parts[k] = parts
            return k

        def close() -> str:
            name = self.name[stack.pop()]
            open_[name] -= 1
            return name

        while at < n:
            lt = html.find("<", at)
            m = TOKEN.match(html, lt) if lt >= 0 and (lt < ends or html.startswith("<!--", lt)) else None
            if lt < 0 or m is None:  # a sign that opens no tag is text
                end = n if lt < 0 else lt + 1
                tokens.append(("t", "", html[at:end], stack[-1]))
                at = end
                continue
            if lt > at:
                tokens.append(("t", "", html[at:lt], stack[-1]))
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                tokens.append(("c", name, "", stack[-1]))
                if open_[name] > 0:
                    while close() != name:
                        pass
                continue
            if name in VOID or m[3].endswith("/"):
                tokens.append(("o", name, "", node(name, m[3])))
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in BLOCKS and open_["p"] > 0 and self.name[stack[-1]] == "p":
                while self.name[stack[-1]] not in BLOCKS or self.name[stack[-1]] == "p":  # an open paragraph ends here, and so do the spans in it
                    close()
                if len(stack) > 1 and self.name[stack[-1]] == name and name != "p":
                    close()
            k = node(name, m[3])
            tokens.append(("o", name, "", k))
            stack.append(k)
            open_[name] += 1
            if name in RAW:
                shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                if name == "title":
                    tokens.append(("t", "", html[at : shut.start() if shut else n], k))
                at = shut.end() if shut else n
                if shut:
                    tokens.append(("c", name, "", k))
                close()

    def judge(self) -> None:
        """Bars, and main elements."""
        n = len(self.name)
        hard, marked, readers = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            hard[k] = hard[self.parent[k]] or self.name[k] in NEVER
        for k in self.whole.keys() | self.parts.keys():
            name, whole, parts = self.name[k], self.whole.get(k, set()) - self.ignored, self.parts.get(k, set()) - self.ignored
            readers[k] = bool(READERS & (whole if name in LEAVES else whole | parts))
            if name in MAIN:
                marked[k] = readers[k]
            elif name not in ("html", "body"):
                marked[k] = bool(whole) or bool(parts) and name not in LEAVES
        words, paragraphs = [0] * n, [0] * n
        for kind, _, text, k in self.tokens:
            if kind == "t" and not hard[k]:
                w = len(text.split())
                words[k] += w
                if self.element[k].removesuffix("~") in ("p", "body"):
                    paragraphs[k] += w
        for k in range(n - 1, 0, -1):
            words[self.parent[k]] += words[k]
            paragraphs[self.parent[k]] += paragraphs[k]
        most = [2 * paragraphs[k] > paragraphs[0] and not readers[k] and self.name[k] not in LEAVES for k in range(n)]
        soft = [False] * n
        for k in range(1, n):
            soft[k] = soft[self.parent[k]] or marked[k] and not most[k]
        self.mains: list[int] = []
        for kind in MAIN:
            found = [k for k in range(1, n) if self.name[k] == kind and not hard[k] and not readers[k]]
            clear = [k for k in found if not soft[k]]
            if clear or found:
                self.mains = clear or [max(found, key=lambda k: (words[k], -k))]
                break
        main, above = [False] * n, set()
        for k in self.mains:
            main[k] = True
            while k:
                k = self.parent[k]
                if k in above:
                    break
                above.add(k)
        barred = [False] * n
        for k in range(1, n):
            up = self.parent[k]
            main[k] = main[k] or main[up]
            if marked[k] and main[k] and self.name[k] not in MAIN and not self.whole.get(k, set()) - self.ignored:  # in an article, compounds of FRAMES mark nothing
                marked[k] = bool(self.parts[k] - self.ignored - FRAMES)
            barred[k] = barred[up] or self.name[k] in NEVER or marked[k] and k not in above and not most[k]
            if barred[k]:
                self.element[k] = "-" + self.element[k]
        self.main = main

    def labelled(self) -> int | None:
        """The one main element that the markup names, if there is one."""
        for kind in MAIN:
            found = [k for k in range(1, len(self.name)) if self.name[k] == kind]
            if len(found) == 1:
                return found[0]
        return None


def counted(html: str) -> Counter:
    """(feature, inside) -> words or tags, on a page that names one main element; else empty."""
    out: Counter = Counter()
    page = Page(html)
    main = page.labelled()
    if main is None:
        return out
    n = len(page.name)
    inside, classes = [False] * n, [frozenset()] * n
    for k in range(1, n):
        up = page.parent[k]
        inside[k] = k == main or inside[up]
        own = page.whole.get(k, set()) | page.parts.get(k, set())
        classes[k] = classes[up] | own if own else classes[up]
    for kind, name, text, k in page.tokens:
        if kind == "t":
            if w := len(text.split()):
                out["w:" + page.element[k], inside[k]] += w
                for c in classes[k]:
                    out["c:" + c, inside[k]] += w
        else:
            out["t:" + (name if name in NAMED else "other"), inside[k]] += 1
    return out


#: Where nothing is learned: words in blocks of text for, all else against.
PRIOR_WORD = {"p": 1.0, "h1": 1.0, "h2": 0.8, "h3": 0.8, "blockquote": 0.8, "pre": 0.8, "article": 1.0, "main": 0.8, "td": 0.5, "li": 0.5, "dd": 0.5, "figcaption": 0.5, "section": 0.5, "div": 0.3, "p~": 0.5}
WORD, TAG, NAMED_MAIN, FEW = 3.0, 2.0, 4.0, 50  # bounds of log-odds; words or tags that count as few


class Weights:
    """Weights of words by element and of tags by name; the words of MARKED that mark nothing."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.words, self.tags = dict(PRIOR_WORD), {}
        total = {side: {kind: sum(v for (f, i), v in counts.items() if i == side and f[0] == kind) for kind in "wtc"} for side in (True, False)}
        for f in {f for f, _ in counts if f[0] != "c"}:
            n = [counts.get((f, side), 0) for side in (True, False)]
            odds = math.log((n[0] + 0.5) / (total[True][f[0]] + 1) * (total[False][f[0]] + 1) / (n[1] + 0.5))
            share = sum(n) / (sum(n) + FEW)  # a few words or tags prove little: the rest is the fixed weight
            if f[0] == "w":
                self.words[f[2:]] = share * max(-WORD, min(WORD, odds)) + (1 - share) * self.word(f[2:])
            else:
                self.tags[f[2:]] = share * max(-TAG, min(-0.02, odds / 2 - 0.2)) + (1 - share) * self.tag(f[2:])
        self.ignored = frozenset(f[2:] for f in {f for f, _ in counts if f[0] == "c"} if counts.get((f, True), 0) > counts.get((f, False), 0) + FEW)

    def word(self, element: str) -> float:
        return self.words.get(element, 0.05 if element.endswith("~") else 0.1)

    def tag(self, name: str) -> float:
        return self.tags.get(name if name in NAMED else "other", -0.1)


def region(page: Page, weights: Weights) -> tuple[int, int]:
    """First and last + 1 of the tokens with the highest sum; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    named = bool(page.mains)
    for i, (kind, name, text, k) in enumerate(page.tokens):
        element = page.element[k]
        if element[0] == "-":  # left out of the text in any case
            continue
        inside = page.main[k]
        if kind == "t":
            w = len(text.split())
            total += w and w * (weights.word(element) + (0 if not named else NAMED_MAIN if inside else -NAMED_MAIN))
        else:
            total += -0.02 if named and inside else weights.tag(name)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(html: str, weights: Weights) -> str:
    page = Page(html, weights.ignored)
    lo, hi = region(page, weights)
    blocks, held = [], []
    for kind, name, text, k in page.tokens[lo:hi]:
        if kind == "t":
            if page.element[k][0] != "-":
                held.append(text)
        elif name in BLOCKS:
            blocks.append("".join(held))
            held = []
        elif name == "br":
            held.append(" ")
    blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(unescape(x).split()) for x in blocks) if b)


def learn(pages: DataFrame, html_column: str = "html") -> Weights:
    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for h in batch.column(0).to_pylist():
                total.update(counted(h or ""))
            keys = list(total)
            yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in keys], "inside": [i for _, i in keys], "n": [total[k] for k in keys]})

    # features are names from fixed lists, so there are at most some hundreds
    got = pages.select(html_column).mapInArrow(tidied(run), "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return Weights({(r["feature"], r["inside"]): r["n"] for r in got})


def extract(pages: DataFrame, weights: Weights | None = None, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns kept, text and n_chars."""
    weights = learn(pages, html_column) if weights is None else weights
    held = Shared(pages.sparkSession, weights)  # some hundreds of numbers
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h or "", held.value) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_column).mapInArrow(tidied(run), f"{fields}, text string, n_chars long")
