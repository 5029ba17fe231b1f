"""Markdown blocks: headings, fences, front matter, links, as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
LINK = re.compile(r"(?<!\\)!?\[((?:[^\[\]\\]|\\.)*)\]\((?:<([^<>\n]*)>|([^\s()<>]*))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)")
REFERENCE = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s+[\"'(].*)?$")
CODE = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)")


def scan(text: str) -> Iterator[tuple[str, int | None, str, int]]:
    """(kind, level, text, line) of a document, lines from 1."""
    lines = text.split("\n")
    at, fence, paragraph = 0, None, []
    if lines and lines[0].rstrip() == "---":
        end = next((i for i in range(1, min(len(lines), 1001)) if lines[i].rstrip() in ("---", "...")), None)
        if end is None:
            yield "unsupported", None, "front matter without an end", 1
        else:
            yield "front_matter", None, "\n".join(lines[1:end]), 1
            at = end + 1
    for n in range(at, len(lines)):
        line = lines[n]
        indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip(" "))
        if fence:
            m = FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        if not line.strip():
            paragraph = []
            continue
        if indent >= 4 and not paragraph:
            continue
        m = FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], []
            yield "fence", None, m[2].strip(), n + 1
            continue
        under = re.match(r"^ {0,3}(=+|-+)[ \t]*$", line)
        if under and paragraph:
            if len(paragraph) == 1:
                yield "heading", 1 if under[1][0] == "=" else 2, paragraph[0].strip(), n
            else:
                yield "unsupported", None, "heading of several lines", n + 1
            paragraph = []
            continue
        m = ATX.match(line)
        if m:
            yield "heading", len(m[1]), (m[2] or "").strip(), n + 1
            paragraph = []
        elif re.match(r"^ {0,3}#{7,}(\s|$)", line):
            yield "unsupported", None, "heading below level 6", n + 1
        elif re.match(r"^ {0,3}(?:>|[-*+]|\d+[.)])\s*#{1,6}\s", line):
            yield "unsupported", None, "heading inside a quote or list", n + 1
        else:
            paragraph.append(line)
        m = REFERENCE.match(line)
        if m:
            yield "link", None, m[2], n + 1
        for m in LINK.finditer(CODE.sub(lambda c: " " * len(c[0]), line)):
            yield "link", None, m[2] if m[2] is not None else m[3], n + 1


def blocks(docs: DataFrame, path_column: str = "path", text_column: str = "text") -> DataFrame:
    """(path, kind, level, text, line)"""

    def run(frames):
        for pdf in frames:
            rows = [(p, *r) for p, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for r in scan(t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "level", "text", "line"]).astype({"level": "Int32", "line": "int32"})

    return docs.select(F.col(path_column).cast("string").alias("path"), text_column).mapInPandas(run, "path string, kind string, level int, text string, line int")


def sections(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Headings with the last line of their section: the one before the next heading of the same or a higher level."""
    h = found.where("kind = 'heading'").select("path", "level", "text", "line")
    later = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= v, F.col("line"))).over(later) for v in range(1, 7)]  # one for each level there is
    h = h.withColumn("next", F.get(F.array(*ends), F.col("level") - 1))
    return h.join(lengths, "path").select("path", "level", "text", "line", F.coalesce(F.col("next") - 1, F.col("lines")).alias("end_line"))


def outcome(destination: Column) -> Column:
    """What a destination is before it is looked up."""
    return F.when(destination.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "external").when(destination.startswith("#"), "fragment").when(destination.startswith("//"), "external").when(destination.rlike(r"[\x00-\x1f]") | destination.rlike(r"(^|/)\.\.(/|$)"), "refused")


def link_outcomes(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links (destination, ...) with outcome: external, fragment, refused, file or not_indexed."""
    target = F.regexp_replace(F.regexp_replace("destination", "[#?].*$", ""), "^/", "")
    rows = links.withColumn("target", target).withColumn("before", outcome(F.col("destination")))
    known = paths.select(F.regexp_replace("path", "^/", "").alias("target")).distinct().withColumn("known", F.lit(True))
    return rows.join(known, "target", "left").withColumn("outcome", F.coalesce("before", F.when(F.col("known"), "file"), F.lit("not_indexed"))).drop("before", "known", "target")
