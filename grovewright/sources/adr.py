"""Decision records in Markdown: their numbers, status and supersession."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = re.compile(r"\bADR[-_ ]?0*(\d+)\b", re.I)
HEADER = re.compile(r"^\s*(?:[-*]\s*)?(?:\*\*)?(status|supersedes)(?:\*\*)?\s*:\s*(?:\*\*)?\s*(.*?)\s*$", re.I)
LINKED = re.compile(r"\]\(([^)\s]+)\)")


def facts(path: str, text: str) -> dict:
    """Number (from the file's name, else the first heading), status (a header line, else the section) and what it supersedes.

    Supersession by link names a path; by bare number it names that, and several numbers
    in one statement are ambiguous.
    """
    lines = text.split("\n")
    base = path.rsplit("/", 1)[-1]
    title = next((x for x in lines if x.startswith("# ")), "")
    m = NUMBER.search(base) or re.match(r"^0*(\d+)[-_]", base) or NUMBER.search(title)
    status, targets, ambiguous = None, [], False
    for i, line in enumerate(lines):
        h = HEADER.match(line)
        if h and h[1].lower() == "status" and status is None:
            status = h[2].strip("* ").split(" ")[0] or None
        elif re.match(r"^## +status\s*$", line, re.I) and status is None:
            status = next((x.strip().split(" ")[0].strip("*.") for x in lines[i + 1 :] if x.strip()), None)
        elif h and h[1].lower() == "supersedes":
            links = LINKED.findall(h[2])
            numbers = sorted({int(n) for n in NUMBER.findall(h[2])})
            if links:
                targets += links
            elif len(numbers) == 1:
                targets.append(f"adr:{numbers[0]}")
            elif numbers:
                ambiguous = True
    return {"path": path, "adr": int(m[1]) if m else None, "status": status, "supersedes": targets, "ambiguous": ambiguous}


def records(files: DataFrame) -> DataFrame:
    def run(frames):
        for pdf in frames:
            rows = [facts(p, t or "") for p, t in zip(pdf["path"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["path", "adr", "status", "supersedes", "ambiguous"]).astype({"adr": "Int64"})

    return files.select("path", "text").mapInPandas(run, "path string, adr long, status string, supersedes array<string>, ambiguous boolean")


def supersession(found: DataFrame) -> DataFrame:
    """(source, target, reason): resolved by number or by path; what resolves to none or to several keeps its reason."""
    from ..functions.scalars import normal_path

    each = found.select(F.col("path").alias("source"), F.explode("supersedes").alias("raw"))
    folder = F.regexp_replace("source", "/?[^/]*$", "")
    by_path = F.when(~F.col("raw").startswith("adr:"), normal_path(F.when(folder == "", F.col("raw")).otherwise(F.concat_ws("/", folder, F.regexp_replace("raw", "#.*$", "")))))
    each = each.withColumns({"wanted": by_path, "number": F.when(F.col("raw").startswith("adr:"), F.expr("try_cast(substring(raw, 5) AS BIGINT)"))})
    numbers = found.where("adr IS NOT NULL").groupBy(F.col("adr").alias("number")).agg(F.count("*").alias("n"), F.min("path").alias("by_number"))
    out = each.join(numbers, "number", "left").join(found.select(F.col("path").alias("wanted"), F.col("path").alias("by_path")), "wanted", "left")
    target = F.coalesce("by_path", F.when(F.col("n") == 1, F.col("by_number")))
    reason = F.when(target.isNull(), F.when(F.col("n") > 1, "ambiguous_number").when(F.col("number").isNotNull(), "no_such_number").otherwise("not_indexed"))
    return out.select("source", "raw", target.alias("target"), reason.alias("reason"))


def contradictions(links: DataFrame, found: DataFrame) -> DataFrame:
    """One row: distinct superseded documents that still say they are accepted."""
    accepted = found.where(F.lower("status") == "accepted").select(F.col("path").alias("target"))
    return links.where("target IS NOT NULL").join(accepted, "target", "left_semi").agg(F.count_distinct("target").alias("contradictions"))
