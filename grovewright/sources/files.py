"""File trees: discovery with a path guard, a deny-list and ignore rules."""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

# Directories that are never entered.
PRUNED = {".git", "node_modules", ".grovewright"}
MAX_BYTES = 2 << 20


def ignored(path: str, rules: list[str]) -> bool:
    """Ignore rules in order, the last that matches decides; "!" takes back, a slash at the end means directories, one inside anchors."""
    parts, out = path.split("/"), False
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negative, text = rule.startswith("!"), rule.lstrip("!")
        only_dir, text = text.endswith("/"), text.rstrip("/")
        anchored, text = "/" in text, text.lstrip("/")
        for k in range(1, len(parts) + 1):
            if only_dir and k == len(parts):
                continue
            name = "/".join(parts[:k]) if anchored else parts[k - 1]
            if fnmatch.fnmatchcase(name, text):
                out = not negative
                break
    return out


def discover(spark: SparkSession, root: str, rules: list[str] | None = None, pattern: str = "*") -> DataFrame:
    """(path, length, modified, outcome, language, content_hash): every file below root.

    Outcomes: file, denied (secrets, before any content is used), ignored, skipped (too
    large), refused (a path that climbs or holds control characters). Directory names in
    PRUNED hide what is below them; names that begin with a dot or an underscore are never listed by
    Spark's readers. The reader lists and reads files in parallel.
    """
    rules = rules or []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + ("/" + base.split(":")[-1].lstrip("/")).replace(".", r"\.") + "/", "")
    rows = files.select(rel.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in sorted(PRUNED)])))

    @F.pandas_udf("boolean")
    def by_rules(p: pd.Series) -> pd.Series:
        return p.map(lambda x: ignored(x, rules))

    outcome = F.when(~S.safe_path(F.col("path")), "refused").when(S.is_secret(F.col("path")), "denied")
    if rules:
        outcome = outcome.when(by_rules("path"), "ignored")
    outcome = outcome.when(F.col("length") > MAX_BYTES, "skipped").otherwise("file")
    rows = rows.withColumn("outcome", outcome)
    return rows.select("path", "length", "modified", "outcome", S.language(F.col("path")).alias("language"), F.when(F.col("outcome") == "file", F.sha2("content", 256)).alias("content_hash"), F.when(F.col("outcome") == "file", F.decode("content", "utf-8")).alias("text"))


def snippet(files: DataFrame, path: str, first: int, last: int, most_lines: int = 2000, most_bytes: int = 256 << 10) -> DataFrame:
    """(text, truncated) of lines first..last of an indexed file."""
    n = min(last, first + most_lines - 1) - first + 1
    cut = F.array_join(F.slice(F.split("text", "\n"), first, max(n, 0)), "\n")
    rows = files.where((F.col("path") == path) & (F.col("outcome") == "file")).select(cut.alias("text"))
    return rows.select(F.substring("text", 1, most_bytes).alias("text"), (F.lit(n < last - first + 1) | (F.length("text") > most_bytes)).alias("truncated"))
