"""Coverage: interval mapping, symbol tallies, gaps, and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.helpers import cascade, first_by, only_by


def innermost(points: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """points (file, line, ...) with the innermost span (file, symbol, start_line, end_line) that holds the line.

    A range join: spans are cut into buckets of lines and joined on (file, bucket), so a
    long file doesn't meet all its spans. The shortest span wins; a tie gives no answer.
    """
    cells = spans.select("file", "symbol", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("cell"))
    at = points.select("file", "line").distinct().withColumn("cell", F.floor(F.col("line") / bucket))
    inside = at.join(cells, ["file", "cell"]).where("line BETWEEN start_line AND end_line")
    best = only_by(inside, ["file", "line"], [F.asc(F.col("end_line") - F.col("start_line"))]).select("file", "line", "symbol")
    return points.join(best, ["file", "line"], "left")


def merge_hits(records: DataFrame) -> DataFrame:
    """(file, line, hits): the greatest count over all records of a line."""
    return records.groupBy("file", "line").agg(F.max("hits").alias("hits"))


def symbol_tallies(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Per symbol: instrumented and covered lines, first and last covered, degree; lines outside every symbol are left out."""
    at = innermost(lines, spans).where("symbol IS NOT NULL")
    hit = F.when(F.col("hits") > 0, F.col("line"))
    out = at.groupBy("file", "symbol").agg(F.count("*").alias("instrumented"), F.count(hit).alias("covered"), F.min(hit).alias("first_covered"), F.max(hit).alias("last_covered"))
    return out.withColumn("degree", F.when(F.col("covered") == 0, None).when(F.col("covered") == F.col("instrumented"), "covered").otherwise("partial"))


def gaps(symbols: DataFrame, claims: DataFrame, measured: DataFrame) -> DataFrame:
    """Per symbol its state: covered, partial, uncovered (its file was measured) or unmeasured.

    The best claim is by degree, then more lines, then run and observation.
    """
    best = first_by(claims, ["symbol"], [F.asc("degree"), F.desc("covered_lines"), F.asc("run_id"), F.asc("observation_id")])
    rows = symbols.join(best.select("symbol", "degree", "covered_lines", "run_id"), "symbol", "left").join(measured.select("file").distinct().withColumn("measured", F.lit(True)), "file", "left")
    return rows.withColumn("state", cascade([(F.col("degree") == "covered", "covered"), (F.col("degree") == "partial", "partial"), (F.col("measured"), "uncovered")], "unmeasured")).drop("measured")


def gap_totals(found: DataFrame) -> DataFrame:
    """One row; all null where nothing was ever measured, which is not the same as zero."""
    any_ = F.max(F.col("state").isin("covered", "partial", "uncovered"))
    return found.agg(*[F.when(any_, F.count_if(F.col("state") == s)).alias(s) for s in ("covered", "partial", "uncovered", "unmeasured")])


def gap_totals_full(found: DataFrame, freshness: DataFrame) -> DataFrame:
    """gap_totals() with stale symbols, measured files and those of them that are stale; freshness (file, freshness) of measured files."""
    stale = freshness.where("freshness != 'fresh'").select("file").distinct()
    files = freshness.agg(F.count_distinct("file").alias("measured_files")).join(stale.agg(F.count("*").alias("stale_files")), F.lit(True))  # one row each
    symbols = found.where("state != 'unmeasured'").join(stale, "file", "left_semi").agg(F.count("*").alias("stale"))
    return gap_totals(found).join(symbols, F.lit(True)).join(files, F.lit(True))


def gap_rows(found: DataFrame, states: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Symbols in the given states (uncovered and unmeasured if none are named) by file, line and id; found has start_line."""
    return found.where(F.col("state").isin(states or ["uncovered", "unmeasured"])).orderBy("file", "start_line", "symbol").limit(limit)


def merge_traces(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per site one row. A run of the same id and artifact replaces itself, others are kept; the site's completion and
    binding are the weakest of its runs, its tests all of them."""
    key = ["caller", "callee", "file", "line", "run_id", "artifact"]
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    runs = first_by(both, key, [F.desc("__new"), F.asc("count"), F.asc("completion"), F.asc("binding")])
    return runs.groupBy("caller", "callee", "file", "line").agg(
        F.array_sort(F.collect_set("run_id")).alias("runs"), F.sum("count").alias("count"), F.min("completion").alias("completion"), F.min("binding").alias("binding"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tests")))).alias("tests"),
    )


def trace_binding(header: DataFrame, commit: str | None, merkle: str | None) -> DataFrame:
    """Any disagreement is stale, else any agreement bound, else unverified."""
    pairs = [(F.col("git_commit"), commit), (F.col("content_merkle"), merkle)]
    differs = [c.isNotNull() & (c != F.lit(v)) for c, v in pairs if v is not None]
    agrees = [c.isNotNull() & (c == F.lit(v)) for c, v in pairs if v is not None]
    any_of = lambda xs: F.array_contains(F.array(*xs), True) if xs else F.lit(False)
    return header.withColumn("binding", F.when(any_of(differs), "stale").when(any_of(agrees), "bound").otherwise("unverified"))
