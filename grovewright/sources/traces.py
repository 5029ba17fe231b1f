"""LCOV reports and NDJSON traces, read as lines by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = (
    "format string, format_version int, producer string, producer_version string, repository_root_name string, git_commit string, content_merkle string, run_id string, test_framework string, runtime string, runtime_version string, "
    "platform string, started_at string, completed_at string, completion_state string, partial_reason string, source_map_state string, producer_limitations array<string>"
)
RECORD = "test_id string, caller_file string, caller_line long, callee_file string, callee_line long, count long, worker string, async_context string, resolution string, unsupported_form string"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records with `unknown_keys`; a line that is no JSON object gives a record of nulls marked `malformed`."""
    known = F.array(*[F.lit(x) for x in names(RECORD)])
    keys = F.json_object_keys(column)
    return lines.select(F.from_json(column, RECORD, {"mode": "PERMISSIVE"}).alias("r"), F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), known)).alias("unknown_keys"), keys.isNull().alias("malformed")).select("r.*", "unknown_keys", "malformed")


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, records) of trace files; line 1 is the header. A file whose header has an unknown key or another format has no header here, and its records are left out."""
    text = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("artifact"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = text.withColumn("n", F.row_number().over(Window.partitionBy("artifact").orderBy("block", "at"))).where("n = 1")
    known = F.array(*[F.lit(x) for x in names(HEADER)])
    header = first.select("artifact", F.from_json("value", HEADER).alias("h"), F.json_object_keys("value").alias("keys")).where((F.size(F.array_except("keys", known)) == 0) & (F.col("h.format_version") == 1) & ~F.contains(F.col("h.repository_root_name"), F.lit("/")))
    header = header.select("artifact", "h.*")
    body = text.join(first.select("artifact", "block", "at"), ["artifact", "block", "at"], "left_anti").join(header.select("artifact"), "artifact", "left_semi")
    rows = body.select("artifact", F.from_json("value", RECORD).alias("r")).select("artifact", "r.*")
    good = (F.col("resolution") == "located") & (F.col("caller_line") > 0) & (F.col("callee_line") > 0) & (F.col("count") > 0) & F.col("unsupported_form").isNull()
    refused = F.when(F.col("unsupported_form").isNotNull(), "limitation").when(F.coalesce(F.col("resolution"), F.lit("")) != "located", "unresolved").when(~F.coalesce(good, F.lit(False)), "bad_number")
    return header, rows.withColumn("refused", refused)


def read_lcov(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines: report, file, line, hits; refusals: report, tag, n). Repeated lines keep the greatest count.

    A record ends with end_of_record; one without SF is counted and dropped, and so are an
    unfinished tail and lines that can't be read.
    """
    raw = spark.read.option("lineSep", "end_of_record").text(path).select(F.col("_metadata.file_path").alias("report"), "value", F.monotonically_increasing_id().alias("record"))
    last = raw.groupBy("report").agg(F.max("record").alias("record")).withColumn("tail", F.lit(True))
    return parse_lcov(raw.join(last, ["report", "record"], "left"))


def parse_lcov(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from records (report, record, value, and tail: true of what follows the last end_of_record)."""
    tail = F.coalesce("tail", F.lit(False)) if "tail" in raw.columns else F.lit(False)
    rec = raw.select("report", "record", tail.alias("tail"), F.regexp_extract("value", r"(?m)^SF:(.+?)\s*$", 1).alias("file"), F.split("value", r"\r?\n").alias("ls"))
    rec = rec.withColumn("ls", F.filter("ls", lambda x: F.trim(x) != "")).where("size(ls) > 0")
    whole = rec.where("NOT tail AND file != ''")
    da = whole.select("report", "file", F.explode(F.filter("ls", lambda x: x.startswith("DA:"))).alias("l")).select("report", "file", F.regexp_extract("l", r"^DA:(\d+),(\d+)(?:,.*)?$", 1).try_cast("long").alias("line"), F.regexp_extract("l", r"^DA:(\d+),(\d+)(?:,.*)?$", 2).try_cast("long").alias("hits"))
    lines = da.where("line > 0 AND hits IS NOT NULL").groupBy("report", "file", "line").agg(F.max("hits").alias("hits"))
    tags = rec.select("report", F.when(F.col("tail"), "unterminated").when(F.col("file") == "", "record_without_file").alias("tag")).where("tag IS NOT NULL")
    tags = tags.union(da.where("line IS NULL OR line <= 0 OR hits IS NULL").select("report", F.lit("bad_line")))
    tags = tags.union(whole.select("report", F.explode(F.filter("ls", lambda x: x.rlike("^TN:.+"))).alias("x")).select("report", F.lit("test_name_ignored")))
    return lines, tags.groupBy("report", "tag").agg(F.count("*").alias("n"))
