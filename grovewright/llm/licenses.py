"""License scans by diagonal voting, in DataFrame operations only.

The word 3-grams of all texts are joined by hash to the positions of 3-grams in the
license templates (a fixed table of under 200 rows, hence broadcast); a hit is checked
word by word and votes for its diagonal, word position minus template position. Votes
are counted by (document, template, diagonal), diagonals at most SLACK apart are merged
(an inserted or lost word shifts the diagonal), and a span counts if its votes cover
COVER of the template, or all of it if the template has fewer than SHORT words. A diagonal with all votes of a base template is a place where the
phrase stands word for word.

Null text is empty text; it has no words, no labels and score 0. Repeated rows get a row
each. Rows with one id and different texts are judged apart. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SLACK, COVER, SHORT = 3, 2, 0.6, 8

# The phrases of the contract with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Further notices by which the method finds labels.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "under the bsd license"),
    ("cc-by", "under the creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa"),
    ("gpl", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl-2", "mozilla public license version 2"),
]
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[tuple[int, str, bool, int, int, list[str]]]:
    """(template, label, is base, words, position, words of the 3-gram)"""
    out = []
    for i, (label, phrase) in enumerate(BASE + NOTICES):
        w = phrase.split()
        out += [(i, label, i < len(BASE), len(w), p, w[p : p + K]) for p in range(len(w) - K + 1)]
    return out


def words_of(text: Column) -> Column:
    # lower() is the fast path; it differs from folding A-Z in words that may match only for these two letters
    low = F.when(text.rlike("[Kİ]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(low, SPLIT), lambda w: w != "")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, n_words; spans: doc_id, key, template, label, is_base, start, last, exact, cover)"""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("key"), words_of(text).alias("words"))
    rows = split.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    grams = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    table = spark.createDataFrame(templates(), "template int, label string, is_base boolean, length int, at int, gram array<string>")
    table = table.withColumn("hash", F.xxhash64(F.get("gram", F.lit(0)), F.get("gram", F.lit(1)), F.get("gram", F.lit(2))))
    hits = (
        split.select("doc_id", "key", "words", F.posexplode(grams).alias("pos", "hash"))
        .join(F.broadcast(table), "hash")
        .where(F.slice("words", F.col("pos") + 1, K) == F.col("gram"))
        .select("doc_id", "key", "template", "label", "is_base", "length", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    )
    votes = (
        hits.dropDuplicates(["doc_id", "key", "template", "at", "pos"])  # rows that repeat
        .groupBy("doc_id", "key", "template", "label", "is_base", "length", "diagonal")
        .agg(F.count("*").alias("votes"), F.min("pos").alias("start"), F.max("pos").alias("last"))
    )
    near = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    merged = votes.withColumn("apart", (F.col("diagonal") - F.lag("diagonal", 1, -1000).over(near) > SLACK).cast("int")).withColumn("run", F.sum("apart").over(near))
    spans = (
        merged.groupBy("doc_id", "key", "template", "label", "is_base", "length", "run")
        .agg(
            F.sum("votes").alias("votes"), F.min("start").alias("start"), (F.max("last") + K).alias("end"),
            F.sum((F.col("votes") == F.col("length") - K + 1).cast("long")).alias("exact"),
            F.min(F.when(F.col("votes") == F.col("length") - K + 1, F.col("diagonal"))).alias("first_exact"),
            F.max(F.when(F.col("votes") == F.col("length") - K + 1, F.col("diagonal"))).alias("last_exact"),
        )
        .withColumn("cover", F.least(F.lit(1.0), (F.col("votes") + (K - 1)) / F.col("length")))
        .where(F.col("cover") >= F.when(F.col("length") < SHORT, 1.0).otherwise(COVER))
    )
    return rows, spans


def label_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows, spans = scan(docs, id_column, text_column)
    base = F.col("is_base") & (F.col("exact") > 0)
    found = spans.groupBy("doc_id", "key").agg(
        F.sum(F.when(base, F.col("exact")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_exact"))).alias("first_word"),
        F.max(F.when(base, F.col("last_exact"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "d", "key": "k"})
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def sql() -> str:
    """label_documents in DuckDB's SQL."""
    rows = ", ".join(f"({t}, '{label}', {str(b).lower()}, {n}, {p}, '{g[0]}', '{g[1]}', '{g[2]}')" for t, label, b, n, p, g in templates())
    return rf"""
    WITH t(template, label, is_base, length, tpos, g1, g2, g3) AS (VALUES {rows}),
    d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPLIT}'), lambda x: x <> '') AS w FROM documents),
    e AS (SELECT r, w, unnest(range(len(w) - 2)) AS pos FROM d WHERE len(w) > 2),
    h AS (SELECT r, template, label, is_base, length, pos, pos - tpos AS diagonal FROM e JOIN t ON w[pos + 1] = g1 AND w[pos + 2] = g2 AND w[pos + 3] = g3),
    v AS (SELECT r, template, label, is_base, length, diagonal, count(*) AS votes FROM h GROUP BY ALL),
    a AS (SELECT *, CASE WHEN diagonal - lag(diagonal, 1, -1000) OVER (PARTITION BY r, template ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS apart FROM v),
    m AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM a),
    s AS (SELECT r, template, label, is_base, length, run, least(1.0::DOUBLE, (sum(votes) + {K - 1})::DOUBLE / length) AS cover,
                 count(*) FILTER (votes = length - {K - 1}) AS exact, min(diagonal) FILTER (votes = length - {K - 1}) AS lo, max(diagonal) FILTER (votes = length - {K - 1}) AS hi
          FROM m GROUP BY r, template, label, is_base, length, run),
    f AS (SELECT r, sum(CASE WHEN is_base THEN exact ELSE 0 END) AS n_base, min(lo) FILTER (is_base) AS first_word, max(hi) FILTER (is_base) AS last_word,
                 array_to_string(list_sort(list_distinct(list(label) FILTER (is_base AND exact > 0))), ',') AS base_labels,
                 array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score FROM s WHERE cover >= CASE WHEN length < {SHORT} THEN 1.0 ELSE {COVER} END GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN f USING (r)"""
