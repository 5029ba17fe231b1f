"""The corpus pipeline: each stage reads the documents that the stage before kept.

quality: documents that the classifier rejects go (threshold 0.3, as in its query).
near_dedup: of each group of near-duplicates (5-word shingles, similarity 0.8 or more) the
    document with the least id stays. Rows that repeat an id go as well.
substring_dedup: passages of MIN_WORDS words or more that also stand earlier are cut out;
    the document stays with what is left, which may be an empty text.
decontamination: documents with a passage that aligns with SHARE or more of a benchmark
    item go.
packing: the documents left are packed into sequences of 2048 tokens.

Columns of documents may be null; documents with a null id pass the first four stages
unless rejected for quality or for a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewright.llm import decontamination, minhash, nbsvm, packing, substrings
from grovewright.llm.common import relieve, small_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_WORDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = nbsvm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nbsvm.score(docs, model).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    return minhash.deduplicate(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    cut = substrings.remove(docs.select(*COLUMNS), MIN_WORDS)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    return decontamination.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    return packing.pack_digests(docs, packing.tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
