"""first_by, cascade, having, lacking, met and closure: the shapes that most questions lean on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys up to these numbers are broadcast, or listed in a filter. Bounds that don't follow the data.
FEW, LISTED = 100_000, 1_000
# Bytes of input files for one shuffle partition; the setting for their number, and our mark that we set it.
TASK_BYTES, INITIAL, MARK = 4 << 20, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "grovewright.initialPartitionNum"


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in a total order (which must end in a unique column)."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")


def only_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Like first_by, but a tie for the first place gives no row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = df.withColumn("__rank", F.rank().over(w)).where("__rank = 1")
    return at.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__rank", "__n")


def cascade(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds; the order is meaning."""
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise) if otherwise is not None else out


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder; in tests on one machine, in a temporary one."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="grovewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def sized(spark: SparkSession, folder: str) -> None:
    """Deal shuffles by the size of the input, so that what one task holds doesn't grow with it.

    One shuffle partition for TASK_BYTES of the folder's files, if that is more than the
    session has (adaptive execution merges small ones again), and smaller targets for
    partitions of shuffles and scans where the session left the defaults.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    n = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength() // TASK_BYTES
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, str(n))
    elif spark.conf.get(INITIAL, None) is not None and spark.conf.get(MARK, "") == spark.conf.get(INITIAL, None):
        spark.conf.unset(INITIAL)
    spark.conf.set(MARK, str(n))
    for key, default, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB", "16MB"), ("spark.sql.files.maxPartitionBytes", "128MB", "32MB")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, most)


def having(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is among keys.

    An inner join with distinct keys: a semi-join would be pushed below the unions that df
    is made of, and the keys would be computed, sorted and merged once a branch.
    """
    return df.join(keys.select(*on).distinct(), on).select(*df.columns)


def lacking(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is not among keys; as having(), no anti-join, for the same reason."""
    marks = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    return df.join(marks, on, "left").where("__hit IS NULL").select(*df.columns)


def few(keys: DataFrame) -> bool:
    """Whether keys, which should be checkpointed, have no more than FEW rows."""
    return keys.limit(FEW + 1).count() <= FEW


def among(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """having() with checkpointed keys.

    Up to LISTED keys become a filter, which is pushed below unions and distinct rows down
    to the scans, so that only rows with such a key are shuffled at all; few are broadcast.
    """
    listed = keys.select(on).limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        return df.where(F.col(on).isin(list({r[0] for r in listed} - {None})))
    return df.join(F.broadcast(keys.select(on).distinct()), on, "left_semi").select(*df.columns) if few(keys) else having(df, keys, [on])


def met(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """df.join(keys, on) with checkpointed keys, by among() where they are few."""
    return among(df, keys, on).join(F.broadcast(keys), on) if few(keys) else df.join(keys, on)


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """lacking() with checkpointed keys, by a broadcast where they are few."""
    return lacking(df, F.broadcast(keys.select(on).distinct()) if few(keys) else keys, [on])


def closure(edges: DataFrame, start: DataFrame, depth: int | None = None) -> tuple[DataFrame, bool]:
    """Nodes reached from start (node) along edges (src, dst), with the least number of steps, start at 0.

    One join a level against the edges and one anti-join against what was reached; each
    level is checkpointed, so lineage stays short. Returns (node, depth) and whether the
    search ended by itself rather than at `depth`.
    """
    reached = checkpointed(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, level = reached, 0
    while depth is None or level < depth:
        level += 1
        step = met(edges.select("src", "dst"), frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(lacking(step, reached, ["node"]).withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            return reached, True
        reached = checkpointed(reached.union(frontier))
    return reached, False
