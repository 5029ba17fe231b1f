"""Helpers shared by the operators: words, hashes, Bloom filters, durable stages."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pickle
import shutil
import sys
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULT = np.uint64(0x9E3779B97F4A7C15)
CACHE = 120_000


class WordHash(dict):
    """word (bytes) -> 64-bit hash as a signed integer; emptied when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(word) - (1 << 63)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word hashes; empty if there are fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= MULT
        acc += h[j : j + n]
    return mix(acc)


def give_back() -> None:
    """Return free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has such a call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run, words: bool = False):
    """run for mapInArrow, after which the worker gives back what it held: workers are reused, and their memory adds up.

    The packer's word cache outlives its tasks, but not the next task of another kind.
    """

    def whole(batches):
        if not words:
            sys.__dict__.pop("_grovewright_words", None)
        yield from run(batches)
        give_back()

    return whole


def tidied_groups(f, every: int = 32):
    """f for applyInArrow; memory is given back now and then."""
    done = [0]

    def one(t):
        out = f(t)
        done[0] += 1
        if done[0] % every == 0:
            give_back()
        return out

    return one


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo parts (a null id is in fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def part_of(column: str, rows: int, total: int):
    """Picks about `rows` of `total` rows by hash of a column, each row by itself: no sort and nothing gathered."""
    return F.pmod(F.xxhash64(column, F.lit(17)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, rows / max(1, total)))


def crc(data: bytes) -> int:
    return zlib.crc32(data)


class Shared:
    """A broadcast value whose classes travel with it; unpacked once a task."""

    def __init__(self, spark: SparkSession, value):
        self.packed, self.got = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"packed": self.packed, "got": None}

    @property
    def value(self):
        if self.got is None:
            self.got = pickle.loads(self.packed.value)
        return self.got


def shared(spark: SparkSession) -> None:
    """Make sure checkpoint() has its folder: the one of the session, or a temporary one if all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="grovewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 8) -> None:
    """Texts are long: where the session leaves the bounds of Arrow batches at their defaults, hold fewer rows and bytes at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m"):
        spark.conf.set(key, str(megabytes << 20))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Bloom:
    """A Bloom filter of fixed size over well-mixed 64-bit hashes: false positives only.

    Its size doesn't follow the data: past its capacity it lets more rows through, which
    costs work and never results, for an exact step always follows.
    """

    BLOCK = 16  # bits of an address within a block

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def build(hashes: DataFrame, column: str, bits: int = 26) -> Bloom:
        """Blocks of 2**16 bits are made on executors; the driver gets 2**bits bits at most."""
        at = [F.shiftrightunsigned(column, 64 - bits), F.shiftrightunsigned(column, 4).bitwiseAND((1 << bits) - 1)]
        low = (1 << Bloom.BLOCK) - 1

        def fill(batches):
            for batch in batches:
                out = []
                for slots in batch.column(1).to_pylist():
                    flags = np.zeros(low + 1, np.uint8)
                    flags[np.asarray(slots, np.int64)] = 1
                    out.append(np.packbits(flags).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "data"])

        rows = (
            hashes.select(F.explode(F.array(*at)).alias("at"))
            .groupBy(F.shiftrightunsigned("at", Bloom.BLOCK).alias("block"))
            .agg(F.collect_set(F.col("at").bitwiseAND(low).cast("int")).alias("slots"))  # 2**16 at most
            .mapInArrow(tidied(fill), "block long, data binary")
            .collect()
        )
        data, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (Bloom.BLOCK - 3)
        for r in rows:
            data[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["data"]), np.uint8)
        return Bloom(bits, data)

    def has(self, h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        out = np.ones(len(h), bool)
        for a in (h >> np.uint64(64 - self.bits), (h >> np.uint64(4)) & np.uint64((1 << self.bits) - 1)):
            out &= ((self.data[a >> np.uint64(3)] >> (7 - (a & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
        return out

    def keep(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """The rows of df whose value may be in the filter (or, not inside, surely isn't); nothing is shuffled.

        The filter must have been built over xxhash64 of the values.
        """
        held, names, bits = df.sparkSession.sparkContext.broadcast(self.data), df.columns, self.bits
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

        def run(batches):
            bloom = Bloom(bits, held.value)
            for batch in batches:
                has = bloom.has(batch.column(len(names)).to_numpy(zero_copy_only=False))
                kept = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(has if inside else ~has))
                if kept.num_rows:
                    yield kept

        return df.withColumn(free(df, "hash"), F.xxhash64(column)).mapInArrow(tidied(run), fields)


def reclaim(spark: SparkSession) -> None:
    """Let the driver collect garbage now, so that Spark deletes the shuffle files of steps that are done."""
    gc.collect()
    spark._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let the executors collect all garbage now: their heaps shrink to what is alive, so what earlier steps filled isn't held beside this step's Python workers.

    A task a core, each on its own row; those that land on an executor twice only collect twice.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def stored(df: DataFrame) -> DataFrame:
    """Like durable(), as compressed columns: for tables of many rows."""
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
