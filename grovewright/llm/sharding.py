"""Sharding by vector bin packing over (bytes, tokens, rows).

Documents with equal text form a group. A group above 1/(shards*grain) of any total is
"heavy": there are fewer than 3*shards*grain of those, whatever the input, so they are
planned one by one, cut into chunks so that a hot group never lands in one shard. All
other groups fall by hash into shards*grain pools. Chunks and pools (both bounded in
number) are placed, largest first, where the dot product of their vector with the
residual capacity is highest; a last step swaps units until bytes are near equal.
Only narrow rows are shuffled; the texts stay where they were read.

Null and empty texts have size 8 and are one group. Repeated rows are kept, each with a
slot of its own. A null id is a value like any other. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector: largest first, to the highest dot product with what capacity is left."""
    total = vectors.sum(axis=0)
    v = vectors / np.where(total > 0, total, 1.0)
    left = np.full((shards, v.shape[1]), 1.0 / shards)
    out = np.zeros(len(v), np.int64)
    for i in np.lexsort((np.arange(len(v)), -v.max(axis=1))):
        s = int(np.argmax(left @ v[i]))
        out[i] = s
        left[s] -= v[i]
    return out


def even_out(size: np.ndarray, shard: np.ndarray, shards: int, tolerance: float = 2e-4, rounds: int = 4000) -> np.ndarray:
    """Swap or move units between the fullest and the emptiest shard while that narrows their gap."""
    load = np.bincount(shard, weights=size, minlength=shards)
    mean = load.mean() if len(size) else 0.0
    for _ in range(rounds):
        a, b = int(load.argmax()), int(load.argmin())
        gap = load[a] - load[b]
        if gap <= tolerance * mean:
            break
        mine, other = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        other = other[np.argsort(size[other], kind="stable")]
        small = np.concatenate([[0.0], size[other]])  # the first stands for a plain move
        at = np.clip(np.searchsorted(small, size[mine] - gap / 2), 0, len(small) - 1)
        best = None
        for j in (at, np.maximum(at - 1, 0)):
            miss = np.abs(size[mine] - small[j] - gap / 2)
            k = int(miss.argmin())
            if best is None or miss[k] < best[0]:
                best = (miss[k], mine[k], int(j[k]))
        miss, unit, j = best
        if miss >= gap / 2:
            break
        shard[unit] = b
        if j:
            shard[other[j - 1]] = a
        moved = size[unit] - small[j]
        load[a] -= moved
        load[b] += moved
    return shard


def shard_documents(docs: DataFrame, shards: int = 24, grain: int = 256, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = durable(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        )
    )
    groups = rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    pools = shards * grain
    limit = {c: max(1, (total[c] or 0) // pools) for c in ("bytes", "tokens", "n")}
    over = F.greatest(*[F.col(c) / v for c, v in limit.items()])
    heavy, base = [], pools
    for r in groups.withColumn("over", over).where("over > 1").orderBy("key", "size").collect():  # fewer than 3 * pools rows
        chunks = int(min(r["n"], max(1, -(-r["over"] // 1))))
        heavy.append((r["key"], r["size"], base, chunks))
        base += chunks
    known = spark.createDataFrame(heavy, "key long, size long, base long, chunks long")
    units = rows.join(F.broadcast(known), ["key", "size"], "left").withColumn(
        "unit",
        F.when(F.col("base").isNull(), F.pmod(F.xxhash64("key", "size"), F.lit(pools))).otherwise(F.col("base") + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.coalesce("chunks", F.lit(1)))),
    )
    load = units.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("unit").collect()  # bounded: pools and chunks
    v = np.array([[r["bytes"], r["tokens"], r["n"]] for r in load], float).reshape(-1, 3)
    shard = even_out(v[:, 0].copy(), place(v, shards), shards)
    start, plan = [0] * shards, []
    for r, s in zip(load, shard.tolist()):
        plan.append((r["unit"], s, start[s]))
        start[s] += r["n"]
    planned = spark.createDataFrame(plan, "unit long, shard int, start long")
    order = Window.partitionBy("unit").orderBy("doc_id", "text_crc32")
    return units.join(F.broadcast(planned), "unit").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(order) - 1).alias("slot"))
