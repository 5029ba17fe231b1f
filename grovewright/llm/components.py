"""Connected components by union-find in rounds of contraction.

Every node hooks to its least neighbour in a random order of nodes; each round composes
the hooks twice, contracts the links and drops loops and repeats, so the number of links
falls geometrically even along a path. No task gathers a component and nothing goes to
the driver but the number of links left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of links; the component is its least node."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = durable(links.where(F.col(a) != F.col(b)).select(rank(a).alias("u"), rank(b).alias("v")).distinct())
    layers = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to"))
        for _ in range(2):
            nxt = hook.select(F.col("u").alias("to"), F.col("to").alias("next"))
            hook = hook.join(nxt, "to").select("u", F.col("next").alias("to"))
        hook = durable(hook)
        layers.append(hook)
        left, right = hook.select("u", F.col("to").alias("x")), hook.select(F.col("u").alias("v"), F.col("to").alias("y"))
        edges = durable(edges.join(left, "u").join(right, "v").where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    if not layers:
        return links.select(F.col(a).alias("node"), F.col(b).alias("component")).limit(0)
    root = layers[-1]
    for below in reversed(layers[:-1]):  # every hook ends in a node of the next layer or in a root
        up = root.select(F.col("u").alias("to"), F.col("to").alias("top"))
        root = below.join(up, "to", "left").select("u", F.coalesce("top", "to").alias("to"))
    root = root.select(F.col("u.id").alias("node"), F.col("to").alias("root"))
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return durable(root.join(least, "root").select("node", "component"))
