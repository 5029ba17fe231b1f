"""Incremental indexing: what changed, what that invalidates, moves, exports and import resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.helpers import checkpointed, closure

# What a relative import may stand for, in order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def classify(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified or unchanged, by (path, content_hash)."""
    both = previous.toDF("path", "old").join(current.toDF("path", "new"), "path", "full_outer")
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged").alias("change"))


def invalidated(changes: DataFrame, imports: DataFrame) -> DataFrame:
    """Paths to extract anew: what changed, and everything that imports it directly or not; imports (src, dst)."""
    seed = changes.where("change != 'unchanged'").select(F.col("path").alias("node"))
    return closure(imports.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), seed)[0].select(F.col("node").alias("path")).distinct()


def untracked(discovered: DataFrame, indexed: DataFrame, most_bytes: int) -> DataFrame:
    """(path, indexable) of discovered files (path, length, is_text) that have no facts: what an index run would add, and what it can't."""
    new = discovered.join(indexed.select("path").distinct(), "path", "left_anti")
    return new.select("path", ((F.col("length") <= most_bytes) & F.col("is_text")).alias("indexable"))


def move_candidates(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(from_path, to_path, matched, larger): pairs of which at least half of the larger side's symbols match.

    Sides have rows (path, symbol), one a symbol; a symbol that stands several times in a
    file matches as often as it stands on both sides.
    """
    sides = []
    for df, path, n in ((removed, "from_path", "n1"), (added, "to_path", "n2")):
        counts = df.toDF(path, "symbol").groupBy(path, "symbol").agg(F.count("*").alias(n))
        sides.append((counts, counts.groupBy(path).agg(F.sum(n).alias(n))))
    (left, n1), (right, n2) = sides
    shared = left.join(right, "symbol").groupBy("from_path", "to_path").agg(F.sum(F.least("n1", "n2")).alias("matched"))
    return shared.join(n1, "from_path").join(n2, "to_path").withColumn("larger", F.greatest("n1", "n2")).where("2 * matched >= larger").select("from_path", "to_path", "matched", "larger")


def move_proposals(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(from_path, to_path, matched, larger): moves, as if the removed paths chose one after the other in their order.

    Each takes, of the added paths not yet taken, the one with most matched symbols, then
    the smaller larger side; if two are equal in both, it takes none. A path is decided in
    the first round in which no undecided path before it can change its choice: its best
    candidate is its own and wanted by none before it; or all its candidates are; or more
    are tied for best than those before it could take. At least one path of each connected
    group is decided a round.
    """
    left = checkpointed(move_candidates(removed, added))
    none = left.limit(0)
    taken = none
    while not left.isEmpty():
        # candidates that the same paths want on the same terms are alike: those before a path at one of them are those at all
        alike = left.groupBy("to_path").agg(F.sum(F.xxhash64("from_path", "matched", "larger").cast("decimal(38,0)")).alias("alike"))
        before = F.row_number().over(Window.partitionBy("to_path").orderBy("from_path")) - 1
        rows = left.join(alike, "to_path").withColumn("before", before)
        score = F.struct(F.col("matched").alias("m"), (-F.col("larger")).alias("l"))
        best = rows.groupBy("from_path").agg(F.max(score).alias("best"), F.max("before").alias("most_before"))
        top = rows.join(best, "from_path").where(score == F.col("best"))
        kinds = top.groupBy("from_path", "alike").agg(F.count("*").alias("n"), F.max("before").alias("before"), F.min("to_path").alias("to_path"), F.first("most_before").alias("most_before"), F.first("matched").alias("matched"), F.first("larger").alias("larger"))
        one = kinds.groupBy("from_path").agg(F.sum("n").alias("n"), F.sum("before").alias("before"), F.min("to_path").alias("to_path"), F.first("most_before").alias("most_before"), F.first("matched").alias("matched"), F.first("larger").alias("larger"))
        sole, free = F.col("n") == 1, F.col("most_before") == 0
        decided = checkpointed(one.where((sole & (F.col("before") == 0)) | free | (F.col("n") >= F.col("before") + 2)).select("from_path", "to_path", "matched", "larger", sole.alias("takes")))
        new = decided.where("takes").drop("takes")
        taken = taken.union(new)
        left = checkpointed(left.join(decided.select("from_path"), "from_path", "left_anti").join(new.select("to_path"), "to_path", "left_anti").select(*none.columns))
    return taken


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (importer, specifier) with the first candidate path that is indexed; else null and a reason.

    Neither side has a bound, so both joins are by merge: nothing is gathered on the driver for a broadcast.
    """
    base = F.regexp_replace("importer", "/?[^/]*$", "")
    joined = F.when(base == "", F.col("specifier")).otherwise(F.concat_ws("/", base, F.col("specifier")))
    rows = imports.distinct().withColumn("relative", F.col("specifier").rlike(r"^\.{1,2}(/|$)")).withColumn("folded", F.when(F.col("relative"), S.normal_path(joined)))
    tried = rows.where("folded IS NOT NULL").select("importer", "specifier", F.posexplode(F.array(*[F.concat("folded", F.lit(s)) for s in SUFFIXES])).alias("at", "path"))
    found = tried.join(paths.select("path").distinct().hint("merge"), "path").groupBy("importer", "specifier").agg(F.min_by("path", "at").alias("target"))
    out = rows.join(found.hint("merge"), ["importer", "specifier"], "left")
    reason = F.when(F.col("target").isNotNull(), F.lit(None)).when(~F.col("relative"), "not_relative").when(F.col("folded").isNull(), "climbs_above_root").otherwise("not_indexed")
    return out.select("importer", "specifier", "target", reason.alias("reason"))


def export_closure(local: DataFrame, named: DataFrame, star: DataFrame) -> DataFrame:
    """(module, name, origin_module, origin_name): what a module provides.

    local (module, name); named (module, name, target, target_name); star (module, position,
    target). A local name beats a named re-export, which beats a star in source order; a
    star never forwards `default`. Chains are of any length. A chain never comes back to
    a name of a module that it passed, so cycles end; where several modules of one cycle
    have origins of their own, the one found first along the cycle may hide another.
    """
    at = F.concat_ws("\0", "module", "name")
    rows = checkpointed(local.select("module", "name", F.col("module").alias("origin_module"), F.col("name").alias("origin_name"), F.array(F.lit(0)).alias("rank"), F.array(at).alias("trail")))
    while True:
        up = rows.select(F.col("module").alias("target"), F.col("name").alias("target_name"), "origin_module", "origin_name", "rank", "trail")
        by_name = named.join(up, ["target", "target_name"]).select("module", "name", "origin_module", "origin_name", F.concat(F.array(F.lit(1)), "rank").alias("rank"), "trail")
        by_star = star.join(up, "target").where("target_name != 'default'").select("module", F.col("target_name").alias("name"), "origin_module", "origin_name", F.concat(F.array(F.lit(2), F.col("position")), "rank").alias("rank"), "trail")
        longer = by_name.union(by_star).where(~F.array_contains("trail", at)).withColumn("trail", F.concat(F.array(at), "trail"))
        every = rows.union(longer)
        best = every.groupBy("module", "name").agg(F.min_by(F.struct("origin_module", "origin_name", "rank", "trail"), "rank").alias("b")).select("module", "name", "b.*")
        nxt = checkpointed(best)
        if nxt.exceptAll(rows).isEmpty():
            return nxt.drop("rank", "trail")
        rows = nxt


def filesystem_graph(paths: DataFrame, root: str = "repository") -> DataFrame:
    """(parent, child, kind): every directory and file below its parent."""
    parts = F.split("path", "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("child"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), (n == F.size(parts)).alias("leaf")))).alias("x")).select("x.*")
    return each.select(F.when(F.col("parent") == "", root).otherwise(F.col("parent")).alias("parent"), "child", F.when(F.col("leaf"), "file").otherwise("directory").alias("kind")).distinct()
