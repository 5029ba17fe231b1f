"""Status, entity cards, unresolved accounts, selectors and full-text search."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.vocab import CONTAINER_KINDS, CONTENT_KINDS, SYMBOL_KINDS
from ..plans.helpers import among, checkpointed, first_by

K1, B = 1.2, 0.75


def status(entity: DataFrame, assertion: DataFrame, observation: DataFrame) -> DataFrame:
    """(metric, name, n): totals and counts by kind and by relation, one pass a table."""
    parts = [
        entity.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("metric"), F.col("kind").alias("name"), "n"),
        assertion.groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("relation"), "relation", "n"),
        observation.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit("observations"), "n"),
        entity.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit("entities"), "n"),
        assertion.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit("assertions"), "n"),
    ]
    return reduce(DataFrame.union, parts)


def last_state(runs: DataFrame) -> DataFrame:
    """The runs (run_id, state_id, started_at, finished_at, ...) of the state that the last run recorded."""
    last = runs.agg(F.max_by("state_id", "run_id").alias("state_id"))
    return runs.join(F.broadcast(last), "state_id").orderBy("run_id")  # one row is broadcast


def relation_counts(assertion: DataFrame) -> DataFrame:
    """(entity_id, side, relation, n) for all entities."""
    sides = assertion.select(F.explode(F.array(F.struct(F.col("source_id").alias("entity_id"), F.lit("outgoing").alias("side")), F.struct(F.col("target_id").alias("entity_id"), F.lit("incoming").alias("side")))).alias("s"), "relation")
    return sides.groupBy("s.entity_id", "s.side", "relation").agg(F.count("*").alias("n"))


def first_occurrence(occurrence: DataFrame) -> DataFrame:
    return first_by(occurrence, ["entity_id"], [F.asc("file_path"), F.asc("start_byte"), F.asc("end_byte"), F.asc("occurrence_id")])


def entity_list(entity: DataFrame, occurrence: DataFrame, kind: str | None = None) -> DataFrame:
    """Entities with the place of their first occurrence, in total order."""
    at = first_occurrence(occurrence).select("entity_id", "file_path", "start_line")
    rows = entity if kind is None else entity.where(F.col("kind") == kind)
    out = rows.join(at, "entity_id", "left").withColumn("location", S.location(F.col("file_path"), F.col("start_line")))
    return out.orderBy("kind", "scope_path", "name", "entity_id")


def unresolved(entity: DataFrame, assertion: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Unresolved entities by how many claims point at them."""
    open_ = checkpointed(entity.where(F.col("kind") == "unresolved").select("entity_id", "scope_path", "name"))
    n = among(assertion.select(F.col("target_id").alias("entity_id")), open_, "entity_id").groupBy("entity_id").agg(F.count("*").alias("referencing"))
    out = open_.join(n, "entity_id", "left").select("entity_id", "scope_path", "name", F.coalesce("referencing", F.lit(0)).alias("referencing"))
    out = out.orderBy(F.desc("referencing"), "scope_path", "name", "entity_id")
    return out if limit is None else out.offset(offset).limit(limit)


def unresolved_account(state: DataFrame, assertion: DataFrame, relations: list[str]) -> DataFrame:
    """One row: sites, assertions and distinct targets that stayed unresolved over some relations."""
    claims = assertion if not relations else assertion.where(F.col("relation").isin(relations))
    rows = state.where("is_unresolved").join(claims, "assertion_id")
    return rows.agg(F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("sites"), F.count("*").alias("assertions"), F.count_distinct("target_id").alias("targets"))


def unresolved_sites(state: DataFrame, assertion: DataFrame, entity: DataFrame, relations: list[str]) -> DataFrame:
    """(category, sites): sites of the unresolved account by what the target was taken for; entity has meta (JSON)."""
    claims = assertion if not relations else assertion.where(F.col("relation").isin(relations))
    rows = state.where("is_unresolved").join(claims, "assertion_id").join(entity.select(F.col("entity_id").alias("target_id"), S.category(F.col("meta")).alias("category")), "target_id")
    return rows.groupBy("category").agg(F.sum("evidence_count").alias("sites"))


def by_ids(entity: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities of a set of ids (entity_id), in one join however many there are."""
    return entity.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def resolve_selector(entity: DataFrame, selector: str) -> DataFrame:
    """Matches of a selector at the first stage that has any, with the outcome.

    Stages: id, path, path#name, name or qualified name. More than one match is
    `ambiguous`; at the path stage, content wins over containers. A refused or unmatched
    selector gives one row without an entity.
    """
    shape = S.selector_shape(selector)
    spark = entity.sparkSession
    if shape["refused"]:
        return spark.createDataFrame([("refused", None, None, None, None)], "outcome string, stage string, entity_id string, kind string, name string")
    e = entity.withColumns({"path": S.repository_path(F.col("kind"), F.col("scope_path"), F.col("name")), "qualified": S.qualified_name(F.col("kind"), F.col("scope_path"), F.col("name"))})
    if shape["qualifier"] == "symbol":
        e = e.where(F.col("kind").isin(SYMBOL_KINDS))
    elif shape["qualifier"] and shape["qualifier"] not in ("kind", "adr"):
        e = e.where(F.col("kind") == shape["qualifier"])
    t = shape["text"]
    stage = F.when(F.col("entity_id") == t, 0).when(F.col("path") == t, 1)
    if shape["path"] is not None:
        stage = stage.when(F.col("kind").isin(SYMBOL_KINDS) & (F.col("scope_path") == shape["path"]) & (F.col("name") == shape["name"]), 2)
    stage = stage.when((F.col("name") == t) | (F.col("qualified") == t), 3)
    hit = e.withColumn("at", stage).where("at IS NOT NULL")
    # all rows of one question: few, and bounded by what carries the name
    best = hit.join(F.broadcast(hit.agg(F.min("at").alias("at"))), "at")
    container = F.when((F.col("at") == 1) & F.col("kind").isin(CONTAINER_KINDS), 1).otherwise(0)
    best = best.withColumn("role", F.when((F.col("at") == 1) & F.col("kind").isin(CONTENT_KINDS), 0).otherwise(container))
    best = best.join(F.broadcast(best.agg(F.min("role").alias("role"))), "role")
    best = best.withColumn("n", F.count("*").over(Window.partitionBy("at")))
    names = F.array(*[F.lit(x) for x in ("id", "path", "path_qualified", "name")])
    found = best.select(F.when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("outcome"), F.get(names, F.col("at")).alias("stage"), "entity_id", "kind", "name")
    none = spark.createDataFrame([("not_found",)], "outcome string").join(found.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti")
    return found.unionByName(none, allowMissingColumns=True)


def phrases(query: str) -> list[tuple[str, ...]]:
    """Phrases of a query: runs of letters, digits and underscores; an underscore parts words that must follow one another."""
    runs = "".join(c if c.isalnum() or c == "_" else " " for c in query.lower()).split()
    return sorted({tuple(w for w in run.split("_") if w) for run in runs} - {()})


def occurrences(words: Column, phrase: tuple[str, ...]) -> Column:
    """How often the words of a phrase follow one another in words; of the last one, a prefix is enough."""
    k = len(phrase)
    at = lambda i: reduce(lambda x, y: x & y, [F.get(words, i + j) == w for j, w in enumerate(phrase[:-1])], F.startswith(F.get(words, i + k - 1), F.lit(phrase[-1])))
    return F.when(F.size(words) >= k, F.size(F.filter(F.sequence(F.lit(0), F.size(words) - k), at))).otherwise(0)


def search(entity: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities in which every phrase of the query occurs, in the name or in the scope path; BM25 over phrases, best (least) first.

    Phrases are matched within each row: one scan for the frequencies, one for the hits,
    and nothing is shuffled but the best rows of each task.
    """
    wanted = phrases(query)
    if not wanted:
        return entity.limit(0).select("entity_id", "kind", "name").withColumn("score", F.lit(0.0))
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = entity.select("entity_id", "kind", "name", split("name").alias("ns"), split("scope_path").alias("ps")).where("size(ns) + size(ps) > 0")
    rows = rows.select("entity_id", "kind", "name", (F.size("ns") + F.size("ps")).alias("size"), *[(occurrences(F.col("ns"), p) + occurrences(F.col("ps"), p)).alias(f"tf{i}") for i, p in enumerate(wanted)])
    total = rows.agg(F.count("*").alias("docs"), F.avg("size").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = math.log((total["docs"] - total[f"df{i}"] + 0.5) / (total[f"df{i}"] + 0.5) + 1)
        tf = F.col(f"tf{i}")
        score = score + F.lit(idf) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.lit(total["avg"] or 1.0))))
    hits = rows.where(reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in range(len(wanted))]))
    hits = hits if kind is None else hits.where(F.col("kind") == kind)
    return hits.select("entity_id", "kind", "name", F.round(-score, 6).alias("score")).orderBy("score", "entity_id").limit(limit)


def suggestions(entity: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Names that begin with the longest prefix (3 letters at least) of `name` that any has."""
    prefixes = [name[:k] for k in range(len(name), 2, -1)]
    if not prefixes:
        return entity.limit(0).select("name", F.lit(0).alias("prefix_length"))
    longest = F.coalesce(*[F.when(F.startswith(S.ascii_lower(F.col("name")), F.lit(p.lower())), F.lit(len(p))) for p in prefixes])
    hits = entity.select("name", longest.alias("prefix_length")).where("prefix_length IS NOT NULL").distinct()
    return hits.join(F.broadcast(hits.agg(F.max("prefix_length").alias("prefix_length"))), "prefix_length").select("name", "prefix_length").orderBy("name").limit(limit)


def path_is_indexed(occurrence: DataFrame, path: str) -> DataFrame:
    return occurrence.where(F.col("file_path") == path).agg((F.count("*") > 0).alias("indexed"))


def indexed_hash(occurrence: DataFrame) -> DataFrame:
    """(file_path, content_hash): null unless the path has exactly one hash."""
    return occurrence.groupBy("file_path").agg(F.when(F.count_distinct("content_hash") == 1, F.min("content_hash")).alias("content_hash"))


def freshness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path, freshness): the worst state over a path's recorded hashes; current has file_path, content_hash, problem."""
    joined = recorded.select("file_path", "content_hash").distinct().join(current.select("file_path", F.col("content_hash").alias("now"), F.coalesce("problem", F.lit("")).alias("problem")), "file_path", "left")
    state = F.when(F.col("problem") == "unreadable", 4).when(F.col("problem") == "refused", 3).when(F.col("now").isNull(), 2).when(F.col("now") != F.col("content_hash"), 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("fresh", "stale", "file-missing", "refused", "unreadable")])
    return joined.groupBy("file_path").agg(F.max(state).alias("state")).select("file_path", F.get(names, F.col("state")).alias("freshness"))


def freshness_tallies(facts: DataFrame, current: DataFrame, cap: int) -> DataFrame:
    """One row over the first `cap` files in order of path: how many there are, were probed, and are in each state; whether the cap cut.

    facts (file_path, content_hash), one row a file. The cap is the feature: a probe reads a file.
    """
    total = facts.agg(F.count("*").alias("files_total"))
    probed = facts.orderBy("file_path").limit(cap)
    names = ("fresh", "stale", "file-missing", "refused", "unreadable")
    tally = freshness(probed, current).agg(F.count("*").alias("files_probed"), *[F.count_if(F.col("freshness") == x).alias(x.removeprefix("file-")) for x in names])
    return total.join(tally, F.lit(True)).withColumn("truncated", F.col("files_total") > F.col("files_probed"))  # one row each


def partial_parses(facts: DataFrame) -> DataFrame:
    """Files whose cached facts (JSON) say that they didn't parse in whole, with what was not modelled; facts that can't be read don't count."""
    j = lambda p: F.get_json_object("facts", f"$.counters.{p}")
    rows = facts.where(F.coalesce(j("has_syntax_error") == "true", F.lit(False)))
    return rows.select(
        "file_path", "language", "content_hash", F.coalesce(j("dynamic_imports_without_specifier").try_cast("long"), F.lit(0)).alias("dynamic_imports_without_specifier"),
        F.coalesce(j("unmodelled_call_sites").try_cast("long"), F.lit(0)).alias("unmodelled_call_sites"), F.from_json(j("unmodelled_by_form"), "map<string,bigint>").alias("unmodelled_by_form"),
    ).orderBy("file_path")


def trust(tallies: DataFrame) -> DataFrame:
    """The verdict over one row of tallies; the order of conditions is the meaning."""
    from ..plans.helpers import cascade

    c = F.col
    return tallies.withColumn("trust", cascade([
        (~c("schema_ok"), "unusable"), (c("runs") == 0, "no_index"), (c("running") > 0, "unverified"), (c("changed") + c("missing") + c("added") > 0, "stale"),
        (c("truncated"), "unverified"), (c("refused") + c("unreadable") > 0, "unverified"),
    ], "current"))
