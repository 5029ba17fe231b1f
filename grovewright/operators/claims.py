"""Claims and evidence: state derivation, upserts, withdrawal and pruning as functions from snapshot to snapshot.

A snapshot is a dict of DataFrames. Nothing is edited in place: an upsert is a null-safe
full outer join, a deletion an anti-join, and the derived state an aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import member
from ..plans.helpers import among, checkpointed, few, first_by, having, lacking, without

#: One observation is one row by this key.
EVIDENCE_KEY = ["assertion_id", "extractor_id", "extractor_version", "source_type", "file_path", "start_line", "end_line"]


#: Columns of assertion_state.
STATE = ["assertion_id", "status", "is_unresolved", "strongest_source_type", "source_type_mask", "evidence_count"]


def derive_state(observation: DataFrame, assertion: DataFrame, entity: DataFrame) -> DataFrame:
    """assertion_state: status by the kind of the target, strongest source type, mask of types, count of evidence."""
    return stated_claims(observation, assertion, entity).select(*STATE)


def stated_claims(observation: DataFrame, assertion: DataFrame, entity: DataFrame) -> DataFrame:
    """Claims that have a state, with it: the columns of assertion_state after those of assertion.

    Evidence is summed by assertion before anything is joined, so both joins read one row an assertion.
    """
    seen = observation.groupBy("assertion_id").agg(
        F.min("source_type").alias("strongest"), F.bit_or(F.expr("shiftleft(1L, cast(source_type as int))")).alias("source_type_mask"), F.count("*").alias("evidence_count")
    )
    target = entity.select(F.col("entity_id").alias("target_id"), F.col("kind").alias("target_kind"))
    joined = seen.join(assertion, "assertion_id").join(target, "target_id")
    unresolved = F.col("target_kind") == "unresolved"
    return joined.select(
        *assertion.columns, F.when(unresolved, "UNRESOLVED").otherwise("SUPPORTED").alias("status"), unresolved.alias("is_unresolved"),
        member("source_type", F.col("strongest")).alias("strongest_source_type"), "source_type_mask", "evidence_count",
    )


def derive_scoped(state: DataFrame, touched: DataFrame, observation: DataFrame, assertion: DataFrame, entity: DataFrame) -> DataFrame:
    """The state after a change: touched assertions anew, all others as they were. Equals derive_state()."""
    scope = checkpointed(touched.select("assertion_id").distinct())
    return without(state, scope, "assertion_id").unionByName(state_of(observation, assertion, entity, scope))


def state_of(observation: DataFrame, assertion: DataFrame, entity: DataFrame, scope: DataFrame) -> DataFrame:
    """derive_state() of some claims (assertion_id, checkpointed): only what concerns them is joined."""
    claims = among(assertion, scope, "assertion_id")
    if few(scope):
        claims = checkpointed(claims)
        entity = among(entity.select("entity_id", "kind"), claims.select(F.col("target_id").alias("entity_id")), "entity_id")
    return derive_state(among(observation, scope, "assertion_id"), claims, entity)


def unresolved_claims(assertion: DataFrame, entity: DataFrame) -> DataFrame:
    """Claims whose target is unresolved, checkpointed: all that an account of what stayed unresolved asks for."""
    targets = checkpointed(entity.where(F.col("kind") == "unresolved").select(F.col("entity_id").alias("target_id")).distinct())
    return checkpointed(among(assertion, targets, "target_id"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(snapshot, one row of counts): new rows replace old ones only where a column differs, nulls being equal."""
    columns = [c for c in old.columns if c not in key]
    a, b = old.select(*key, F.struct(*columns).alias("__old")), new.dropDuplicates(key).select(*key, F.struct(*columns).alias("__new"))
    both = a.join(b, key, "full_outer")
    changed = F.col("__new").isNotNull() & ~reduce(lambda x, y: x & y, [F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}")) for c in columns], F.col("__old").isNotNull())
    kept = F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("__old"))
    counts = both.agg(F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if(changed & F.col("__old").isNotNull()).alias("updated"), F.count_if(~changed & F.col("__new").isNotNull()).alias("unchanged"))
    return both.withColumn("__row", kept).select(*key, "__row.*"), counts


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key is new."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def persist_batch(snapshot: dict[str, DataFrame], batch: dict[str, DataFrame], declared: list[str] | None = None) -> dict[str, DataFrame]:
    """Merge a batch: entities are upserted, all else is insert-ignore. Evidence of undeclared types is an error."""
    if declared is not None:
        wrong = batch["observation"].where(~member("source_type", F.col("source_type")).isin(declared)).limit(1).count()
        if wrong:
            raise ValueError("the batch holds evidence of a type that its extractor didn't declare")
    keys = {"occurrence": ["occurrence_id"], "assertion": ["assertion_id"], "observation": EVIDENCE_KEY}
    out = dict(snapshot)
    out["entity"] = upsert(snapshot["entity"], batch["entity"], ["entity_id"])[0]
    for name, key in keys.items():
        if name in batch:
            out[name] = insert_ignore(snapshot[name], batch[name], key)
    return out


def latest_wins(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, that of the greatest order; of equals the one of new."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_by(both, key, [F.desc(order), F.desc("__new")]).drop("__new")


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status): the status of a run's last event; a run that only began is `running`."""
    return events.groupBy("run_id").agg(F.max_by("status", "event_id").alias("status"))


def delete_paths(snapshot: dict[str, DataFrame], paths: DataFrame, extractors: list[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop evidence and occurrences at paths (file_path), of the given extractors only; the touched assertion ids."""
    observation = snapshot["observation"]
    doomed = observation.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    if extractors is not None:
        doomed = doomed.where(F.col("extractor_id").isin(extractors))
    out = dict(snapshot)
    out["observation"] = observation.join(doomed.select(*EVIDENCE_KEY).distinct().withColumns({}), EVIDENCE_KEY, "left_anti")
    if extractors is None:
        out["occurrence"] = snapshot["occurrence"].join(paths.select("file_path").distinct(), "file_path", "left_anti")
    return out, doomed.select("assertion_id").distinct()


def withdraw_claims(snapshot: dict[str, DataFrame], path: str, extractor: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """One extractor's claims whose source occurs at path; other extractors keep theirs."""
    here = checkpointed(snapshot["occurrence"].where(F.col("file_path") == path).select(F.col("entity_id").alias("source_id")).distinct())
    claims = checkpointed(among(snapshot["assertion"], here, "source_id").select("assertion_id"))
    observation, mine = snapshot["observation"], F.col("extractor_id").eqNullSafe(F.lit(extractor))
    marks = claims.distinct().withColumn("__hit", F.lit(True))
    kept = observation.join(F.broadcast(marks) if few(claims) else marks, "assertion_id", "left").where(F.col("__hit").isNull() | ~mine)
    return {**snapshot, "observation": kept.select(*observation.columns)}, among(observation.where(mine), claims, "assertion_id").select("assertion_id").distinct()


def delete_evidence(observation: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows at exact evidence keys."""
    return observation.join(keys.select(*keys.columns).distinct(), keys.columns, "left_anti")


def delete_directory_containment(snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Drop the evidence of CONTAINS claims on directories."""
    directories = snapshot["entity"].where(F.col("kind") == "directory").select(F.col("entity_id").alias("target_id"))
    claims = having(snapshot["assertion"].where(F.col("relation") == "CONTAINS"), directories, ["target_id"])
    return {**snapshot, "observation": lacking(snapshot["observation"], claims, ["assertion_id"])}


def prune_orphans(snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """First assertions without evidence go, then entities (but repositories) without occurrence and claim."""
    assertion = having(snapshot["assertion"], snapshot["observation"], ["assertion_id"])
    ends = assertion.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).union(snapshot["occurrence"].select("entity_id"))
    entity = snapshot["entity"]
    kept = entity.where(F.col("kind") == "repository").unionByName(having(entity.where(F.col("kind") != "repository"), ends, ["entity_id"]))
    return {**snapshot, "assertion": assertion, "entity": kept}


def prune_scoped(snapshot: dict[str, DataFrame], touched: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The same over touched assertions and entities, and the ends of assertions that go.

    What goes is read several times, so it is checkpointed: a part of what was touched.
    """
    doomed = checkpointed(lacking(having(snapshot["assertion"], touched, ["assertion_id"]), snapshot["observation"], ["assertion_id"]).select("assertion_id", "source_id", "target_id"))
    assertion = without(snapshot["assertion"], doomed, "assertion_id")
    near = doomed.select(F.col("source_id").alias("entity_id")).union(doomed.select("target_id")).union(entities.select("entity_id"))
    used = assertion.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).union(snapshot["occurrence"].select("entity_id"))
    gone = checkpointed(lacking(having(snapshot["entity"].where(F.col("kind") != "repository").select("entity_id"), near, ["entity_id"]), used, ["entity_id"]))
    return {**snapshot, "assertion": assertion, "entity": without(snapshot["entity"], gone, "entity_id")}


def canonical_dump(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row): every row as JSON with columns by name, in total order."""
    parts = [df.select(F.lit(name).alias("table"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("row")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.union, parts).orderBy("table", "row")


def validate(snapshot: dict[str, DataFrame]) -> DataFrame:
    """(rule, offending): counts of rows that break a key, a reference or a vocabulary; all must be 0."""
    from ..functions.vocab import outside

    entity, assertion, observation = snapshot["entity"], snapshot["assertion"], snapshot["observation"]
    ids = entity.select(F.col("entity_id"))
    rules = {
        "entity_key": entity.groupBy("entity_id").count().where("count > 1"),
        "assertion_key": assertion.groupBy("assertion_id").count().where("count > 1"),
        "entity_kind": outside(entity, "kind", "entity_kind"),
        "relation": outside(assertion, "relation", "relation"),
        "source_exists": lacking(assertion, ids.withColumnRenamed("entity_id", "source_id"), ["source_id"]),
        "target_exists": lacking(assertion, ids.withColumnRenamed("entity_id", "target_id"), ["target_id"]),
        "evidence_has_assertion": lacking(observation, assertion, ["assertion_id"]),
        "source_type": observation.where(~F.col("source_type").between(0, 11)),
    }
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("offending")).select(F.lit(k).alias("rule"), "offending") for k, df in rules.items()])


def diagnostics(snapshot: dict[str, DataFrame], run: DataFrame, index: DataFrame) -> DataFrame:
    """(metric, n): entities, documents of the search index (entity_id), whether these differ, runs, and runs that never finished."""
    parts = {
        "entities": snapshot["entity"].agg(F.count("*").alias("n")), "indexed_documents": index.agg(F.count_distinct("entity_id").alias("n")), "not_indexed": lacking(snapshot["entity"], index, ["entity_id"]).agg(F.count("*").alias("n")),
        "indexed_but_gone": lacking(index.select("entity_id").distinct(), snapshot["entity"], ["entity_id"]).agg(F.count("*").alias("n")), "extractor_runs": run.agg(F.count("*").alias("n")), "unfinished_runs": run.agg(F.count_if(F.col("finished_at").isNull()).alias("n")),
    }
    return reduce(DataFrame.union, [df.select(F.lit(k).alias("metric"), "n") for k, df in parts.items()])


def dump_counters(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of a snapshot."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("table"), "rows") for k, df in sorted(tables.items())])


def usable_facts(facts: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """Cached facts (file_path, content_hash, version, ...) that still hold: same content, same version of the extractor."""
    return facts.where(F.col("version") == version).join(files.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi")


def store_facts(facts: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache after a run: new rows replace those of their path, paths that are gone (file_path) lose theirs."""
    paths = new.select("file_path").union(gone.select("file_path")).distinct()
    return facts.join(paths, "file_path", "left_anti").unionByName(new)


def envelope(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object whose fields follow `ok`."""
    return rows.select(F.to_json(F.struct(F.lit(True).alias("ok"), *[F.col(c) for c in rows.columns])).alias("json"))
