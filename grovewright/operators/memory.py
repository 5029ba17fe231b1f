"""Notes confirmed by people: event-sourced status, views, citations; and cross-repository links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.helpers import cascade

# The legal transitions of a note.
TRANSITIONS = {None: ["proposed"], "proposed": ["active", "invalidated"], "active": ["superseded", "invalidated"], "superseded": [], "invalidated": []}


def replay(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status by memory_id, illegal events). events: memory_id, event_id, to_status.

    The status is that of the last event; an event is illegal if it may not follow the one before.
    """
    before = events.withColumn("from_status", F.lag("to_status").over(Window.partitionBy("memory_id").orderBy("event_id")))
    legal = F.lit(False)
    for a, bs in TRANSITIONS.items():
        legal = legal | ((F.col("from_status").isNull() if a is None else F.col("from_status") == a) & F.col("to_status").isin(bs or [""]))
    status = events.groupBy("memory_id").agg(F.max_by("to_status", "event_id").alias("status"))
    return status, before.where(~F.coalesce(legal, F.lit(False)))


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """events and those of new that are legal after what is recorded (compare-and-set on the status)."""
    status, _ = replay(events)
    checked = new.join(status, "memory_id", "left")
    legal = F.lit(False)
    for a, bs in TRANSITIONS.items():
        legal = legal | ((F.col("status").isNull() if a is None else F.col("status") == a) & F.col("to_status").isin(bs or [""]))
    return events.unionByName(checked.where(legal).select(*events.columns))


def cite(citation: DataFrame, new: DataFrame, memory: DataFrame) -> DataFrame:
    """Citations after new ones (citation_id, memory_id, ...): a known id stays as it is, one of a note that isn't there is refused."""
    known = new.join(memory.select("memory_id").distinct(), "memory_id", "left_semi").join(citation.select("citation_id"), "citation_id", "left_anti")
    return citation.unionByName(known.dropDuplicates(["citation_id"]).select(*citation.columns))


def page(rows: DataFrame, key: str, limit: int, after: str | int | None = None) -> DataFrame:
    """Rows in order of their key, those after a key only: notes by memory_id, links by link_id, registry entries by registry_id."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def views(memory: DataFrame) -> DataFrame:
    """memory with multiple_active and conflicted, for active rows only: several in one (subject, scope), and different claims there."""
    active = F.col("status") == "active"
    group = Window.partitionBy("subject", "scope")
    n = F.count_if(active).over(group)
    low, high = F.min(F.when(active, F.col("claim_key"))).over(group), F.max(F.when(active, F.col("claim_key"))).over(group)
    return memory.withColumns({"multiple_active": active & (n > 1), "conflicted": active & F.coalesce(low != high, F.lit(False))})


def subject_state(memory: DataFrame, entity: DataFrame, link: DataFrame) -> DataFrame:
    """memory with how its subject is found: resolved, via_identity_link, ambiguous, missing."""
    live = entity.select(F.col("entity_id").alias("subject")).withColumn("live", F.lit(True))
    linked = link.select(F.col("left_id").alias("subject"), F.col("right_id").alias("entity_id")).union(link.select("right_id", "left_id")).distinct()
    to = linked.join(entity.select("entity_id"), "entity_id", "left_semi").groupBy("subject").agg(F.count("*").alias("targets"))
    out = memory.join(live, "subject", "left").join(to, "subject", "left")
    return out.withColumn("subject_state", cascade([(F.col("live"), "resolved"), (F.col("targets") == 1, "via_identity_link"), (F.col("targets") > 1, "ambiguous")], "missing")).drop("live", "targets")


def search(memory: DataFrame, query: str) -> DataFrame:
    return memory.where(S.contains_text(F.col("statement"), query)).orderBy("memory_id")


def superseded_by(memory: DataFrame) -> DataFrame:
    """memory with the note that names it as its predecessor."""
    nxt = memory.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("memory_id")).agg(F.min("memory_id").alias("superseded_by"))
    return memory.join(nxt, "memory_id", "left")


def link_freshness(link: DataFrame, registry: DataFrame, source_now: DataFrame, target_now: DataFrame) -> DataFrame:
    """Links with their freshness: availability, withdrawal, missing source, partial target, then which side changed.

    A link whose registry entry is missing stays, as `unregistered`.
    """
    rows = link.join(registry.select("registry_id", "availability"), "registry_id", "left")
    rows = rows.join(source_now.select(F.col("path").alias("source_path"), F.col("hash").alias("source_hash_now")), "source_path", "left")
    rows = rows.join(target_now.select("registry_id", F.col("path").alias("target_path"), F.col("hash").alias("target_hash_now")), ["registry_id", "target_path"], "left")
    s, t = (~F.col(f"{x}_hash").eqNullSafe(F.col(f"{x}_hash_now")) for x in ("source", "target"))
    state = cascade([
        (F.col("availability").isNull(), "unregistered"), (F.col("availability") != "available", "target_unavailable"), (F.col("status") == "withdrawn", "withdrawn"),
        (F.col("source_hash_now").isNull(), "source_missing"), (F.col("target_hash_now").isNull(), "target_partially_indexed"), (s & t, "both_changed"), (s, "source_changed"), (t, "target_changed"),
    ], "fresh")
    return rows.withColumn("freshness", state).orderBy("link_id")


def availability(registry: DataFrame) -> DataFrame:
    """tombstoned, missing, refused, moved, partially_indexed or available, in that order of questions."""
    c = F.col
    state = cascade([
        (c("status") == "tombstoned", "tombstoned"), (~c("path_exists"), "missing"), (~c("readable"), "refused"), (~c("repo_id").eqNullSafe(c("repo_id_now")), "moved"), (c("indexed_state").isNull(), "partially_indexed"),
    ], "available")
    return registry.withColumn("availability", state)


def contract_ambiguity(link: DataFrame) -> DataFrame:
    """Links with whether their identity (source, specifier) leads to several targets or is stated several times."""
    by = link.groupBy("source_path", "specifier").agg(F.count("*").alias("n"), (F.min("target_path") != F.max("target_path")).alias("several"))
    return link.join(by, ["source_path", "specifier"]).withColumn("ambiguity", F.when(F.col("several"), "many_targets").when(F.col("n") > 1, "repeated").otherwise("unique")).drop("n", "several")
