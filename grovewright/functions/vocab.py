"""Closed vocabularies. An unknown value is an error, never a new member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Members in their order, which is also their ordinal.
VOCABULARIES: dict[str, list[str]] = {
    "entity_kind": ["repository", "directory", "file", "module", "function", "method", "class", "interface", "document", "section", "unresolved", "coverage_run", "endpoint"],
    "relation": ["CONTAINS", "DEFINES", "IMPORTS", "EXPORTS", "CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "SUPERSEDES", "COVERS", "SERVED_BY", "TEST_OBSERVED_CALL"],
    "source_type": ["AST_DIRECT", "AST_RESOLVED", "AST_HEURISTIC", "TYPE_RESOLVED", "FRAMEWORK_RULE", "TEST_COVERAGE", "TEST_CALL_TRACE", "RUNTIME_CALL_TRACE", "DOCUMENT_STATED", "HUMAN_CONFIRMED", "LLM_DERIVED", "FILESYSTEM_OBSERVED"],
    "directness": ["DIRECT", "RESOLVED", "INFERRED"],
    "assertion_status": ["SUPPORTED", "CONTRADICTED", "STALE", "UNRESOLVED", "DELETED"],
    "unresolved_category": ["module", "value", "document_link", "document_supersedes"],
    "change_kind": ["added", "modified", "deleted", "mode_changed"],
    "parent_completeness": ["root", "shallow_boundary", "parents_available", "parents_missing", "parents_unverifiable"],
    "changes_enumerated": ["enumerated", "merge_not_enumerated", "parent_unavailable", "refused"],
    "walk_termination": ["exhausted", "commit_budget", "shallow_boundary", "missing_object", "refused"],
    "rename_evidence": ["exact_content", "similar_content"],
    "rename_ambiguity": ["unique", "many_from", "many_to", "many_both"],
    "rename_analysis": ["complete", "partial", "refused_bound", "not_attempted"],
    "first_observed": ["created_in_visible_history", "earliest_visible_change", "present_before_visible_history", "absent_from_visible_history", "current_tree_unknown", "no_history_ingested"],
    "history_freshness": ["current", "stale", "unverifiable", "no_history_ingested"],
    "freshness": ["fresh", "stale", "file-missing", "refused", "unreadable"],
    "symbol_coverage": ["covered", "partial", "uncovered", "unmeasured"],
    "trust": ["current", "no_index", "unusable", "stale", "unverified"],
    "trace_binding": ["stale", "unverified", "bound"],
    "memory_status": ["proposed", "active", "superseded", "invalidated"],
}
# Prefixes of entity ids, by kind.
PREFIXES = dict(zip(VOCABULARIES["entity_kind"], ["repo", "dir", "file", "mod", "fn", "meth", "class", "iface", "doc", "sect", "unres", "cov", "endp"]))
SYMBOL_KINDS = ["function", "method", "class", "interface"]
CONTENT_KINDS, CONTAINER_KINDS = ["module", "document"], ["file", "directory"]
#: Relations that an impact question follows when none are named.
IMPACT_RELATIONS = ["CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "SERVED_BY"]


def parse(vocabulary: str, value: str) -> str:
    if value not in VOCABULARIES[vocabulary]:
        raise ValueError(f"{value!r} is not a {vocabulary}")
    return value


def parse_all(vocabulary: str, values: list[str] | None) -> list[str]:
    return [parse(vocabulary, v) for v in values or []]


def table(spark: SparkSession) -> DataFrame:
    """(vocabulary, member, ordinal)"""
    return spark.createDataFrame([(k, m, i) for k, ms in VOCABULARIES.items() for i, m in enumerate(ms)], "vocabulary string, member string, ordinal int")


def ordinal(vocabulary: str, column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in VOCABULARIES[vocabulary]]), column).cast("int") - 1


def member(vocabulary: str, position: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in VOCABULARIES[vocabulary]]), position.cast("int"))


def outside(df: DataFrame, column: str, vocabulary: str) -> DataFrame:
    """Rows whose value is no member: must be empty."""
    return df.where(~F.col(column).isin(VOCABULARIES[vocabulary]) | F.col(column).isNull())
