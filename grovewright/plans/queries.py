"""Named queries over the driver's tables, each with its SQL where SQL can express it.

limit stands only where the question has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators import claims, coverage, graph, history, incremental, lookup, memory
from ..sources import markdown, traces
from ..streaming import ingest
from .adapters import Model, sql
from .helpers import first_by

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


NAMES = ", ".join(f"'{x}'" for x in vocab.VOCABULARIES["source_type"])
STATE = f"""(SELECT assertion_id, CASE WHEN e.kind = 'unresolved' THEN 'UNRESOLVED' ELSE 'SUPPORTED' END AS status, e.kind = 'unresolved' AS is_unresolved,
    [{NAMES}][min(source_type) + 1] AS strongest_source_type, bit_or(1::BIGINT << source_type::BIGINT) AS source_type_mask, count(*) AS evidence_count
    FROM observation JOIN assertion USING (assertion_id) JOIN entity e ON e.entity_id = target_id GROUP BY assertion_id, e.kind)"""
EVIDENCE = ("entity", "assertion", "observation")


# --- derivation and claims -------------------------------------------------------------


@query(sql(f"SELECT * FROM {STATE}", *EVIDENCE))
def a1_assertion_state(m: Model) -> DataFrame:
    return claims.derive_state(m.observation, m.assertion, m.entity)


@query(sql(f"SELECT relation, status, strongest_source_type, count(*) AS n, sum(evidence_count)::BIGINT AS evidence, bit_or(source_type_mask) AS mask FROM {STATE} JOIN assertion USING (assertion_id) GROUP BY ALL", *EVIDENCE))
def a1_state_by_relation(m: Model) -> DataFrame:
    return claims.stated_claims(m.observation, m.assertion, m.entity).groupBy("relation", "status", "strongest_source_type").agg(F.count("*").alias("n"), F.sum("evidence_count").alias("evidence"), F.bit_or("source_type_mask").alias("mask"))


@query(sql(f"SELECT * FROM {STATE}", *EVIDENCE))
def a2_scoped_derivation(m: Model) -> DataFrame:
    """A stale state, corrected only where evidence at one path touches it, equals the full derivation."""
    touched = m.observation.where("file_path = 'supp/1'").select("assertion_id")
    full = claims.derive_state(m.observation, m.assertion, m.entity)
    stale = full.join(touched.distinct().withColumn("t", F.lit(True)), "assertion_id", "left").withColumn("evidence_count", F.when(F.col("t"), 0).otherwise(F.col("evidence_count"))).drop("t")
    return claims.derive_scoped(stale, touched, m.observation, m.assertion, m.entity)


@query(sql("""SELECT 'kind' AS metric, kind AS name, count(*) AS n FROM entity GROUP BY kind UNION ALL SELECT 'relation', relation, count(*) FROM assertion GROUP BY relation
    UNION ALL SELECT 'total', 'observations', count(*) FROM observation UNION ALL SELECT 'total', 'entities', count(*) FROM entity UNION ALL SELECT 'total', 'assertions', count(*) FROM assertion""", *EVIDENCE))
def a3_status(m: Model) -> DataFrame:
    return lookup.status(m.entity, m.assertion, m.observation)


@query(sql("""SELECT source_id AS entity_id, 'outgoing' AS side, relation, count(*) AS n FROM assertion GROUP BY ALL UNION ALL SELECT target_id, 'incoming', relation, count(*) FROM assertion GROUP BY ALL""", "assertion"))
def a4_relation_counts(m: Model) -> DataFrame:
    return lookup.relation_counts(m.assertion)


@query(sql("""SELECT entity_id, scope_path, name, count(assertion_id) AS referencing FROM entity LEFT JOIN assertion ON target_id = entity_id WHERE kind = 'unresolved' GROUP BY ALL ORDER BY referencing DESC, scope_path, name, entity_id LIMIT 50 OFFSET 5""", "entity", "assertion"))
def a5_unresolved_ranking(m: Model) -> DataFrame:
    return lookup.unresolved(m.entity, m.assertion, 50, 5)


@query(sql(f"SELECT coalesce(sum(evidence_count), 0)::BIGINT AS sites, count(*) AS assertions, count(DISTINCT target_id) AS targets FROM {STATE} JOIN assertion USING (assertion_id) WHERE is_unresolved AND relation IN ('CALLS', 'REFERENCES', 'EXTENDS', 'IMPLEMENTS', 'SERVED_BY')", *EVIDENCE))
def a6_unresolved_account(m: Model) -> DataFrame:
    open_ = claims.unresolved_claims(m.assertion, m.entity)
    return lookup.unresolved_account(claims.state_of(m.observation, open_, m.entity, open_.select("assertion_id")), open_, vocab.IMPACT_RELATIONS)


@query("""SELECT r_name AS name, sha256(string_agg(path || chr(31) || h || chr(10), '' ORDER BY path)) AS merkle FROM (SELECT r_name, n_name AS path, sha256(n_name) AS h FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name""")
def a22_content_merkle(m: Model) -> DataFrame:
    rows = m.raw("nation").join(F.broadcast(m.raw("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("h"))
    return rows.groupBy(F.col("r_name").alias("name")).agg(S.content_merkle("path", "h").alias("merkle"))


@query(sql("""SELECT 'entity_key' AS rule, 0::BIGINT AS offending UNION ALL SELECT 'assertion_key', 0 UNION ALL SELECT 'entity_kind', 0 UNION ALL SELECT 'relation', 0 UNION ALL SELECT 'source_exists', 0
    UNION ALL SELECT 'target_exists', count(*) FROM assertion WHERE target_id NOT IN (SELECT entity_id FROM entity) UNION ALL SELECT 'evidence_has_assertion', count(*) FROM observation WHERE assertion_id NOT IN (SELECT assertion_id FROM assertion) UNION ALL SELECT 'source_type', 0""", *EVIDENCE))
def q14_validation(m: Model) -> DataFrame:
    return claims.validate({"entity": m.entity, "assertion": m.assertion, "observation": m.observation})


@query("""WITH new AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT -1 - c_custkey, c_name, NULL FROM customer WHERE c_custkey % 5 = 0)
    SELECT count(*) FILTER (c_custkey < 0) AS inserted, count(*) FILTER (c_custkey >= 0 AND c_custkey % 3 = 0) AS updated, count(*) FILTER (c_custkey >= 0 AND c_custkey % 3 <> 0) AS unchanged FROM new""")
def w1_upsert_counts(m: Model) -> DataFrame:
    old = m.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
    even = old.where("c_custkey % 2 = 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    fresh = old.where("c_custkey % 5 = 0").select((-1 - F.col("c_custkey")).alias("c_custkey"), "c_name", F.lit(None).cast("string").alias("c_mktsegment"))
    return claims.upsert(old, even.union(fresh), ["c_custkey"])[1]


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events) SELECT user_id, max_by(event_type, event_id) AS status FROM e GROUP BY user_id""")
def w3_run_status(m: Model) -> DataFrame:
    e = m.raw("events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("status"))
    return claims.run_status(e).withColumnRenamed("run_id", "user_id")


@query(sql("""SELECT count(*) AS observations, count(DISTINCT assertion_id) AS assertions FROM observation WHERE NOT (file_path IN (SELECT 'supp/' || s_suppkey FROM supplier WHERE s_nationkey = 3) AND extractor_id = 'lines')""", "observation"))
def w6_delete_extractor_paths(m: Model) -> DataFrame:
    paths = m.raw("supplier").where("s_nationkey = 3").select(F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("file_path"))
    out, _ = claims.delete_paths({"observation": m.observation}, paths, ["lines"])
    return out["observation"].agg(F.count("*").alias("observations"), F.count_distinct("assertion_id").alias("assertions"))


SUPPORTED = "(SELECT * FROM assertion WHERE assertion_id IN (SELECT assertion_id FROM observation))"


@query(sql(f"""SELECT 'assertion' AS "table", relation AS name, count(*) AS n FROM {SUPPORTED} GROUP BY relation UNION ALL
    SELECT 'entity', kind, count(*) FROM entity WHERE kind = 'repository' OR entity_id IN (SELECT source_id FROM {SUPPORTED} UNION SELECT target_id FROM {SUPPORTED} UNION SELECT entity_id FROM occurrence) GROUP BY kind""", *EVIDENCE, "occurrence"))
def w10_prune_orphans(m: Model) -> DataFrame:
    kept = claims.prune_orphans({"entity": m.entity, "assertion": m.assertion, "observation": m.observation, "occurrence": m.occurrence})
    parts = [kept[t].groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "name", "n") for t, c in (("assertion", "relation"), ("entity", "kind"))]
    return parts[0].union(parts[1])


@query(sql(""", doomed AS MATERIALIZED (SELECT * FROM assertion ANTI JOIN observation USING (assertion_id) WHERE relation IN ('IMPLEMENTS', 'DEFINES')), kept AS MATERIALIZED (SELECT * FROM assertion ANTI JOIN doomed USING (assertion_id)),
    near AS (SELECT source_id AS e FROM doomed UNION SELECT target_id FROM doomed UNION SELECT entity_id FROM entity WHERE kind = 'directory'), used AS (SELECT source_id AS e FROM kept UNION SELECT target_id FROM kept UNION SELECT entity_id FROM occurrence UNION SELECT entity_id FROM entity WHERE kind = 'repository'),
    gone AS MATERIALIZED (SELECT e AS entity_id FROM near EXCEPT SELECT e FROM used) SELECT kind, count(*) AS n FROM entity ANTI JOIN gone USING (entity_id) GROUP BY kind""", *EVIDENCE, "occurrence"))
def w11_prune_scoped(m: Model) -> DataFrame:
    """After a run that touched the claims of two relations and the directories."""
    touched = m.assertion.where("relation IN ('IMPLEMENTS', 'DEFINES')").select("assertion_id")
    kept = claims.prune_scoped({"entity": m.entity, "assertion": m.assertion, "observation": m.observation, "occurrence": m.occurrence}, touched, m.entity.where("kind = 'directory'").select("entity_id"))
    return kept["entity"].groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT 'nation' AS "table", '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS "row" FROM nation UNION ALL SELECT 'region', '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' FROM region""")
def w18_canonical_dump(m: Model) -> DataFrame:
    return claims.canonical_dump({"nation": m.raw("nation"), "region": m.raw("region")})


# --- filters, names, selectors, search ---------------------------------------------------


@query(sql("""SELECT entity_id, CASE WHEN kind IN ('function', 'method', 'class', 'interface') AND scope_path <> '' THEN scope_path || '.' || name ELSE name END AS qualified,
    CASE WHEN kind IN ('module', 'document') THEN scope_path WHEN kind IN ('file', 'directory') THEN CASE WHEN scope_path = '' THEN name ELSE scope_path || '/' || name END END AS path FROM entity""", "entity"))
def f6_names_and_paths(m: Model) -> DataFrame:
    c = F.col
    return m.entity.select("entity_id", S.qualified_name(c("kind"), c("scope_path"), c("name")).alias("qualified"), S.repository_path(c("kind"), c("scope_path"), c("name")).alias("path"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN props IS NULL THEN '-' ELSE event_type || ':' || user_id END AS location FROM events WHERE contains(translate(event_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'r')""")
def f9_json_and_contains(m: Model) -> DataFrame:
    e = m.raw("events").where(S.contains_text(F.col("event_type"), "R"))
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.when(F.col("props").isNull(), "-").otherwise(S.location(F.col("event_type"), F.col("user_id"))).alias("location"))


@query("""SELECT page_id, sha256('document' || chr(31) || url) AS digest, 'doc_' || substr(sha256('document' || chr(31) || url), 1, 32) AS id FROM pages""")
def f0_identities(m: Model) -> DataFrame:
    return m.raw("pages").select("page_id", S.digest(F.lit("document"), F.col("url")).alias("digest"), S.entity_id(F.lit("document"), F.col("url")).alias("id"))


@query(sql("""SELECT count(*) AS n FROM entity WHERE scope_path = 'dir_1' OR starts_with(scope_path, 'dir_1/')""", "entity"))
def f4_path_prefix(m: Model) -> DataFrame:
    return m.entity.where(S.under_path(F.col("scope_path"), "dir_1/")).agg(F.count("*").alias("n"))


@query(sql("""SELECT 'resolved' AS outcome, 'name' AS stage, entity_id, kind, name FROM entity WHERE name = 'Customer#000000007'""", "entity"))
def q1_selector_name(m: Model) -> DataFrame:
    return lookup.resolve_selector(m.entity, "Customer#000000007")


@query(sql("""SELECT CASE WHEN count(*) OVER () > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome, 'path' AS stage, entity_id, kind, name FROM entity WHERE kind = 'module' AND scope_path = 'dir_3'""", "entity"))
def q1_selector_ambiguous_path(m: Model) -> DataFrame:
    return lookup.resolve_selector(m.entity.where("entity_id != 'dir_3'"), "dir_3")


@query("SELECT 'not_found' AS outcome, NULL::VARCHAR AS stage, NULL::VARCHAR AS entity_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS name")
def q1_selector_not_found(m: Model) -> DataFrame:
    return lookup.resolve_selector(m.entity, "kind:no such thing")


@query(sql("""SELECT DISTINCT name, 5 AS prefix_length FROM entity WHERE starts_with(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'natio') ORDER BY name LIMIT 5""", "entity"))
def q1b_suggestions(m: Model) -> DataFrame:
    return lookup.suggestions(m.entity, "natioq")


@query(sql(r""", w AS (SELECT entity_id, list_filter(regexp_split_to_array(lower(name || ' ' || scope_path), '[^\pL\pN]+'), lambda x: x <> '') AS ws FROM entity),
    d AS (SELECT count(*) AS docs, avg(len(ws)) AS av FROM w WHERE len(ws) > 0), t AS (SELECT entity_id, len(ws) AS size, unnest(ws) AS term FROM w),
    h AS (SELECT entity_id, size, token, count(*) AS tf FROM t, (SELECT unnest(['brand', 'wid']) AS token) WHERE starts_with(term, token) GROUP BY ALL),
    f AS (SELECT token, count(*) AS df FROM h GROUP BY token)
    SELECT entity_id, kind, name, round(-score, 6) AS score FROM (SELECT entity_id, count(*) AS n, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / av)))) AS score FROM h JOIN f USING (token), d GROUP BY entity_id) JOIN entity USING (entity_id) WHERE n = 2 ORDER BY round(-score, 6), entity_id LIMIT 200""", "entity"))
def q2_search(m: Model) -> DataFrame:
    return lookup.search(m.entity, "wid BRAND", limit=200)


@query("""SELECT c_mktsegment AS file_path, CASE WHEN count(DISTINCT c_nationkey % 2) = 1 THEN min(c_nationkey % 2)::VARCHAR END AS content_hash FROM customer GROUP BY c_mktsegment""")
def f12_indexed_hash(m: Model) -> DataFrame:
    return lookup.indexed_hash(m.raw("customer").select(F.col("c_mktsegment").alias("file_path"), (F.col("c_nationkey") % 2).cast("string").alias("content_hash")))


@query("""WITH r AS (SELECT s_nationkey AS p, (s_suppkey % 4)::VARCHAR AS h FROM supplier), now AS (SELECT n_nationkey AS p, '0' AS h FROM nation WHERE n_nationkey % 5 > 0)
    SELECT p::VARCHAR AS file_path, CASE WHEN now.h IS NULL THEN 'file-missing' WHEN bool_or(r.h <> now.h) THEN 'stale' ELSE 'fresh' END AS freshness FROM r LEFT JOIN now USING (p) GROUP BY p, now.h""")
def q8_freshness(m: Model) -> DataFrame:
    recorded = m.raw("supplier").select(F.col("s_nationkey").cast("string").alias("file_path"), (F.col("s_suppkey") % 4).cast("string").alias("content_hash"))
    now = m.raw("nation").where("n_nationkey % 5 > 0").select(F.col("n_nationkey").cast("string").alias("file_path"), F.lit("0").alias("content_hash"), F.lit(None).cast("string").alias("problem"))
    return lookup.freshness(recorded, now)


# --- graph -----------------------------------------------------------------------------

ALL_DOWN = ["CONTAINS", "DEFINES", "REFERENCES", "IMPLEMENTS"]
REACH = """, r(entity_id, depth) AS (SELECT 'fn_1', 0 UNION SELECT source_id, depth + 1 FROM r JOIN assertion ON target_id = entity_id WHERE depth < 4), best AS (SELECT entity_id, min(depth) AS depth FROM r WHERE entity_id <> 'fn_1' GROUP BY entity_id)"""


@query(sql(REACH + " SELECT entity_id, depth FROM best", "assertion", recursive=True))
def q6_impact(m: Model) -> DataFrame:
    return graph.impact(m.assertion, m.spark.createDataFrame([("fn_1",)], "entity_id string"), 4, ALL_DOWN).select("entity_id", "depth")


@query(sql(REACH + """ SELECT 'by_depth' AS metric, depth::VARCHAR AS name, count(*) AS n FROM best GROUP BY depth UNION ALL SELECT 'by_kind', kind, count(*) FROM best JOIN entity USING (entity_id) GROUP BY kind UNION ALL SELECT 'entities', '', count(*) FROM best""", "entity", "assertion", recursive=True))
def a7_impact_totals(m: Model) -> DataFrame:
    found = graph.impact(m.assertion, m.spark.createDataFrame([("fn_1",)], "entity_id string"), 4, ALL_DOWN)
    return graph.impact_totals(found, m.entity).where("metric != 'by_relation'")  # a7_impact_report_totals has them, with SQL that knows the edge found first


@query(sql("""SELECT DISTINCT source_id AS entity_id, 1 AS depth, relation FROM assertion WHERE target_id = 'fn_1' AND relation IN ('REFERENCES', 'IMPLEMENTS')""", "assertion"))
def q6_impact_default_relations(m: Model) -> DataFrame:
    return graph.impact(m.assertion, m.spark.createDataFrame([("fn_1",)], "entity_id string"), 6).select("entity_id", "depth", "relation")


@query(sql(""", r(here, nodes, edges) AS (SELECT 'repo_0', ['repo_0'], []::VARCHAR[] UNION ALL SELECT target_id, nodes || [target_id], edges || [relation || '|' || target_id || '|' || assertion_id] FROM r JOIN assertion ON source_id = here WHERE len(edges) < 4 AND here <> 'fn_1')
    SELECT len(edges)::INT AS hops, array_to_string(nodes, '>') AS nodes FROM r WHERE here = 'fn_1' ORDER BY len(edges), edges LIMIT 3""", "assertion", recursive=True))
def q3_find_paths(m: Model) -> DataFrame:
    return graph.find_paths(m.assertion, "repo_0", "fn_1", 6, 3)[0].select("hops", F.array_join("nodes", ">").alias("nodes"))


NEAR = """, e AS (SELECT CASE WHEN source_id = 'dir_2' THEN target_id ELSE source_id END AS entity_id, relation, source_id, target_id, assertion_id FROM assertion WHERE source_id = 'dir_2' OR target_id = 'dir_2'), n AS (SELECT 'dir_2' AS entity_id, 0 AS depth UNION ALL SELECT entity_id, 1 FROM (SELECT * FROM e ORDER BY relation, source_id, target_id, assertion_id LIMIT 19))"""


@query(sql(NEAR + " SELECT depth::INT AS depth, kind, name, entity_id FROM n JOIN entity USING (entity_id)", "entity", "assertion"))
def q4_neighbourhood_nodes(m: Model) -> DataFrame:
    """20 nodes, fewer than there are."""
    return graph.neighbourhood(m.assertion, m.entity, "dir_2", 1, 20)["nodes"]


@query(sql(NEAR + " SELECT assertion_id, source_id, relation, target_id FROM assertion WHERE source_id IN (SELECT entity_id FROM n) AND target_id IN (SELECT entity_id FROM n)", "assertion"))
def q4_neighbourhood_edges(m: Model) -> DataFrame:
    return graph.neighbourhood(m.assertion, m.entity, "dir_2", 1, 20)["edges"].select("assertion_id", "source_id", "relation", "target_id")


@query(sql(NEAR + " SELECT DISTINCT entity_id FROM e WHERE entity_id NOT IN (SELECT entity_id FROM n)", "assertion"))
def q4_neighbourhood_omitted(m: Model) -> DataFrame:
    return graph.neighbourhood(m.assertion, m.entity, "dir_2", 1, 20)["omitted"]


@query(sql("""SELECT assertion_id, relation, source_id = 'fn_1' AS outgoing, CASE WHEN source_id = 'fn_1' THEN target_id ELSE source_id END AS other_end, file_path, start_line, source_type FROM assertion LEFT JOIN observation USING (assertion_id) WHERE source_id = 'fn_1' OR target_id = 'fn_1'""", "assertion", "observation"))
def q5_explain(m: Model) -> DataFrame:
    return graph.explain(m.assertion, m.observation, "fn_1").select("assertion_id", "relation", "outgoing", "other_end", "file_path", "start_line", "source_type")


@query(sql(""", r(a, b) AS (SELECT src, dst FROM edge UNION SELECT a, dst FROM r JOIN edge ON b = src), s AS (SELECT x.a AS node, min(x.b) AS component, count(*) AS n FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
    SELECT node, component FROM s WHERE n > 1""", "edge", recursive=True))
def a19_cycles(m: Model) -> DataFrame:
    return graph.cycles(m.edge)


# --- history ---------------------------------------------------------------------------


@query(sql("SELECT commit_oid, committer_time, summary FROM commits ORDER BY committer_time DESC, commit_oid LIMIT 20 OFFSET 10", "commits"))
def q16_commit_log(m: Model) -> DataFrame:
    return history.commit_log(m.commit, 20, 10).select("commit_oid", "committer_time", "summary")


@query(sql("SELECT commit_oid, path, change_kind, committer_time FROM change JOIN commits USING (commit_oid) WHERE path = 'part/7' ORDER BY committer_time DESC, commit_oid LIMIT 20", "commits", "change"))
def q17_commits_touching(m: Model) -> DataFrame:
    return history.commits_touching(m.change, m.commit, "part/7").select("commit_oid", "path", "change_kind", "committer_time")


@query(sql("SELECT path, count(DISTINCT commit_oid) AS commits FROM change GROUP BY path", "change"))
def a12_change_frequency(m: Model) -> DataFrame:
    return history.change_frequency(m.change, None)


@query(sql("SELECT path, count(DISTINCT commit_oid) AS commits FROM change GROUP BY path ORDER BY commits DESC, path LIMIT 20", "change"))
def k10_change_frequency_top(m: Model) -> DataFrame:
    return history.change_frequency(m.change, 20)


@query(sql("SELECT a.path AS path_a, b.path AS path_b, count(*) AS commits FROM change a JOIN change b ON a.commit_oid = b.commit_oid AND b.path > a.path GROUP BY ALL ORDER BY commits DESC, path_a, path_b LIMIT 20", "change"))
def a13_cochange(m: Model) -> DataFrame:
    return history.cochange(m.change)


@query(sql("SELECT least(a.path, b.path) AS path_a, greatest(a.path, b.path) AS path_b, count(*) AS commits FROM change a JOIN change b ON a.commit_oid = b.commit_oid AND b.path <> a.path WHERE a.path = 'part/7' GROUP BY ALL", "change"))
def q22_cochange_of_path(m: Model) -> DataFrame:
    return history.cochange(m.change, "part/7", None)


@query(sql("SELECT count(*) AS pairs_total FROM (SELECT DISTINCT a.path, b.path FROM change a JOIN change b ON a.commit_oid = b.commit_oid AND b.path > a.path)", "change"))
def a13_cochange_total(m: Model) -> DataFrame:
    return history.cochange_totals(m.change)


@query(sql("""SELECT 'changes_' || k AS metric, (SELECT count(*) FROM change WHERE change_kind = k) AS n FROM (SELECT unnest(['added', 'modified', 'deleted', 'mode_changed']) AS k)
    UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'merges', 0 UNION ALL SELECT 'changes', count(*) FROM change""", "commits", "change"))
def a14_history_totals(m: Model) -> DataFrame:
    return history.history_totals(m.commit, m.change)


@query(sql(""", t AS (SELECT * FROM change JOIN commits USING (commit_oid)), f AS (SELECT path, commit_oid, change_kind FROM t QUALIFY row_number() OVER (PARTITION BY path ORDER BY committer_time, commit_oid) = 1),
    l AS (SELECT path, commit_oid, change_kind FROM t QUALIFY row_number() OVER (PARTITION BY path ORDER BY committer_time DESC, commit_oid) = 1), g AS (SELECT path, count(*) FILTER (change_kind = 'added') AS additions, bool_or(hidden) AS hidden FROM t GROUP BY path)
    SELECT path, f.commit_oid AS first_oid, l.commit_oid AS last_oid, f.change_kind AS first_kind, l.change_kind AS last_kind, additions,
        CASE WHEN f.change_kind = 'added' AND NOT hidden AND additions = 1 THEN 'created_in_visible_history' WHEN f.change_kind = 'added' THEN 'earliest_visible_change' ELSE 'present_before_visible_history' END AS observed FROM g JOIN f USING (path) JOIN l USING (path)""", "commits", "change"))
def q19_first_last_observed(m: Model) -> DataFrame:
    return history.first_last_observed(m.change, m.commit)


def _ends(m: Model) -> tuple[str, str]:
    rows = m.commit.where("o_custkey IS NOT NULL") if "o_custkey" in m.commit.columns else m.commit
    newest = rows.orderBy(F.desc("committer_time"), "commit_oid").first()
    return newest["commit_oid"], newest["parent_oids"][0] if newest["parent_oids"] else newest["commit_oid"]


@query(sql(""", top AS (SELECT commit_oid, parent_oid FROM parent JOIN commits USING (commit_oid) ORDER BY committer_time DESC, commit_oid LIMIT 1), up(c) AS (SELECT commit_oid FROM top UNION SELECT parent_oid FROM up JOIN parent ON commit_oid = c WHERE parent_oid IS NOT NULL),
    low(c) AS (SELECT coalesce(parent_oid, commit_oid) FROM top UNION SELECT parent_oid FROM low JOIN parent ON commit_oid = c WHERE parent_oid IS NOT NULL) SELECT commit_oid, path, change_kind FROM change WHERE commit_oid IN (SELECT c FROM up) AND commit_oid NOT IN (SELECT c FROM low)""", "commits", "parent", "change", recursive=True))
def q20_state_diff(m: Model) -> DataFrame:
    newer, older = _ends(m)
    return history.state_diff(m.commit, m.change, older, newer)[2].select("commit_oid", "path", "change_kind")


@query(sql(""", d AS (SELECT * FROM content WHERE change_kind = 'deleted'), a AS (SELECT * FROM content WHERE change_kind = 'added'), p AS (SELECT d.commit_oid, d.blob_oid, d.path AS from_path, a.path AS to_path FROM d JOIN a USING (commit_oid, blob_oid)),
    n AS (SELECT *, count(*) OVER (PARTITION BY commit_oid, from_path) AS f, count(*) OVER (PARTITION BY commit_oid, to_path) AS t FROM p)
    SELECT commit_oid, blob_oid, from_path, to_path, CASE WHEN f > 1 AND t > 1 THEN 'many_both' WHEN f > 1 THEN 'many_from' WHEN t > 1 THEN 'many_to' ELSE 'unique' END AS ambiguity FROM n""", "content"))
def q25_exact_renames(m: Model) -> DataFrame:
    return history.exact_renames(m.content_change)


@query(sql(""", s AS (SELECT *, string_split(text, chr(10)) AS ls FROM rewrite), ok AS (SELECT commit_oid FROM rewrite GROUP BY commit_oid HAVING count(*) FILTER (change_kind = 'deleted') BETWEEN 1 AND 64 AND count(*) FILTER (change_kind = 'added') BETWEEN 1 AND 64 AND count(*) FILTER (change_kind = 'deleted') * count(*) FILTER (change_kind = 'added') <= 256), u AS (SELECT * FROM s JOIN ok USING (commit_oid) WHERE len(ls) BETWEEN 3 AND 50000 AND octet_length(encode(text)) <= 1048576 AND NOT contains(text, chr(0))),
    p AS (SELECT d.commit_oid, d.path AS from_path, a.path AS to_path, d.ls AS l1, a.ls AS l2 FROM u d JOIN u a ON d.commit_oid = a.commit_oid AND d.change_kind = 'deleted' AND a.change_kind = 'added' AND d.blob_oid <> a.blob_oid AND 8 * least(len(d.ls), len(a.ls)) >= 7 * greatest(len(d.ls), len(a.ls))),
    c1 AS (SELECT commit_oid, from_path, to_path, line, count(*) AS c FROM (SELECT commit_oid, from_path, to_path, unnest(l1) AS line FROM p) GROUP BY ALL), c2 AS (SELECT commit_oid, from_path, to_path, line, count(*) AS c FROM (SELECT commit_oid, from_path, to_path, unnest(l2) AS line FROM p) GROUP BY ALL),
    k AS (SELECT commit_oid, from_path, to_path, sum(least(c1.c, c2.c))::BIGINT AS numerator FROM c1 JOIN c2 USING (commit_oid, from_path, to_path, line) GROUP BY ALL),
    r AS (SELECT k.*, greatest(len(l1), len(l2))::BIGINT AS denominator FROM k JOIN p USING (commit_oid, from_path, to_path) WHERE 8 * numerator >= 7 * greatest(len(l1), len(l2))),
    n AS (SELECT *, count(*) OVER (PARTITION BY commit_oid, from_path) AS f, count(*) OVER (PARTITION BY commit_oid, to_path) AS t FROM r)
    SELECT commit_oid, from_path, to_path, numerator, denominator, CASE WHEN f > 1 AND t > 1 THEN 'many_both' WHEN f > 1 THEN 'many_from' WHEN t > 1 THEN 'many_to' ELSE 'unique' END AS ambiguity FROM n""", "rewrite"))
def q26_similar_renames(m: Model) -> DataFrame:
    """Documents that come back with another first line."""
    change = m.rewrite.select("commit_oid", "path", "change_kind", F.when(F.col("change_kind") == "added", F.col("blob_oid")).alias("blob_oid"), F.when(F.col("change_kind") == "deleted", F.col("blob_oid")).alias("prev_blob_oid"))
    return history.similar_renames(change, m.rewrite.select("blob_oid", F.col("text").alias("content")))[0]


@query(sql(""", t AS (SELECT commit_oid, count(*) FILTER (change_kind = 'deleted') AS deletions, count(*) FILTER (change_kind = 'added') AS additions FROM content GROUP BY commit_oid)
    SELECT *, CASE WHEN deletions > 64 OR additions > 64 OR deletions * additions > 256 THEN 0 ELSE deletions * additions END AS pairs_considered, CASE WHEN deletions = 0 OR additions = 0 THEN 'complete' WHEN deletions > 64 OR additions > 64 OR deletions * additions > 256 THEN 'refused_bound' ELSE 'complete' END AS completeness FROM t""", "content"))
def q18_rename_analysis(m: Model) -> DataFrame:
    return history.similar_renames(m.content_change, m.blob)[1]


TREE = "(SELECT p_name AS path, sha256(min(p_brand)) AS blob, min(p_size) AS mode FROM part WHERE p_partkey % 7 <> {} GROUP BY p_name)"


@query(f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.blob IS NULL THEN 'added' WHEN b.blob IS NULL THEN 'deleted' WHEN a.blob <> b.blob THEN 'modified' ELSE 'mode_changed' END AS change_kind, a.blob AS prev_blob_oid, b.blob AS blob_oid
    FROM {TREE.format(1)} a FULL JOIN {TREE.format(2)} b ON a.path = b.path WHERE a.blob IS DISTINCT FROM b.blob OR a.mode IS DISTINCT FROM b.mode""")
def q24_tree_diff(m: Model) -> DataFrame:
    tree = lambda k: m.raw("part").where(f"p_partkey % 7 != {k}").groupBy(F.col("p_name").alias("path")).agg(F.sha2(F.min("p_brand"), 256).alias("blob_oid"), F.min("p_size").alias("mode"))
    return history.tree_diff(tree(1), tree(2))


# --- coverage --------------------------------------------------------------------------

INNER = """, h AS (SELECT file, line, symbol, end_line - start_line AS size FROM (SELECT DISTINCT file, line FROM line) JOIN span USING (file) WHERE line BETWEEN start_line AND end_line),
    b AS (SELECT file, line, symbol FROM (SELECT *, rank() OVER (PARTITION BY file, line ORDER BY size) AS k FROM h) WHERE k = 1 QUALIFY count(*) OVER (PARTITION BY file, line) = 1)"""


@query(sql(INNER + " SELECT file, line.line, hits, symbol FROM line LEFT JOIN b ON line.file = b.file AND line.line = b.line".replace("SELECT file,", "SELECT line.file,"), "span", "line"))
def a9_innermost_symbol(m: Model) -> DataFrame:
    return coverage.innermost(m.line, m.span)


@query(sql("SELECT file, line, max(hits) AS hits FROM line GROUP BY ALL", "line"))
def a10_merge_hits(m: Model) -> DataFrame:
    return coverage.merge_hits(m.line)


@query(sql(INNER + """, g AS (SELECT file, line, max(hits) AS hits FROM line GROUP BY ALL), t AS (SELECT g.file, symbol, count(*) AS instrumented, count(*) FILTER (hits > 0) AS covered, min(g.line) FILTER (hits > 0) AS first_covered, max(g.line) FILTER (hits > 0) AS last_covered FROM g JOIN b ON g.file = b.file AND g.line = b.line GROUP BY ALL)
    SELECT *, CASE WHEN covered = 0 THEN NULL WHEN covered = instrumented THEN 'covered' ELSE 'partial' END AS degree FROM t""", "span", "line"))
def a11_symbol_tallies(m: Model) -> DataFrame:
    return coverage.symbol_tallies(coverage.merge_hits(m.line), m.span)


GAPS = """WITH w AS (SELECT l_partkey, l_suppkey AS run_id, count(*) AS i, count(*) FILTER (l_quantity >= 49) AS c FROM lineitem GROUP BY ALL),
    best AS (SELECT *, CASE WHEN c = i THEN 'covered' ELSE 'partial' END AS degree FROM w WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN c = i THEN 'covered' ELSE 'partial' END, c DESC, run_id) = 1),
    g AS (SELECT p_partkey AS symbol, p_brand || '/' || p_size AS file, p_size AS start_line, degree, c AS covered_lines, run_id, CASE WHEN degree IS NOT NULL THEN degree WHEN p_brand || '/' || p_size IN (SELECT p_brand || '/' || p_size FROM w JOIN part ON l_partkey = p_partkey JOIN supplier ON run_id = s_suppkey WHERE s_nationkey < 2) THEN 'uncovered' ELSE 'unmeasured' END AS state FROM part LEFT JOIN best ON p_partkey = l_partkey)"""


def gaps_of(m: Model) -> DataFrame:
    """A run a supplier; a line is covered where the quantity is 49 or more; files are measured by the runs of two nations."""
    runs = m.raw("lineitem").groupBy(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("run_id")).agg(F.count("*").alias("i"), F.count_if(F.col("l_quantity") >= 49).alias("covered_lines"))
    made = runs.where("covered_lines > 0").select("symbol", "run_id", "covered_lines", F.when(F.col("covered_lines") == F.col("i"), "covered").otherwise("partial").alias("degree"), F.lit(0).alias("observation_id"))
    symbols = m.raw("part").select(F.col("p_partkey").alias("symbol"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("file"), F.col("p_size").alias("start_line"))
    by = m.raw("supplier").where("s_nationkey < 2").select(F.col("s_suppkey").alias("run_id"))
    return coverage.gaps(symbols, made, runs.join(by, "run_id", "left_semi").join(symbols, "symbol").select("file"))


@query(GAPS + " SELECT symbol, file, degree, covered_lines, run_id, state FROM g")
def q7_gaps(m: Model) -> DataFrame:
    return gaps_of(m).drop("start_line")


@query(GAPS + " SELECT count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'uncovered') AS uncovered, count(*) FILTER (state = 'unmeasured') AS unmeasured FROM g")
def a8_gap_totals(m: Model) -> DataFrame:
    return coverage.gap_totals(gaps_of(m))


@query("""SELECT l_suppkey AS caller, l_partkey AS callee, sum(c)::BIGINT AS "count", count(*) AS runs FROM (SELECT l_suppkey, l_partkey, l_returnflag, max(l_linenumber) AS c FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def a24_trace_merge(m: Model) -> DataFrame:
    """Runs by return flag: each once, however often the artifact comes in."""
    rows = m.raw("lineitem").groupBy(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_returnflag").alias("run_id")).agg(F.max("l_linenumber").cast("long").alias("count"))
    site = rows.select("caller", "callee", F.lit("f").alias("file"), F.lit(1).alias("line"), "run_id", F.lit("a").alias("artifact"), "count", F.lit(0).alias("completion"), F.lit(1).alias("binding"), F.array(F.col("run_id")).alias("tests"))
    return coverage.merge_traces(site, site.where("caller % 2 = 0")).select("caller", "callee", "count", F.size("runs").cast("long").alias("runs"))


# --- notes and links -------------------------------------------------------------------


@query(sql("SELECT memory_id, max_by(to_status, event_id) AS status FROM transition GROUP BY memory_id", "transition"))
def q32_note_status(m: Model) -> DataFrame:
    return memory.replay(m.transition)[0]


@query(sql(""", b AS (SELECT *, lag(to_status) OVER (PARTITION BY memory_id ORDER BY event_id) AS from_status FROM transition)
    SELECT memory_id, event_id, from_status, to_status FROM b WHERE NOT ((from_status IS NULL AND to_status = 'proposed') OR (from_status = 'proposed' AND to_status IN ('active', 'invalidated')) OR (from_status = 'active' AND to_status IN ('superseded', 'invalidated')) ) OR (from_status IN ('superseded', 'invalidated'))""", "transition"))
def n8_illegal_transitions(m: Model) -> DataFrame:
    return memory.replay(m.transition)[1].select("memory_id", "event_id", "from_status", "to_status")


VIEWS = """SELECT memory_id, status = 'active' AND (count(*) FILTER (status = 'active') OVER w) > 1 AS multiple_active, status = 'active' AND coalesce((min(claim_key) FILTER (status = 'active') OVER w) <> (max(claim_key) FILTER (status = 'active') OVER w), false) AS conflicted
    FROM (SELECT s_suppkey AS memory_id, s_nationkey AS subject, 'repo' AS scope, CASE WHEN s_suppkey % 3 = 0 THEN 'proposed' ELSE 'active' END AS status, CASE WHEN s_acctbal > 0 THEN 'positive' ELSE 'negative' END AS claim_key FROM supplier) WINDOW w AS (PARTITION BY subject, scope)"""


@query(VIEWS)
def a15_note_views(m: Model) -> DataFrame:
    rows = m.raw("supplier").select(F.col("s_suppkey").alias("memory_id"), F.col("s_nationkey").alias("subject"), F.lit("repo").alias("scope"), F.when(F.col("s_suppkey") % 3 == 0, "proposed").otherwise("active").alias("status"), F.when(F.col("s_acctbal") > 0, "positive").otherwise("negative").alias("claim_key"))
    return memory.views(rows).select("memory_id", "multiple_active", "conflicted")


@query("""WITH p AS (SELECT o_orderkey AS memory_id, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT * FROM p""")
def q33_superseded_by(m: Model) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return memory.superseded_by(m.raw("orders").select(F.col("o_orderkey").alias("memory_id"), before.alias("supersedes"))).select("memory_id", "superseded_by")


LINKS = """WITH l AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS link_id, l_suppkey AS registry_id, l_orderkey::VARCHAR AS source_path, l_partkey::VARCHAR AS target_path, l_returnflag AS source_hash, l_linestatus AS target_hash, CASE WHEN l_quantity > 45 THEN 'withdrawn' ELSE 'active' END AS status FROM lineitem)"""


@query(LINKS + """, r AS (SELECT s_suppkey AS registry_id, CASE WHEN s_nationkey % 4 = 0 THEN 'moved' ELSE 'available' END AS availability FROM supplier WHERE s_suppkey % 10 > 0)
    SELECT freshness, count(*) AS n FROM (SELECT CASE WHEN availability IS NULL THEN 'unregistered' WHEN availability <> 'available' THEN 'target_unavailable' WHEN status = 'withdrawn' THEN 'withdrawn' WHEN o_orderkey IS NULL THEN 'source_missing' WHEN p_partkey IS NULL THEN 'target_partially_indexed'
        WHEN source_hash <> 'N' AND target_hash <> 'O' THEN 'both_changed' WHEN source_hash <> 'N' THEN 'source_changed' WHEN target_hash <> 'O' THEN 'target_changed' ELSE 'fresh' END AS freshness
        FROM l LEFT JOIN r USING (registry_id) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON source_path = o_orderkey::VARCHAR LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON target_path = p_partkey::VARCHAR) GROUP BY freshness""")
def q31_link_freshness(m: Model) -> DataFrame:
    li = m.raw("lineitem")
    text = lambda c: F.col(c).cast("string")
    link = li.select(F.concat_ws("-", text("l_orderkey"), text("l_partkey"), text("l_linenumber")).alias("link_id"), F.col("l_suppkey").alias("registry_id"), text("l_orderkey").alias("source_path"), text("l_partkey").alias("target_path"), F.col("l_returnflag").alias("source_hash"), F.col("l_linestatus").alias("target_hash"), F.when(F.col("l_quantity") > 45, "withdrawn").otherwise("active").alias("status"))
    registry = m.raw("supplier").where("s_suppkey % 10 > 0").select(F.col("s_suppkey").alias("registry_id"), F.when(F.col("s_nationkey") % 4 == 0, "moved").otherwise("available").alias("availability"))
    source = m.raw("orders").where("o_orderstatus != 'P'").select(text("o_orderkey").alias("path"), F.lit("N").alias("hash"))
    target = m.raw("part").where("p_size > 10").select(text("p_partkey").alias("path"), F.lit("O").alias("hash"))
    target = link.select("registry_id", F.col("target_path").alias("path")).distinct().join(target, "path")
    return memory.link_freshness(link, registry, source, target).groupBy("freshness").agg(F.count("*").alias("n"))


# --- incremental -----------------------------------------------------------------------


@query("""WITH a AS (SELECT c_custkey AS path, c_mktsegment AS h FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_mktsegment END AS h FROM customer WHERE c_custkey % 13 <> 0)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def u3_classify_changes(m: Model) -> DataFrame:
    c = m.raw("customer")
    new = c.where("c_custkey % 13 != 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(F.col("c_mktsegment")).alias("h"))
    return incremental.classify(c.where("c_custkey % 11 != 0").select("c_custkey", "c_mktsegment"), new)


@query(sql(", r(path) AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT src FROM r JOIN edge ON dst = path) SELECT path FROM r", "edge", recursive=True))
def q34_invalidation(m: Model) -> DataFrame:
    changes = m.raw("customer").select(F.col("c_custkey").alias("path"), F.when(F.col("c_nationkey") == 3, "modified").otherwise("unchanged").alias("change"))
    return incremental.invalidated(changes, m.edge)


@query("""WITH RECURSIVE a AS (SELECT 'a' || p_partkey // 4 AS path, p_partkey // 40 || '-' || p_size % 5 AS symbol FROM part), b AS (SELECT 'b' || p_partkey // 40 || '/' || (p_partkey * 7 % 40) // 4 AS path, p_partkey // 40 || '-' || p_size % 5 AS symbol FROM part),
    x AS (SELECT path, symbol, count(*) AS c FROM a GROUP BY ALL), y AS (SELECT path, symbol, count(*) AS c FROM b GROUP BY ALL),
    k AS (SELECT *, greatest((SELECT count(*) FROM a WHERE path = from_path), (SELECT count(*) FROM b WHERE path = to_path)) AS larger FROM (SELECT x.path AS from_path, y.path AS to_path, sum(least(x.c, y.c))::BIGINT AS matched FROM x JOIN y USING (symbol) GROUP BY ALL)),
    p AS (SELECT *, dense_rank() OVER (ORDER BY from_path) AS i FROM k WHERE 2 * matched >= larger),
    r(i, claimed, pick) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR UNION ALL SELECT i, CASE WHEN pick IS NULL THEN claimed ELSE claimed || [pick] END, pick FROM (SELECT r.i + 1 AS i, claimed, (SELECT CASE WHEN count(*) = 1 THEN min(to_path) END FROM (SELECT to_path, rank() OVER (ORDER BY matched DESC, larger) AS k FROM p WHERE p.i = r.i + 1 AND NOT list_contains(r.claimed, to_path)) WHERE k = 1) AS pick FROM r WHERE r.i < (SELECT max(i) FROM p)))
    SELECT from_path, to_path, matched, larger FROM r JOIN p ON p.i = r.i AND to_path = pick""")
def q35_move_proposals(m: Model) -> DataFrame:
    """Blocks of parts as files before and after a reorganisation: with ties and with paths that several want."""
    p = m.raw("part")
    block, k = F.floor(F.col("p_partkey") / 40).cast("string"), F.col("p_partkey")
    text = lambda c: F.floor(c).cast("string")
    symbol = F.concat_ws("-", block, F.col("p_size") % 5)
    return incremental.move_proposals(p.select(F.concat(F.lit("a"), text(k / 4)).alias("path"), symbol.alias("symbol")), p.select(F.concat(F.lit("b"), block, F.lit("/"), text(k * 7 % 40 / 4)).alias("path"), symbol.alias("symbol")))


@query("""WITH p AS (SELECT r_name || '/' || n_name || '/' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT DISTINCT 'repository' AS parent, split_part(path, '/', 1) AS child, 'directory' AS kind FROM p UNION SELECT split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'directory' FROM p UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path, 'file' FROM p""")
def q43_filesystem_graph(m: Model) -> DataFrame:
    rows = m.raw("customer").join(m.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(m.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return incremental.filesystem_graph(rows.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path")))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages), d AS (SELECT page_id, h FROM l UNION ALL SELECT page_id, '#top' FROM pages UNION ALL SELECT page_id, '../' || page_id FROM pages UNION ALL SELECT page_id, 'https://x.y/' || page_id FROM pages),
    k AS (SELECT DISTINCT ltrim(h, '/') AS path FROM l WHERE page_id % 2 = 0)
    SELECT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' WHEN starts_with(h, '#') THEN 'fragment' WHEN starts_with(h, '//') THEN 'external' WHEN regexp_matches(h, '(^|/)\\.\\.(/|$)') THEN 'refused' WHEN regexp_replace(regexp_replace(h, '[#?].*$', ''), '^/', '') IN (SELECT path FROM k) THEN 'file' ELSE 'not_indexed' END AS outcome, count(*) AS n FROM d GROUP BY ALL""")
def q41_link_outcomes(m: Model) -> DataFrame:
    """The links of all pages and three more of each; the paths that even pages link to are known."""
    page = m.raw("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("destination"))
    k = F.col("page_id").cast("string")
    more = m.raw("pages").select("page_id", F.explode(F.array(F.lit("#top"), F.concat(F.lit("../"), k), F.concat(F.lit("https://x.y/"), k))).alias("destination"))
    return markdown.link_outcomes(page.union(more), page.where("page_id % 2 = 0").select(F.col("destination").alias("path"))).groupBy("page_id", "outcome").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def s0_streaming_ingest(m: Model) -> DataFrame:
    """The same totals through a stream of micro-batches."""
    return ingest.totals(m.spark, f"{m.dir}/events.parquet")


@query("""SELECT user_id AS test, count(*) AS records, sum(k)::BIGINT AS hits FROM (SELECT user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id""")
def s10_ndjson_records(m: Model) -> DataFrame:
    lines = m.raw("events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("test_id"), F.get_json_object("props", "$.k").try_cast("long").alias("count"))).alias("value"))
    rows = traces.parse_records(lines)
    return rows.groupBy(F.col("test_id").cast("long").alias("test")).agg(F.count("*").alias("records"), F.sum("count").alias("hits"))


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def n4_latest_by_key(m: Model) -> DataFrame:
    return first_by(m.raw("events"), ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}', {i})" for k, xs in vocab.VOCABULARIES.items() for i, x in enumerate(xs)) + ") t(vocabulary, member, ordinal)")
def v0_vocabularies(m: Model) -> DataFrame:
    return vocab.table(m.spark)


# --- further inventory rows ----------------------------------------------------------------


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 7 = 0 THEN 'unusable' WHEN s = 0 THEN 'no_index' WHEN n_nationkey % 5 = 0 THEN 'unverified' WHEN c % 3 = 0 THEN 'stale' WHEN s % 2 = 0 THEN 'unverified' ELSE 'current' END AS trust
    FROM (SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation)""")
def q13_trust(m: Model) -> DataFrame:
    s = m.raw("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    c = m.raw("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    rows = m.raw("nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").withColumns({"s": F.coalesce("s", F.lit(0)), "c": F.coalesce("c", F.lit(0))})
    k = F.col("n_nationkey")
    tallies = rows.select("n_name", (k % 7 != 0).alias("schema_ok"), F.col("s").alias("runs"), (k % 5 == 0).cast("int").alias("running"), (F.col("c") % 3 == 0).cast("int").alias("changed"), F.lit(0).alias("missing"), F.lit(0).alias("added"), (F.col("s") % 2 == 0).alias("truncated"), F.lit(0).alias("refused"), F.lit(0).alias("unreadable"))
    return lookup.trust(tallies).select(F.col("n_name").alias("name"), "trust")


@query("""SELECT s_suppkey AS registry_id, CASE WHEN s_suppkey % 11 = 0 THEN 'tombstoned' WHEN s_acctbal < 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'refused' WHEN s_nationkey % 3 = 0 THEN 'moved' WHEN s_nationkey % 3 = 1 AND s_suppkey % 2 = 0 THEN 'partially_indexed' ELSE 'available' END AS availability FROM supplier""")
def q29_availability(m: Model) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = m.raw("supplier").select(k.alias("registry_id"), F.when(k % 11 == 0, "tombstoned").otherwise("active").alias("status"), (F.col("s_acctbal") >= 0).alias("path_exists"), (k % 7 != 0).alias("readable"), F.lit("r").alias("repo_id"), F.when(n % 3 != 0, "r").alias("repo_id_now"), F.when(~((n % 3 == 1) & (k % 2 == 0)), "s").alias("indexed_state"))
    return memory.availability(rows).select("registry_id", "availability")


@query("""SELECT l_suppkey AS source_path, l_partkey AS specifier, count(*) AS n, CASE WHEN count(DISTINCT l_linenumber) > 1 THEN 'many_targets' WHEN count(*) > 1 THEN 'repeated' ELSE 'unique' END AS ambiguity FROM lineitem GROUP BY ALL""")
def a17_contract_ambiguity(m: Model) -> DataFrame:
    rows = m.raw("lineitem").select(F.col("l_suppkey").alias("source_path"), F.col("l_partkey").alias("specifier"), F.col("l_linenumber").alias("target_path"))
    return memory.contract_ambiguity(rows).groupBy("source_path", "specifier", "ambiguity").agg(F.count("*").alias("n"))


@query(sql("""SELECT DISTINCT e AS entity_id FROM (SELECT source_id AS e FROM assertion WHERE assertion_id NOT IN (SELECT assertion_id FROM observation) UNION SELECT target_id FROM assertion WHERE assertion_id NOT IN (SELECT assertion_id FROM observation))""", "assertion", "observation"))
def u1_doomed_endpoints(m: Model) -> DataFrame:
    doomed = m.assertion.join(m.observation.select("assertion_id"), "assertion_id", "left_anti")
    return doomed.select(F.col("source_id").alias("entity_id")).union(doomed.select("target_id")).distinct()


@query("""SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'typescript' WHEN 4 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'markdown' END AS language FROM events""")
def s5_language_dispatch(m: Model) -> DataFrame:
    ext = F.get(F.array(*[F.lit(x) for x in (".ts", ".PY", ".md", ".txt", ".tsx", "")]), (F.col("user_id") % 6).cast("int"))
    return m.raw("events").select("event_id", S.language(F.concat(F.lit("d.d/"), "event_type", ext)).alias("language"))


@query("""SELECT count(*) FILTER (user_id % 4 IN (0, 2)) AS denied, count(*) FILTER (user_id % 4 IN (1, 3)) AS readable FROM events""")
def s4_secret_names(m: Model) -> DataFrame:
    name = F.get(F.array(F.lit(".env.local"), F.lit("env.local"), F.lit("server.key"), F.lit("keys")), (F.col("user_id") % 4).cast("int"))
    return m.raw("events").select(S.is_secret(F.concat(F.lit("conf/"), name)).alias("s")).agg(F.count_if("s").alias("denied"), F.count_if(~F.col("s")).alias("readable"))


@query("""WITH l AS (SELECT DISTINCT 'n' || c_nationkey AS module, c_mktsegment AS name FROM customer WHERE c_nationkey % 4 > 0), s AS (SELECT 'r' || n_regionkey AS module, name, min_by(module, n_nationkey) AS origin FROM l JOIN nation ON module = 'n' || n_nationkey GROUP BY ALL)
    SELECT module, name, module AS origin_module, name AS origin_name FROM l UNION ALL SELECT module, name, origin, name FROM s UNION ALL
    SELECT 'k' || n_nationkey, 'first', 'n' || n_nationkey, 'BUILDING' FROM nation WHERE 'n' || n_nationkey IN (SELECT module FROM l WHERE name = 'BUILDING') UNION ALL
    SELECT 'k' || n_nationkey, name, s.origin, name FROM nation JOIN s ON s.module = 'r' || n_regionkey""")
def q36_export_closure(m: Model) -> DataFrame:
    """Nations' modules export segments, regions forward their nations; a third kind renames one name and forwards its region."""
    n, key = m.raw("nation"), lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    local = m.raw("customer").where("c_nationkey % 4 > 0").select(key("n", "c_nationkey").alias("module"), F.col("c_mktsegment").alias("name")).distinct()
    star = n.select(key("r", "n_regionkey").alias("module"), F.col("n_nationkey").alias("position"), key("n", "n_nationkey").alias("target")).union(n.select(key("k", "n_nationkey"), F.lit(0), key("r", "n_regionkey")))
    named = n.select(key("k", "n_nationkey").alias("module"), F.lit("first").alias("name"), key("n", "n_nationkey").alias("target"), F.lit("BUILDING").alias("target_name"))
    return incremental.export_closure(local, named, star).select("module", "name", "origin_module", "origin_name")


@query("""SELECT importer, specifier, CASE WHEN p_partkey % 3 = 0 THEN 'd/x' || p_partkey || '.ts' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'x' || p_partkey || '/index.js' END AS target,
    CASE WHEN p_partkey % 5 = 4 AND p_partkey % 3 = 2 THEN 'not_relative' WHEN p_partkey % 3 = 2 THEN 'climbs_above_root' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 1 THEN 'not_indexed' END AS reason
    FROM (SELECT p_partkey, 'd/a.ts' AS importer, CASE p_partkey % 3 WHEN 0 THEN './x' || p_partkey WHEN 1 THEN '../x' || p_partkey ELSE CASE WHEN p_partkey % 5 = 4 THEN 'x' || p_partkey ELSE '../../x' || p_partkey END END AS specifier FROM part)""")
def q44_import_resolution(m: Model) -> DataFrame:
    k, name = F.col("p_partkey"), F.concat(F.lit("x"), F.col("p_partkey").cast("string"))
    spec = F.when(k % 3 == 0, F.concat(F.lit("./"), name)).when(k % 3 == 1, F.concat(F.lit("../"), name)).when(k % 5 == 4, name).otherwise(F.concat(F.lit("../../"), name))
    imports = m.raw("part").select(F.lit("d/a.ts").alias("importer"), spec.alias("specifier"))
    paths = m.raw("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("d/"), name, F.lit(".ts")).alias("path")).union(m.raw("part").where("p_partkey % 3 = 1 AND p_partkey % 2 = 0").select(F.concat(name, F.lit("/index.js"))))
    return incremental.resolve_imports(imports, paths)


@query(sql("""SELECT e.entity_id, e.kind, e.name, count(*) FILTER (a.source_id = e.entity_id) AS outgoing, count(*) FILTER (a.target_id = e.entity_id) AS incoming FROM entity e LEFT JOIN (SELECT source_id AS id, source_id, NULL AS target_id FROM assertion UNION ALL SELECT target_id, NULL, target_id FROM assertion) a ON a.id = e.entity_id GROUP BY ALL""", "entity", "assertion"))
def q10_entity_cards(m: Model) -> DataFrame:
    n = lookup.relation_counts(m.assertion).groupBy("entity_id").agg(F.sum(F.when(F.col("side") == "outgoing", F.col("n")).otherwise(0)).alias("outgoing"), F.sum(F.when(F.col("side") == "incoming", F.col("n")).otherwise(0)).alias("incoming"))
    rows = m.entity.join(n, "entity_id", "left")
    return rows.select("entity_id", "kind", "name", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))
