"""More named queries: writes, inspection, histories, notes and sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import claims, coverage, graph, history, incremental, lookup, memory, registry
from ..sources import adr, files, manifests, markdown, python_code, traces
from .adapters import Model, sql
from .queries import ALL_DOWN, EVIDENCE, GAPS, STATE, gaps_of, query

text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")


# --- writes ----------------------------------------------------------------------------


@query("""WITH o AS (SELECT c_custkey AS k, c_nationkey AS state, 1 AS t FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k, c_nationkey + 100 AS state, c_custkey % 4 AS t FROM customer WHERE c_custkey % 3 = 0)
    SELECT k, arg_max(state, t * 2 + fresh)::BIGINT AS state FROM (SELECT k, state, t, 0 AS fresh FROM o UNION ALL SELECT k, state, t, 1 FROM n) GROUP BY k""")
def w2_latest_state(m: Model) -> DataFrame:
    """Rows of a key replace one another by their time; of equal times the new one stays."""
    c = m.raw("customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("state"), F.lit(1).cast("long").alias("at"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_nationkey") + 100).cast("long"), (F.col("c_custkey") % 4).cast("long")).toDF("k", "state", "at")
    return claims.latest_wins(old, new, ["k"], "at").select("k", "state")


@query("""SELECT c_custkey AS left_id, c_nationkey AS right_id, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS method FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def w4_identity_links(m: Model) -> DataFrame:
    c = m.raw("customer").select(F.col("c_custkey").alias("left_id"), F.col("c_nationkey").alias("right_id"))
    return claims.insert_ignore(c.where("left_id % 2 = 0").withColumn("method", F.lit("old")), c.where("left_id % 3 = 0").withColumn("method", F.lit("new")), ["left_id", "right_id"])


PLACES = ("occurrence", "observation")
NATION3 = "(SELECT 'supp/' || s_suppkey FROM supplier WHERE s_nationkey = 3)"


@query(sql(f"SELECT 'observation' AS \"table\", count(*) AS n FROM observation WHERE file_path NOT IN {NATION3} UNION ALL SELECT 'occurrence', count(*) FROM occurrence WHERE file_path NOT IN {NATION3}", *PLACES))
def w5_delete_file_rows(m: Model) -> DataFrame:
    paths = m.raw("supplier").where("s_nationkey = 3").select(F.concat(F.lit("supp/"), text("s_suppkey")).alias("file_path"))
    out, _ = claims.delete_paths({"observation": m.observation, "occurrence": m.occurrence}, paths)
    return claims.dump_counters(out).withColumnRenamed("rows", "n")


@query(sql("""SELECT count(*) AS observations, count(DISTINCT assertion_id) AS assertions FROM observation WHERE NOT (extractor_id = 'lines' AND assertion_id IN (SELECT assertion_id FROM assertion WHERE source_id IN (SELECT entity_id FROM occurrence WHERE file_path = 'supp/5')))""", "assertion", *PLACES))
def w7_withdraw_claims(m: Model) -> DataFrame:
    out, _ = claims.withdraw_claims({"observation": m.observation, "occurrence": m.occurrence, "assertion": m.assertion}, "supp/5", "lines")
    return out["observation"].agg(F.count("*").alias("observations"), F.count_distinct("assertion_id").alias("assertions"))


@query(sql("""SELECT source_type, count(*) AS n FROM observation WHERE NOT (start_line = 2 AND source_type = 1) GROUP BY source_type""", "observation"))
def w8_delete_evidence(m: Model) -> DataFrame:
    keys = m.observation.where("start_line = 2 AND source_type = 1").select(*claims.EVIDENCE_KEY)
    return claims.delete_evidence(m.observation, keys).groupBy("source_type").agg(F.count("*").alias("n"))


CONTAINED = "SELECT assertion_id, relation, target_id FROM assertion WHERE relation IN ('CONTAINS', 'DEFINES')"


@query(sql(f"SELECT relation, count(*) AS n FROM ({CONTAINED}) WHERE NOT (relation = 'CONTAINS' AND target_id IN (SELECT entity_id FROM entity WHERE kind = 'directory')) GROUP BY relation", "assertion", "entity"))
def w9_delete_directory_containment(m: Model) -> DataFrame:
    rows = m.assertion.where("relation IN ('CONTAINS', 'DEFINES')")
    out = claims.delete_directory_containment({"entity": m.entity, "assertion": m.assertion, "observation": rows.select("assertion_id", "relation")})
    return out["observation"].groupBy("relation").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS file_path, CASE WHEN s_suppkey % 7 = 0 THEN 'gone' WHEN s_suppkey % 3 = 0 THEN 'new' WHEN s_nationkey % 2 = 0 AND s_suppkey % 5 > 0 THEN 'usable' ELSE 'stale' END AS fate FROM supplier""")
def w12_module_facts(m: Model) -> DataFrame:
    """A cache of facts: some extracted anew, some deleted, and which of the others still hold."""
    s = m.raw("supplier").select(F.col("s_suppkey").alias("file_path"), F.col("s_nationkey"))
    facts = s.select("file_path", (F.col("s_nationkey") % 2).alias("content_hash"), F.when(F.col("file_path") % 5 > 0, "2").otherwise("1").alias("version"))
    new = facts.where("file_path % 3 = 0 AND file_path % 7 != 0").withColumn("version", F.lit("new"))
    cache = claims.store_facts(facts, new, s.where("file_path % 7 = 0"))
    now = s.select("file_path", F.lit(0).cast("int").alias("content_hash"))
    good = claims.usable_facts(cache, now.withColumn("content_hash", F.col("content_hash").cast(facts.schema["content_hash"].dataType)), "2").select("file_path", F.lit(True).alias("good"))
    rows = s.join(cache, "file_path", "left").join(good, "file_path", "left")
    return rows.select("file_path", F.when(F.col("version").isNull(), "gone").when(F.col("version") == "new", "new").when(F.col("good"), "usable").otherwise("stale").alias("fate"))


@query(sql("""SELECT 'commit' AS "table", count(*) AS n FROM commits UNION ALL SELECT 'change', count(*) FROM change UNION ALL SELECT 'ingest', count(DISTINCT o_custkey) FROM commits UNION ALL SELECT 'latest', sum(t)::BIGINT FROM (SELECT max(committer_time) AS t FROM commits GROUP BY o_custkey)""", "commits", "change"))
def w13_history_writes(m: Model) -> DataFrame:
    """Two overlapping parts of a history, written one after the other, give the whole of it."""
    part = lambda df, c, k: df.where(F.pmod(F.xxhash64(c), F.lit(4)).isin(k))
    ingest = m.commit_owner.groupBy(F.col("o_custkey").alias("repo_id"), F.pmod("o_orderkey", F.lit(2)).alias("run")).agg(F.max("committer_time").alias("at"))
    a, b = [0, 1, 2], [2, 3]
    old = {"commit": part(m.commit, "commit_oid", a), "change": part(m.change, "path", a), "ingest": ingest.where("run = 0").drop("run")}
    out = history.write_history(old, {"commit": part(m.commit, "commit_oid", b), "change": part(m.change, "path", b), "ingest": ingest.where("run = 1").drop("run")}, "at")
    latest = out["ingest"].agg(F.sum("at").alias("n")).select(F.lit("latest").alias("table"), "n")
    return claims.dump_counters({k: out[k] for k in ("commit", "change", "ingest")}).withColumnRenamed("rows", "n").union(latest)


@query("""SELECT s_suppkey AS registry_id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 = 0 THEN 'elsewhere' ELSE s_name END AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'tombstoned' ELSE 'active' END AS status FROM supplier""")
def w14_registry_writes(m: Model) -> DataFrame:
    """Insert (known ids stay), relocate, tombstone; the latter two only of active entries."""
    s = m.raw("supplier").select(F.col("s_suppkey").alias("registry_id"), F.col("s_name").alias("path"))
    reg = registry.insert(s.where("registry_id % 2 = 0").withColumn("status", F.lit("active")), s.withColumn("path", F.when(F.col("registry_id") % 2 == 0, "ignored").otherwise(F.col("path"))))
    reg = registry.relocate(reg, reg.where("registry_id % 2 = 0 AND registry_id % 5 = 0"), "elsewhere")
    reg = registry.tombstone(reg, reg.where("registry_id % 3 = 0"))
    return registry.relocate(reg, reg.where("registry_id % 3 = 0"), "never")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS p FROM lineitem) SELECT r AS registry_id, CASE WHEN p % 3 = 0 THEN 'new' WHEN p % 2 = 0 THEN 'touched' ELSE 'old' END AS fate, CASE WHEN r = 7 THEN 'withdrawn' ELSE 'active' END AS status, count(*) AS n FROM l GROUP BY ALL""")
def w15_contract_links(m: Model) -> DataFrame:
    """A second scan: identities seen before move their time, new ones are inserted; one registry entry's links are withdrawn."""
    rows = m.raw("lineitem").select(F.col("l_suppkey").alias("registry_id"), text("l_partkey").alias("source_path")).distinct()
    rows = rows.select("registry_id", "source_path", F.lit("x").alias("specifier"), F.lit("t").alias("target_path"), F.lit("m").alias("method"))
    p = F.col("source_path").cast("long")
    link = rows.where(p % 3 != 0).withColumns({"link_id": F.xxhash64("registry_id", "source_path").cast("string"), "status": F.lit("active"), "last_seen_at": F.lit("t1")})
    out = registry.withdraw(registry.write_links(link, rows.where((p % 3 == 0) | (p % 2 == 0)), "t2"), registry_id=7)
    fate = F.when(p % 3 == 0, "new").when(F.col("last_seen_at") == "t2", "touched").otherwise("old")
    return out.groupBy("registry_id", fate.alias("fate"), "status").agg(F.count("*").alias("n"))


@query(sql("""SELECT count(*) AS events, count(*) FILTER (event_id = 1) AS confirmed, (SELECT count(*) FROM transition WHERE event_id = 0) AS citations FROM transition WHERE event_id < 2""", "transition"))
def w16_note_lifecycle(m: Model) -> DataFrame:
    """Notes are proposed, then confirmed; what may not follow is refused, and so are citations of unknown notes."""
    t = m.transition
    first = memory.append_events(t.limit(0), t.where("event_id = 0"))
    skipped = t.where("event_id = 0").withColumns({"event_id": F.lit(9).cast(t.schema["event_id"].dataType), "to_status": F.lit("superseded")})
    both = memory.append_events(memory.append_events(first, t.where("event_id = 1")), skipped.where("memory_id < 0"))
    cited = t.where("event_id = 0").select(text("memory_id").alias("citation_id"), "memory_id")
    known = memory.cite(cited.limit(0), cited.union(cited.select(F.concat(F.lit("x"), "citation_id"), -1 - F.col("memory_id"))), both)
    return both.agg(F.count("*").alias("events"), F.count_if(F.col("event_id") == 1).alias("confirmed")).join(known.agg(F.count("*").alias("citations")), F.lit(True))


@query("""SELECT '{"ok":true,"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS json FROM nation""")
def w19_json_rows(m: Model) -> DataFrame:
    return claims.envelope(m.raw("nation").select("n_name", "n_nationkey"))


# --- filters, joins, lookups -----------------------------------------------------------


@query(sql("""SELECT entity_id, name, coalesce(file_path || ':' || start_line, '-') AS location FROM entity LEFT JOIN (SELECT entity_id, file_path, start_line FROM occurrence QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY file_path, start_byte, end_byte, occurrence_id) = 1) USING (entity_id) WHERE kind = 'function'""", "entity", "occurrence"))
def k1_entity_list(m: Model) -> DataFrame:
    return lookup.entity_list(m.entity, m.occurrence, "function").select("entity_id", "name", "location")


@query(sql(f"SELECT relation, count(*) AS n FROM assertion LEFT JOIN {STATE} USING (assertion_id) WHERE relation IN ('REFERENCES', 'IMPLEMENTS') AND NOT coalesce(is_unresolved, false) GROUP BY relation", *EVIDENCE))
def f3_resolved_only(m: Model) -> DataFrame:
    """A claim without a state counts as resolved."""
    state = claims.derive_state(m.observation, m.assertion, m.entity)
    return graph.edges_of(m.assertion, state, ["REFERENCES", "IMPLEMENTS"], True).groupBy("relation").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'value' ELSE 'uncategorised' END AS category, CASE user_id % 5 WHEN 0 THEN 'partial' ELSE 'covered' END AS degree FROM events""")
def f10_tolerant_json(m: Model) -> DataFrame:
    metas = ['{"category":"module","degree":"partial"}', '{"category":"value","degree":"none"}', '{"category":"zzz"}', "no json {", None]
    meta = F.get(F.array(*[F.lit(x) for x in metas]), (F.col("user_id") % 5).cast("int"))
    return m.raw("events").select("event_id", S.category(meta).alias("category"), S.degree(meta).alias("degree"))


@query(sql("""SELECT entity_id, kind FROM entity WHERE entity_id IN (SELECT 'fn_' || l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT 'class_' || l_orderkey FROM lineitem WHERE l_quantity > 49)""", "entity"))
def f13_by_ids(m: Model) -> DataFrame:
    li = m.raw("lineitem").where("l_quantity > 49")
    ids = li.select(F.concat(F.lit("fn_"), text("l_partkey")).alias("entity_id")).union(li.select(F.concat(F.lit("class_"), text("l_orderkey"))))
    return lookup.by_ids(m.entity, ids).select("entity_id", "kind")


@query(sql("""SELECT assertion_id, file_path, start_line, 'state' || source_type % 3 AS state_id, source_type % 2 = 0 AS finished, CASE WHEN file_path IN (SELECT 'supp/' || s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) THEN 'fresh' ELSE 'stale' END AS freshness FROM assertion JOIN observation USING (assertion_id) WHERE target_id = 'fn_1'""", "assertion", "observation"))
def j4_explain_runs(m: Model) -> DataFrame:
    run = m.spark.range(12).select(F.col("id").alias("run_id"), F.concat(F.lit("state"), text(F.col("id") % 3)).alias("state_id"), F.when(F.col("id") % 2 == 0, "t").alias("finished_at"))
    fresh = m.raw("supplier").select(F.concat(F.lit("supp/"), text("s_suppkey")).alias("file_path"), F.when(F.col("s_nationkey") % 2 == 0, "fresh").otherwise("stale").alias("freshness"))
    rows = graph.explain(m.assertion, m.observation.withColumn("run_id", F.col("source_type").cast("long")), "fn_1").where("source_type IS NOT NULL")
    return graph.explain_runs(rows, run, fresh).select("assertion_id", "file_path", "start_line", "state_id", "finished", "freshness")


@query(sql(f"SELECT coalesce(status, 'none') AS status, count(*) AS n FROM assertion LEFT JOIN {STATE} USING (assertion_id) GROUP BY ALL", *EVIDENCE))
def j2_state_of_claims(m: Model) -> DataFrame:
    state = claims.derive_state(m.observation, m.assertion, m.entity)
    return m.assertion.join(state, "assertion_id", "left").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query(sql(""", r AS (SELECT commit_oid, from_path, to_path, commits.committer_time FROM (SELECT commit_oid, path AS from_path, lead(path) OVER (PARTITION BY commit_oid ORDER BY path) AS to_path FROM change) JOIN commits USING (commit_oid) WHERE to_path IS NOT NULL)
    SELECT commit_oid, from_path, to_path FROM r WHERE from_path = 'part/7' OR to_path = 'part/7' ORDER BY committer_time DESC, commit_oid, from_path, to_path LIMIT 20""", "commits", "change"))
def j7_renames_touching(m: Model) -> DataFrame:
    return history.renames_touching(m.rename, m.commit, "part/7").select("commit_oid", "from_path", "to_path")


@query("""WITH n AS (SELECT s_suppkey AS memory_id, 's' || s_suppkey AS subject FROM supplier), live AS (SELECT 's' || s_suppkey AS e FROM supplier WHERE s_suppkey % 3 = 0), k AS (SELECT 's' || s_suppkey AS a, 's' || s_suppkey * 3 AS b FROM supplier UNION SELECT 's' || s_suppkey, 's' || s_suppkey + 1 FROM supplier),
    b AS (SELECT a AS subject, b AS e FROM k UNION SELECT b, a FROM k), t AS (SELECT subject, count(*) AS c FROM b WHERE e IN (SELECT e FROM live) GROUP BY subject)
    SELECT memory_id, CASE WHEN subject IN (SELECT e FROM live) THEN 'resolved' WHEN c = 1 THEN 'via_identity_link' WHEN c > 1 THEN 'ambiguous' ELSE 'missing' END AS subject_state FROM n LEFT JOIN t USING (subject)""")
def j14_subject_state(m: Model) -> DataFrame:
    s, name = m.raw("supplier"), lambda c: F.concat(F.lit("s"), text(c))
    link = s.select(name("s_suppkey").alias("left_id"), name(F.col("s_suppkey") * 3).alias("right_id")).union(s.select(name("s_suppkey"), name(F.col("s_suppkey") + 1)))
    notes = s.select(F.col("s_suppkey").alias("memory_id"), name("s_suppkey").alias("subject"))
    return memory.subject_state(notes, s.where("s_suppkey % 3 = 0").select(name("s_suppkey").alias("entity_id")), link).select("memory_id", "subject_state")


@query("""SELECT o_orderkey AS memory_id FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50""")
def k12_note_page(m: Model) -> DataFrame:
    return memory.page(m.raw("orders").select(F.col("o_orderkey").alias("memory_id")), "memory_id", 50, 100)


@query("""SELECT s_suppkey AS registry_id, s_name AS path FROM supplier ORDER BY s_suppkey LIMIT 30""")
def k13_registry_page(m: Model) -> DataFrame:
    return memory.page(m.raw("supplier").select(F.col("s_suppkey").alias("registry_id"), F.col("s_name").alias("path")), "registry_id", 30)


@query("""SELECT l_orderkey * 10 + l_linenumber AS link_id, l_suppkey AS registry_id FROM lineitem ORDER BY link_id LIMIT 100""")
def k13_link_page(m: Model) -> DataFrame:
    return memory.page(m.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link_id"), F.col("l_suppkey").alias("registry_id")), "link_id", 100)


@query(sql(""", w AS (SELECT entity_id, kind, name, list_filter(regexp_split_to_array(lower(name), '[^\\pL\\pN]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(scope_path), '[^\\pL\\pN]+'), lambda x: x <> '') AS b FROM entity),
    t AS (SELECT *, len(list_filter(range(1, len(a)), lambda i: a[i] = 'small' AND starts_with(a[i + 1], 'ri'))) + len(list_filter(range(1, len(b)), lambda i: b[i] = 'small' AND starts_with(b[i + 1], 'ri'))) AS tf FROM w)
    SELECT entity_id, kind, name FROM t WHERE tf > 0""", "entity"))
def q2_search_phrase(m: Model) -> DataFrame:
    """Words joined by an underscore must follow one another; all hits."""
    return lookup.search(m.entity, "Small_ri", limit=1_000_000).select("entity_id", "kind", "name")


# --- impact, gaps, inspection ----------------------------------------------------------

FOUND = sql(""", l1 AS (SELECT DISTINCT ON (source_id) source_id AS entity_id, 1 AS depth, relation, assertion_id FROM assertion WHERE target_id = 'fn_1' ORDER BY source_id, relation, assertion_id), n1 AS (SELECT *, row_number() OVER (ORDER BY relation, entity_id, assertion_id) AS rank FROM l1),
    l2 AS (SELECT DISTINCT ON (source_id) source_id AS entity_id, 2 AS depth, a.relation, a.assertion_id, n1.entity_id AS via_id FROM assertion a JOIN n1 ON target_id = n1.entity_id WHERE source_id NOT IN (SELECT entity_id FROM n1) AND source_id <> 'fn_1' ORDER BY source_id, rank, a.relation, a.assertion_id),
    found AS (SELECT entity_id, depth, relation, 'fn_1' AS via_id, assertion_id FROM l1 UNION ALL SELECT entity_id, depth, relation, via_id, assertion_id FROM l2)""", "entity", "assertion", "observation")


def subject(m: Model) -> DataFrame:
    return m.spark.createDataFrame([("fn_1",)], "entity_id string")


@query(FOUND + " SELECT entity_id, depth, relation, via_id, assertion_id FROM found")
def q6_impact_edges(m: Model) -> DataFrame:
    """With the edge by which each was found first."""
    return graph.impact(m.assertion, subject(m), 2, ALL_DOWN)


REPORT = FOUND + f""", s AS (SELECT * FROM {STATE}), ev AS (SELECT assertion_id, file_path, start_line FROM observation QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY file_path, start_line, source_type) = 1),
    r AS (SELECT found.*, kind, CASE WHEN kind IN ('function', 'method', 'class', 'interface') AND scope_path <> '' THEN scope_path || '.' || name ELSE name END AS qualified, status, file_path, start_line, CASE WHEN file_path IS NOT NULL THEN CASE WHEN file_path IN (SELECT 'supp/' || s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) THEN 'fresh' ELSE 'stale' END END AS freshness FROM found JOIN entity USING (entity_id) LEFT JOIN s USING (assertion_id) LEFT JOIN ev USING (assertion_id))"""


def report(m: Model) -> dict[str, DataFrame]:
    state = lambda ids: claims.derive_state(m.observation, m.assertion, m.entity) if ids is None else claims.state_of(m.observation, m.assertion, m.entity, ids)
    order = Window.partitionBy("assertion_id").orderBy("file_path", "start_line", "source_type")
    ev = m.observation.withColumn("at", F.row_number().over(order)).where("at = 1")
    fresh = m.raw("supplier").select(F.concat(F.lit("supp/"), text("s_suppkey")).alias("file_path"), F.when(F.col("s_nationkey") % 2 == 0, "fresh").otherwise("stale").alias("freshness"))
    return graph.impact_report(m.assertion, state, m.entity, ev, fresh, subject(m), 2, ALL_DOWN, 50)


@query(REPORT + " SELECT entity_id, depth, kind, qualified, relation, via_id, status, file_path, start_line, freshness FROM r ORDER BY depth, kind, qualified, entity_id LIMIT 50")
def k7_impact_page(m: Model) -> DataFrame:
    return report(m)["rows"].select("entity_id", "depth", "kind", "qualified", "relation", "via_id", "status", "file_path", "start_line", "freshness")


@query(REPORT + """ SELECT 'by_depth' AS metric, depth::VARCHAR AS name, count(*) AS n FROM r GROUP BY depth UNION ALL SELECT 'by_relation', relation, count(*) FROM r GROUP BY relation UNION ALL SELECT 'by_kind', kind, count(*) FROM r GROUP BY kind
    UNION ALL SELECT 'entities', '', count(*) FROM r UNION ALL SELECT 'stale', '', count(*) FILTER (freshness = 'stale') FROM r""")
def a7_impact_report_totals(m: Model) -> DataFrame:
    return report(m)["totals"]


@query(sql(f"SELECT CASE WHEN contains(split_part(target_id, 'unres_', 2), 'e') THEN 'document_link' ELSE 'uncategorised' END AS category, sum(evidence_count)::BIGINT AS sites FROM {STATE} JOIN assertion USING (assertion_id) WHERE is_unresolved GROUP BY ALL", *EVIDENCE))
def a6_unresolved_sites(m: Model) -> DataFrame:
    meta = F.when(F.contains("entity_id", F.lit("e")) & (F.col("kind") == "unresolved") & F.contains(F.substring_index("entity_id", "unres_", -1), F.lit("e")), F.lit('{"category":"document_link"}')).otherwise("{")
    open_ = claims.unresolved_claims(m.assertion, m.entity)
    return lookup.unresolved_sites(claims.state_of(m.observation, open_, m.entity, open_.select("assertion_id")), open_, m.entity.withColumn("meta", meta), [])


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_orderpriority AS state_id, o_orderstatus FROM orders) SELECT run_id FROM r WHERE state_id = (SELECT arg_max(state_id, run_id) FROM r)""")
def a3_runs_of_last_state(m: Model) -> DataFrame:
    return lookup.last_state(m.raw("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("state_id"))).select("run_id")


@query(sql(""", r AS (SELECT lead(path) OVER (PARTITION BY commit_oid ORDER BY path) AS to_path FROM change) SELECT 'changes_' || k AS metric, (SELECT count(*) FROM change WHERE change_kind = k) AS n FROM (SELECT unnest(['added', 'modified', 'deleted', 'mode_changed']) AS k)
    UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'merges', 0 UNION ALL SELECT 'changes', count(*) FROM change UNION ALL SELECT 'renames', count(to_path) FROM r""", "commits", "change"))
def a14_totals_with_renames(m: Model) -> DataFrame:
    return history.history_totals(m.commit, m.change, m.rename)


@query(GAPS + " SELECT symbol, file, start_line, state FROM g WHERE state IN ('uncovered', 'unmeasured') ORDER BY file, start_line, symbol LIMIT 50")
def k8_gap_rows(m: Model) -> DataFrame:
    return coverage.gap_rows(gaps_of(m)).select("symbol", "file", "start_line", "state")


@query(GAPS + """, f AS (SELECT DISTINCT p_brand || '/' || p_size AS file, CASE WHEN right(p_brand, 1) IN ('1', '2') THEN 'stale' ELSE 'fresh' END AS freshness FROM part) SELECT count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'uncovered') AS uncovered, count(*) FILTER (state = 'unmeasured') AS unmeasured,
    count(*) FILTER (state <> 'unmeasured' AND file IN (SELECT file FROM f WHERE freshness = 'stale')) AS stale, (SELECT count(*) FROM f) AS measured_files, (SELECT count(*) FROM f WHERE freshness = 'stale') AS stale_files FROM g""")
def a8_gap_totals_full(m: Model) -> DataFrame:
    fresh = m.raw("part").select(F.concat_ws("/", "p_brand", text("p_size")).alias("file"), F.when(F.substring("p_brand", -1, 1).isin("1", "2"), "stale").otherwise("fresh").alias("freshness")).distinct()
    return coverage.gap_totals_full(gaps_of(m), fresh)


@query("""WITH p AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_name LIMIT 60), s AS (SELECT CASE s_nationkey % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'missing' WHEN 3 THEN 'stale' ELSE 'fresh' END AS x FROM p)
    SELECT (SELECT count(*) FROM supplier) AS files_total, count(*) AS files_probed, count(*) FILTER (x = 'fresh') AS fresh, count(*) FILTER (x = 'stale') AS stale, count(*) FILTER (x = 'missing') AS missing, count(*) FILTER (x = 'refused') AS refused, count(*) FILTER (x = 'unreadable') AS unreadable, (SELECT count(*) FROM supplier) > 60 AS truncated FROM s""")
def a18_freshness_tallies(m: Model) -> DataFrame:
    s, k = m.raw("supplier"), F.col("s_nationkey") % 5
    now = s.where(k != 2).select(F.col("s_name").alias("file_path"), F.when(k == 3, "b").otherwise("a").alias("content_hash"), F.when(k == 0, "refused").when(k == 1, "unreadable").alias("problem"))
    return lookup.freshness_tallies(s.select(F.col("s_name").alias("file_path"), F.lit("a").alias("content_hash")), now, 60)


@query("""SELECT CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS file_path, 'python' AS language, event_id::VARCHAR AS content_hash, event_id % 7 AS dynamic_imports_without_specifier, event_id % 11 AS unmodelled_call_sites FROM events WHERE event_id % 4 = 0""")
def q12_partial_parses(m: Model) -> DataFrame:
    k = F.col("event_id")
    good = F.to_json(F.struct(F.struct((k % 4 == 0).alias("has_syntax_error"), (k % 7).alias("dynamic_imports_without_specifier"), (k % 11).alias("unmodelled_call_sites"), F.create_map(F.lit("computed"), k % 3).alias("unmodelled_by_form")).alias("counters")))
    facts = m.raw("events").select(F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3).cast("int")).alias("file_path"), F.lit("python").alias("language"), text("event_id").alias("content_hash"), F.when(k % 4 == 3, "no json").otherwise(good).alias("facts"))
    return lookup.partial_parses(facts).drop("unmodelled_by_form")


@query("""SELECT c_name AS path, c_custkey % 4 < 3 AND c_nationkey < 20 AS indexable FROM customer WHERE c_custkey % 3 > 0""")
def u2_untracked(m: Model) -> DataFrame:
    c = m.raw("customer")
    found = c.select(F.col("c_name").alias("path"), F.when(F.col("c_nationkey") < 20, 10).otherwise(5000).alias("length"), (F.col("c_custkey") % 4 < 3).alias("is_text"))
    return incremental.untracked(found, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("path")), 1000)


@query(sql("""SELECT 'entities' AS metric, count(*) AS n FROM entity UNION ALL SELECT 'indexed_documents', (SELECT count(*) FROM entity WHERE kind <> 'function') + (SELECT count(*) FROM supplier) UNION ALL SELECT 'not_indexed', count(*) FROM entity WHERE kind = 'function' UNION ALL SELECT 'indexed_but_gone', count(*) FROM supplier
    UNION ALL SELECT 'extractor_runs', count(*) FROM orders UNION ALL SELECT 'unfinished_runs', count(*) FROM orders WHERE o_orderstatus = 'O'""", "entity"))
def a23_diagnostics(m: Model) -> DataFrame:
    index = m.entity.where("kind != 'function'").select("entity_id").union(m.raw("supplier").select(F.concat(F.lit("gone_"), text("s_suppkey"))))
    run = m.raw("orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") != "O", "t").alias("finished_at"))
    return claims.diagnostics({"entity": m.entity}, run, index)


@query("""SELECT o_orderkey AS repo_id, CASE WHEN o_orderstatus = 'O' THEN 'no_history_ingested' WHEN o_orderpriority LIKE '1%' THEN 'unverifiable' WHEN o_custkey % 2 = 0 THEN 'current' ELSE 'stale' END AS freshness FROM orders""")
def q23_history_freshness(m: Model) -> DataFrame:
    o = m.raw("orders").select(F.col("o_orderkey").alias("repo_id"), F.when(F.col("o_orderstatus") != "O", "a").alias("ingested_head"), F.when(~F.col("o_orderpriority").like("1%"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b")).alias("head"))
    return history.history_freshness(o).select("repo_id", "freshness")


@query("""SELECT event_id, strftime(make_timestamp(event_id * 86399000000 * 3), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events""")
def fn_civil_date(m: Model) -> DataFrame:
    return m.raw("events").select("event_id", S.civil_date(F.col("event_id") * 86399 * 3).alias("at"))


@query("""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS text, false AS truncated FROM documents WHERE doc_id = 7""")
def q15_snippet(m: Model) -> DataFrame:
    docs = m.raw("documents").select(F.col("doc_id"), text("doc_id").alias("path"), "text", F.lit("file").alias("outcome"))
    return files.snippet(docs, "7", 2, 3).select(F.lit(7).cast("long").alias("doc_id"), "text", "truncated")


# --- sources over generated texts ------------------------------------------------------


@query("""SELECT p_partkey::VARCHAR AS path, 'heading' AS kind, 1 AS level, p_name AS text, 1 AS line FROM part UNION ALL SELECT p_partkey::VARCHAR, 'fence', NULL, 'sql', 3 FROM part UNION ALL SELECT p_partkey::VARCHAR, 'heading', 2, p_brand, 6 FROM part UNION ALL SELECT p_partkey::VARCHAR, 'link', NULL, 'part/' || p_size || '.md', 8 FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey::VARCHAR, 'heading', 1, p_type, 9 FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey::VARCHAR, 'heading', 3, p_type, 9 FROM part WHERE p_size % 3 > 0""")
def s8_markdown_blocks(m: Model) -> DataFrame:
    return markdown.blocks(m.markdown)


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 3 END AS v FROM part) SELECT p_partkey::VARCHAR AS path, 1 AS level, p_name AS text, 1 AS line, CASE WHEN v = 1 THEN 8 ELSE 10 END AS end_line FROM p UNION ALL SELECT p_partkey::VARCHAR, 2, p_brand, 6, CASE WHEN v = 1 THEN 8 ELSE 10 END FROM p UNION ALL SELECT p_partkey::VARCHAR, v, p_type, 9, 10 FROM p""")
def q42_sections(m: Model) -> DataFrame:
    lengths = m.markdown.select("path", F.size(F.split("text", "\n")).alias("lines"))
    return markdown.sections(markdown.blocks(m.markdown), lengths)


@query("""SELECT 'adr/' || lpad(n_nationkey::VARCHAR, 4, '0') || '-x.md' AS source, 'adr:' || (n_nationkey - 1) AS raw, CASE WHEN n_nationkey >= 1 THEN 'adr/' || lpad((n_nationkey - 1)::VARCHAR, 4, '0') || '-x.md' END AS target, CASE WHEN n_nationkey < 1 THEN 'no_such_number' END AS reason, CASE WHEN n_nationkey % 3 = 0 THEN 'Accepted' ELSE 'Superseded' END AS status FROM nation WHERE n_nationkey > 0 AND n_nationkey % 2 = 1""")
def q42_decisions(m: Model) -> DataFrame:
    found = adr.records(m.decisions)
    return adr.supersession(found).join(found.select(F.col("path").alias("source"), "status"), "source")


@query("""SELECT count(*) AS contradictions FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AND n_nationkey + 1 IN (SELECT n_nationkey FROM nation)""")
def a20_contradictions(m: Model) -> DataFrame:
    found = adr.records(m.decisions)
    return adr.contradictions(adr.supersession(found), found)


@query("""SELECT s_suppkey::VARCHAR AS path, kind, name, scope, line FROM supplier, (VALUES ('class', 'C', '', 3), ('method', 'run', 'C', 4), ('function', 'main', '', 7)) t(kind, name, scope, line)""")
def s7_python_symbols(m: Model) -> DataFrame:
    return python_code.structure(m.python).where("row = 'symbol'").select("path", "kind", "name", "scope", "line")


@query("""SELECT s_suppkey::VARCHAR AS path, name, target FROM supplier, (VALUES (1, 'a'), (2, 'b')) t(k, unused), LATERAL (SELECT CASE k WHEN 1 THEN 'os' ELSE 'n' || s_nationkey END AS name, CASE k WHEN 1 THEN 'os' ELSE '.pkg:n' || s_nationkey END AS target) x""")
def s7_python_imports(m: Model) -> DataFrame:
    return python_code.structure(m.python).where("row = 'import'").select("path", "name", "target")


@query("""SELECT s_suppkey::VARCHAR AS path, section, name, specifier FROM supplier, LATERAL (SELECT unnest(['package', 'dependencies', 'workspaces']) AS section, unnest(['p' || s_suppkey, 'n' || s_nationkey, 'packages/*']) AS name, unnest(['1.0', 'workspace:*', '']) AS specifier) x""")
def s14_npm_manifests(m: Model) -> DataFrame:
    manifest = F.concat(F.lit('{"name":"p'), text("s_suppkey"), F.lit('","version":"1.0","dependencies":{"n'), text("s_nationkey"), F.lit('":"workspace:*"},"workspaces":["packages/*"]}'))
    return manifests.declarations(m.raw("supplier").select(text("s_suppkey").alias("path"), manifest.alias("text"))).select("path", "section", "name", "specifier")


@query("""WITH l AS (SELECT l_orderkey % 50 AS report, l_suppkey AS f, l_linenumber AS line, max(l_quantity::BIGINT) AS hits FROM lineitem GROUP BY ALL) SELECT report, 'src/' || f || '.ts' AS file, line, hits FROM l""")
def s9_lcov_lines(m: Model) -> DataFrame:
    return traces.parse_lcov(m.lcov)[0].select(F.col("report").cast("long").alias("report"), "file", "line", "hits")


@query("""SELECT l_orderkey % 50 AS report, tag, count(DISTINCT l_suppkey) AS n FROM lineitem, (VALUES ('bad_line'), ('test_name_ignored')) t(tag) GROUP BY ALL""")
def s9_lcov_refusals(m: Model) -> DataFrame:
    return traces.parse_lcov(m.lcov)[1].select(F.col("report").cast("long").alias("report"), "tag", "n")


@query("""SELECT 'name' AS vocabulary, count(*) AS n FROM nation""")
def w18_dump_counters(m: Model) -> DataFrame:
    return claims.dump_counters({"name": m.raw("nation")}).toDF("vocabulary", "n")


