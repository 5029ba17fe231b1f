"""The evidence model as views of the driver's tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .helpers import sized


class Model:
    """Lazy model tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        sized(spark, sf_dir)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def links(self) -> DataFrame:
        """(page_id, url, href), each once."""
        return self.raw("pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()

    @property
    def entity(self) -> DataFrame:
        s = lambda *c: F.concat(*[F.lit(x) if x.endswith("_") else F.col(x).cast("string") for x in c])
        row = lambda df, i, kind, name, scope: df.select(i.alias("entity_id"), F.lit(kind).alias("kind"), name.alias("name"), scope.alias("scope_path"))
        nation = self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
        parts = [
            row(self.raw("region"), s("repo_", "r_regionkey"), "repository", F.col("r_name"), F.lit("")),
            row(nation, s("dir_", "n_nationkey"), "directory", F.col("n_name"), F.col("r_name")),
            row(self.raw("customer"), s("mod_c_", "c_custkey"), "module", F.col("c_name"), s("dir_", "c_nationkey")),
            row(self.raw("supplier"), s("mod_s_", "s_suppkey"), "module", F.col("s_name"), s("dir_", "s_nationkey")),
            row(self.raw("part"), s("fn_", "p_partkey"), "function", F.col("p_name"), F.col("p_brand")),
            row(self.raw("orders"), s("class_", "o_orderkey"), "class", F.col("o_orderkey").cast("string"), s("mod_c_", "o_custkey")),
            row(self.raw("pages"), s("doc_", "page_id"), "document", F.col("url"), F.col("url")),
            row(self.links, F.concat(F.lit("unres_"), F.col("page_id").cast("string"), F.lit("_"), "href"), "unresolved", F.col("href"), s("doc_", "page_id")),
        ]
        return reduce(DataFrame.union, parts)

    @property
    def items(self) -> DataFrame:
        return self.raw("lineitem")

    @property
    def assertion(self) -> DataFrame:
        def claims(df: DataFrame, a: str, x, relation: str, b: str, y) -> DataFrame:
            text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
            return df.select(F.concat(F.lit(a), text(x)).alias("source_id"), F.lit(relation).alias("relation"), F.concat(F.lit(b), text(y)).alias("target_id"))

        parts = [
            claims(self.raw("nation"), "repo_", "n_regionkey", "CONTAINS", "dir_", "n_nationkey"),
            claims(self.raw("customer"), "dir_", "c_nationkey", "CONTAINS", "mod_c_", "c_custkey"),
            claims(self.raw("supplier"), "dir_", "s_nationkey", "CONTAINS", "mod_s_", "s_suppkey"),
            claims(self.raw("orders"), "mod_c_", "o_custkey", "DEFINES", "class_", "o_orderkey"),
            claims(self.items.select("l_orderkey", "l_partkey").distinct(), "class_", "l_orderkey", "REFERENCES", "fn_", "l_partkey"),
            claims(self.items.select("l_suppkey", "l_partkey").distinct(), "mod_s_", "l_suppkey", "IMPLEMENTS", "fn_", "l_partkey"),
            claims(self.links, "doc_", "page_id", "REFERENCES", "unres_", F.concat_ws("_", F.col("page_id").cast("string"), "href")),
        ]
        return reduce(DataFrame.union, parts).select(F.concat_ws("|", "source_id", "relation", "target_id").alias("assertion_id"), "source_id", "relation", "target_id")

    @property
    def observation(self) -> DataFrame:
        """Evidence of REFERENCES, each row once by the evidence key."""
        order = self.items.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").distinct().select(
            F.concat(F.lit("class_"), F.col("l_orderkey").cast("string"), F.lit("|REFERENCES|fn_"), F.col("l_partkey").cast("string")).alias("assertion_id"), F.lit("lines").alias("extractor_id"), F.lit("1").alias("extractor_version"),
            (F.col("l_linenumber") - 1).cast("int").alias("source_type"), F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("file_path"), F.col("l_linenumber").cast("long").alias("start_line"), F.col("l_linenumber").cast("long").alias("end_line"),
        )
        link = self.links.select(
            F.concat(F.lit("doc_"), F.col("page_id").cast("string"), F.lit("|REFERENCES|unres_"), F.col("page_id").cast("string"), F.lit("_"), "href"), F.lit("links"), F.lit("1"), F.lit(8), F.col("url"), F.lit(0).cast("long"), F.lit(0).cast("long")
        )
        return order.union(link)  # links are distinct, and of another extractor

    @property
    def occurrence(self) -> DataFrame:
        """Classes and functions occur in the files of the suppliers of their items."""
        where = F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string"))
        each = [self.items.groupBy(c, "l_suppkey").agg(F.min("l_linenumber").cast("long").alias("start_line")).select(F.concat(F.lit(a), F.col(c).cast("string")).alias("entity_id"), where.alias("file_path"), "start_line") for a, c in (("class_", "l_orderkey"), ("fn_", "l_partkey"))]
        rows = each[0].union(each[1])
        return rows.select(F.concat_ws("@", "entity_id", "file_path").alias("occurrence_id"), "entity_id", "file_path", "start_line", (F.col("start_line") * 10).alias("start_byte"), (F.col("start_line") * 10 + 9).alias("end_byte"))

    @property
    def commit_owner(self) -> DataFrame:
        """(o_custkey, o_orderkey, committer_time)"""
        return self.commit.join(self.raw("orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("commit_oid"), "o_orderkey", "o_custkey"), "commit_oid").select("o_custkey", "o_orderkey", "committer_time")

    @property
    def rename(self) -> DataFrame:
        """Neighbouring paths of a commit as renames of one another."""
        from pyspark.sql import Window

        nxt = F.lead("path").over(Window.partitionBy("commit_oid").orderBy("path"))
        return self.change.select("commit_oid", F.col("path").alias("from_path"), nxt.alias("to_path")).where("to_path IS NOT NULL")

    @property
    def markdown(self) -> DataFrame:
        """(path, text): a Markdown file a part."""
        s = lambda c: F.col(c).cast("string")
        last = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("# "), "p_type")).otherwise(F.concat(F.lit("### "), "p_type", F.lit(" ###")))
        link = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("See [size](part/"), s("p_size"), F.lit(".md) and `[no](x)`."))).otherwise("No link here.")
        lines = [F.concat(F.lit("# "), "p_name"), F.lit(""), F.lit("```sql"), F.lit("# no heading"), F.lit("```"), s("p_brand"), F.lit("---"), link, last, F.lit("    # code")]
        return self.raw("part").select(s("p_partkey").alias("path"), F.concat_ws("\n", *lines).alias("text"))

    @property
    def decisions(self) -> DataFrame:
        """(path, text): a decision record a nation; odd ones supersede the one before."""
        k = F.col("n_nationkey")
        status = F.when(k % 3 == 0, "Accepted").otherwise("Superseded")
        head = F.concat(F.lit("# ADR-"), k.cast("string"), F.lit(" A decision\n\nStatus: "), status)
        tail = F.when(k % 2 == 1, F.concat(F.lit("\nSupersedes: ADR-"), (k - 1).cast("string"))).otherwise("")
        return self.raw("nation").select(F.concat(F.lit("adr/"), F.lpad(k.cast("string"), 4, "0"), F.lit("-x.md")).alias("path"), F.concat(head, tail, F.lit("\n")).alias("text"))

    @property
    def python(self) -> DataFrame:
        """(path, text): a Python file a supplier."""
        n = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
        source = F.concat(F.lit("import os\nfrom .pkg import "), n, F.lit("\nclass C:\n    def run(self):\n        return os.getcwd()\n\ndef main():\n    return C().run()\n"))
        return self.raw("supplier").select(F.col("s_suppkey").cast("string").alias("path"), source.alias("text"))

    @property
    def lcov(self) -> DataFrame:
        """(report, record, value): the records of 50 coverage reports, each with a test name and a bad line."""
        rows = self.items.select((F.col("l_orderkey") % 50).cast("string").alias("report"), F.col("l_suppkey").alias("f"), F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_quantity").cast("long").cast("string")).alias("da"))
        by = rows.groupBy("report", "f").agg(F.array_join(F.sort_array(F.collect_list("da")), "\n").alias("das"))
        f = F.col("f").cast("string")
        return by.select("report", F.col("f").cast("long").alias("record"), F.concat(F.lit("TN:t\nSF:src/"), f, F.lit(".ts\n"), "das", F.lit("\nDA:0,1\n")).alias("value"))

    @property
    def rewrite(self) -> DataFrame:
        """(commit_oid, path, change_kind, blob_oid, text): four documents a commit, each deleted and added with another first line; sentences are lines."""
        t = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
        gone = self.raw("documents").select(F.floor(F.col("doc_id") / 4).cast("string").alias("commit_oid"), F.concat(F.lit("old/"), F.col("doc_id").cast("string")).alias("path"), F.lit("deleted").alias("change_kind"), t.alias("text"))
        come = gone.select("commit_oid", F.replace("path", F.lit("old"), F.lit("new")).alias("path"), F.lit("added").alias("change_kind"), F.concat(F.lit("x "), "text").alias("text"))
        return gone.union(come).select("commit_oid", "path", "change_kind", F.sha2("text", 256).alias("blob_oid"), "text")

    @property
    def commit(self) -> DataFrame:
        """A commit an order; its parent is the customer's order before it."""
        oid = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
        from pyspark.sql import Window

        time = (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) * 86400).cast("long")
        w = Window.partitionBy("o_custkey").orderBy("committer_time", "commit_oid")
        rows = self.raw("orders").select(oid("o_orderkey").alias("commit_oid"), "o_custkey", time.alias("committer_time"), F.col("o_orderpriority").alias("summary"))
        before = F.lag("commit_oid").over(w)
        return rows.select("commit_oid", "committer_time", "summary", F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before)).alias("parent_oids"), F.lit(False).alias("is_merge"), (F.pmod("o_custkey", F.lit(10)) == 0).alias("hidden"))

    @property
    def change(self) -> DataFrame:
        """A changed path a part of an order; the kind is that of its least return flag."""
        flag = F.min("l_returnflag")
        kind = F.when(flag == "N", "added").when(flag == "R", "modified").otherwise("deleted")
        return self.items.groupBy("l_orderkey", "l_partkey").agg(kind.alias("change_kind")).select(
            F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("commit_oid"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), "change_kind"
        )

    @property
    def content_change(self) -> DataFrame:
        """Documents of about one length are a commit; even ones are deleted, odd ones added; the blob is the digest of the text."""
        blob = F.sha2("text", 256)
        gone = F.pmod("doc_id", F.lit(2)) == 0
        return self.raw("documents").select(
            F.floor(F.col("n_chars") / 20).cast("string").alias("commit_oid"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.when(gone, "deleted").otherwise("added").alias("change_kind"), F.when(~gone, blob).alias("blob_oid"), F.when(gone, blob).alias("prev_blob_oid")
        )

    @property
    def blob(self) -> DataFrame:
        return self.raw("documents").select(F.sha2("text", 256).alias("blob_oid"), F.col("text").alias("content")).dropDuplicates(["blob_oid"])

    @property
    def edge(self) -> DataFrame:
        """(src, dst): from each customer to the customers numbered as its first and its last order, modulo their number."""
        n = self.raw("customer").count()
        by = self.raw("orders").groupBy(F.col("o_custkey").alias("src")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
        return by.select("src", F.explode(F.array("a", "b")).alias("k")).select("src", F.pmod("k", F.lit(n)).alias("dst")).distinct()

    @property
    def span(self) -> DataFrame:
        """An order is a symbol of its customer's file, from its date to its last shipment, in days."""
        day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
        last = self.items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
        rows = self.raw("orders").join(last, "o_orderkey")
        return rows.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("symbol"), F.least(day("o_orderdate"), day("last")).alias("start_line"), F.greatest(day("o_orderdate"), day("last")).alias("end_line"))

    @property
    def line(self) -> DataFrame:
        """Shipped days of a customer's items with their quantities as hits."""
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
        rows = self.items.join(self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        return rows.select(F.col("o_custkey").alias("file"), day.alias("line"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long")).otherwise(0).alias("hits"))

    @property
    def transition(self) -> DataFrame:
        """Turns of a conversation as events of a note."""
        status = F.when(F.col("turn") == 0, "proposed").when(F.col("turn") == 1, "active").when(F.pmod("turn", F.lit(3)) == 2, "superseded").otherwise("invalidated")
        return self.raw("conversations").select(F.col("conv_id").alias("memory_id"), F.col("turn").alias("event_id"), status.alias("to_status"))


#: The same tables for the oracle.
SQL = {
    "link": """SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
    "entity": """SELECT 'repo_' || r_regionkey AS entity_id, 'repository' AS kind, r_name AS name, '' AS scope_path FROM region
        UNION ALL SELECT 'dir_' || n_nationkey, 'directory', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'mod_c_' || c_custkey, 'module', c_name, 'dir_' || c_nationkey FROM customer
        UNION ALL SELECT 'mod_s_' || s_suppkey, 'module', s_name, 'dir_' || s_nationkey FROM supplier
        UNION ALL SELECT 'fn_' || p_partkey, 'function', p_name, p_brand FROM part
        UNION ALL SELECT 'class_' || o_orderkey, 'class', o_orderkey::VARCHAR, 'mod_c_' || o_custkey FROM orders
        UNION ALL SELECT 'doc_' || page_id, 'document', url, url FROM pages
        UNION ALL SELECT 'unres_' || page_id || '_' || href, 'unresolved', href, 'doc_' || page_id FROM link""",
    "claim": """SELECT 'repo_' || n_regionkey AS source_id, 'CONTAINS' AS relation, 'dir_' || n_nationkey AS target_id FROM nation
        UNION ALL SELECT 'dir_' || c_nationkey, 'CONTAINS', 'mod_c_' || c_custkey FROM customer
        UNION ALL SELECT 'dir_' || s_nationkey, 'CONTAINS', 'mod_s_' || s_suppkey FROM supplier
        UNION ALL SELECT 'mod_c_' || o_custkey, 'DEFINES', 'class_' || o_orderkey FROM orders
        UNION ALL SELECT DISTINCT 'class_' || l_orderkey, 'REFERENCES', 'fn_' || l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 'mod_s_' || l_suppkey, 'IMPLEMENTS', 'fn_' || l_partkey FROM lineitem
        UNION ALL SELECT 'doc_' || page_id, 'REFERENCES', 'unres_' || page_id || '_' || href FROM link""",
    "assertion": "SELECT source_id || '|' || relation || '|' || target_id AS assertion_id, source_id, relation, target_id FROM claim",
    "observation": """SELECT DISTINCT 'class_' || l_orderkey || '|REFERENCES|fn_' || l_partkey AS assertion_id, 'lines' AS extractor_id, '1' AS extractor_version, (l_linenumber - 1)::INT AS source_type, 'supp/' || l_suppkey AS file_path, l_linenumber::BIGINT AS start_line, l_linenumber::BIGINT AS end_line FROM lineitem
        UNION ALL SELECT 'doc_' || page_id || '|REFERENCES|unres_' || page_id || '_' || href, 'links', '1', 8, url, 0, 0 FROM link""",
    "commits": """SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS commit_oid, o_custkey, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400)::BIGINT AS committer_time, o_orderpriority AS summary, o_custkey % 10 = 0 AS hidden FROM orders""",
    "parent": """SELECT commit_oid, lag(commit_oid) OVER (PARTITION BY o_custkey ORDER BY committer_time, commit_oid) AS parent_oid FROM commits""",
    "change": """SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS commit_oid, 'part/' || l_partkey AS path, CASE min(l_returnflag) WHEN 'N' THEN 'added' WHEN 'R' THEN 'modified' ELSE 'deleted' END AS change_kind FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "content": """SELECT (n_chars // 20)::VARCHAR AS commit_oid, 'doc/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'deleted' ELSE 'added' END AS change_kind, sha256(text) AS blob_oid, text FROM documents""",
    "rewrite": """SELECT commit_oid, path, change_kind, sha256(text) AS blob_oid, text FROM (SELECT (doc_id // 4)::VARCHAR AS commit_oid, 'old/' || doc_id AS path, 'deleted' AS change_kind, replace(text, '. ', '.' || chr(10)) AS text FROM documents UNION ALL SELECT (doc_id // 4)::VARCHAR, 'new/' || doc_id, 'added', 'x ' || replace(text, '. ', '.' || chr(10)) FROM documents)""",
    "occurrence": """SELECT entity_id || '@' || file_path AS occurrence_id, entity_id, file_path, start_line, start_line * 10 AS start_byte, start_line * 10 + 9 AS end_byte FROM (SELECT 'class_' || l_orderkey AS entity_id, 'supp/' || l_suppkey AS file_path, min(l_linenumber)::BIGINT AS start_line FROM lineitem GROUP BY ALL UNION ALL SELECT 'fn_' || l_partkey, 'supp/' || l_suppkey, min(l_linenumber)::BIGINT FROM lineitem GROUP BY ALL)""",
    "edge": """SELECT o_custkey AS src, min(o_orderkey) % (SELECT count(*) FROM customer) AS dst FROM orders GROUP BY o_custkey UNION SELECT o_custkey, max(o_orderkey) % (SELECT count(*) FROM customer) FROM orders GROUP BY o_custkey""",
    "span": """SELECT o_custkey AS file, o_orderkey AS symbol, least(a, b) AS start_line, greatest(a, b) AS end_line FROM (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS a, (SELECT date_diff('day', DATE '1992-01-01', max(l_shipdate)::DATE) FROM lineitem WHERE l_orderkey = o_orderkey) AS b FROM orders) WHERE b IS NOT NULL""",
    "line": """SELECT o_custkey AS file, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS line, CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT ELSE 0 END AS hits FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "transition": """SELECT conv_id AS memory_id, turn AS event_id, CASE WHEN turn = 0 THEN 'proposed' WHEN turn = 1 THEN 'active' WHEN turn % 3 = 2 THEN 'superseded' ELSE 'invalidated' END AS to_status FROM conversations""",
}
NEEDS = {"entity": ["link"], "claim": ["link"], "assertion": ["link", "claim"], "observation": ["link"], "parent": ["commits"]}


def sql(query: str, *tables: str, recursive: bool = False) -> str:
    """query with the model tables it names in front."""
    order: list[str] = []
    for t in tables:
        order += [x for x in [*NEEDS.get(t, []), t] if x not in order]
    order.sort(key=list(SQL).index)
    head = ", ".join(f"{t} AS ({SQL[t]})" for t in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {query}" if not query.startswith(",") else f"WITH {'RECURSIVE ' if recursive else ''}{head}{query}"
