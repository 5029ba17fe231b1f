"""What must hold at any size: no unbounded broadcast, no cap, the same rows as SQL beyond the ranges of small tables."""

import random

import pytest
from pyspark.sql import functions as F

from grovewright.functions import scalars as S
from grovewright.operators import graph, incremental
from grovewright.plans.helpers import closure


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_are_joined_without_broadcast(spark):
    imports = spark.createDataFrame([("a/b.ts", "./c")], "importer string, specifier string")
    assert "Broadcast" not in plan(incremental.resolve_imports(imports, spark.createDataFrame([("a/c.ts",)], "path string")))


def test_civil_date_beyond_four_digits(spark):
    """As DuckDB's strftime has it, without a sign."""
    df = spark.createDataFrame([(253402300799,), (253402300800,), (1555181740803,), (-1,)], "s long")
    assert [r[0] for r in df.select(S.civil_date(F.col("s"))).collect()] == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "51251-09-30T16:00:03Z", "1969-12-31T23:59:59Z"]


def brute(claim, source, target, depth):
    def walk(path, edges):
        if path[-1] == target:
            yield len(edges), edges, path
        elif len(edges) < depth:
            for a, s, r, t in claim:
                if s == path[-1] and t not in path:
                    yield from walk([*path, t], [*edges, f"{r}|{t}|{a}"])

    return sorted(walk([source], []))


def claims_of(spark, pairs):
    claim = [(f"{s}|CALLS|{t}", s, "CALLS", t) for s, t in pairs]
    return claim, spark.createDataFrame(claim, "assertion_id string, source_id string, relation string, target_id string")


def test_paths_past_a_hub(spark):
    """More extensions than any budget: the path at the end of the last branch is found."""
    df = spark.range(400).selectExpr("concat('h', id) AS s").crossJoin(spark.range(400).selectExpr("concat('m', id) AS t")).union(spark.range(400).selectExpr("'a'", "concat('h', id)")).union(spark.createDataFrame([("m399", "z")], "s string, t string"))
    got, cut = graph.find_paths(df.selectExpr("concat_ws('|', s, 'CALLS', t) AS assertion_id", "s AS source_id", "'CALLS' AS relation", "t AS target_id"), "a", "z", 6, 2)
    assert not cut and [r.nodes for r in got.collect()] == [["a", "h0", "m399", "z"], ["a", "h100", "m399", "z"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_where_first_ones_are_not_simple(spark, seed):
    """Dense graphs with cycles: lists of a node are full of paths that lead back, so the width has to grow."""
    rng = random.Random(seed)
    claim, df = claims_of(spark, sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(30)} | {("n0", "n1")}))
    want = brute(claim, "n0", "n6", 5)
    for limit in (1, 4, 1000):
        assert [(r.hops, r.edges, r.nodes) for r in graph.find_paths(df, "n0", "n6", 5, limit)[0].collect()] == want[:limit]
    ways = [graph.paths_within(df.selectExpr("source_id AS `from`", "target_id AS at", "concat_ws('|', relation, target_id, assertion_id) AS edge").where("`from` != 'n6'"), "n0", "n6", 5, len(want), width) for width in (1, 10_000)]
    assert ways[0] is None and sum(d.count() for d in ways[1]) == len(want) > 4


def test_partitions_follow_the_input(spark, sf, tmp_path):
    """More input, more shuffle partitions; the session's own number where that is enough."""
    from grovewright.plans import helpers

    (tmp_path / "t.parquet").write_bytes(bytes(40 * helpers.TASK_BYTES))
    helpers.sized(spark, str(tmp_path))
    assert spark.conf.get(helpers.INITIAL) == "40"
    helpers.sized(spark, sf)
    assert spark.conf.get(helpers.INITIAL, None) is None


def test_state_diff_reads_its_edges_once(spark, monkeypatch):
    """However long the history, its parents are computed once, then read from the checkpoint by each level."""
    from grovewright.operators import history

    n, seen = 12, []
    commit = spark.createDataFrame([(f"c{i:02}", i, [f"c{i - 1:02}"] if i else []) for i in range(n)], "commit_oid string, committer_time long, parent_oids array<string>")
    monkeypatch.setattr(history, "closure", lambda edges, start, walk: seen.append(plan(edges)) or closure(edges, start, walk))
    kind, commits, changes = history.state_diff(commit, spark.createDataFrame([(f"c{i:02}", "p") for i in range(n)], "commit_oid string, path string"), "c08", "c11")
    assert kind == "diff" and [r.commit_oid for r in commits.collect()] == ["c11", "c10", "c09"] and changes.count() == 3
    assert seen and not any("Generate" in p for p in seen)


def test_similar_renames_join_no_lines(spark):
    """Two joins, of commits and of digests; lines are counted, paired and summed within a commit, without a join of lines."""
    from grovewright.operators import history

    base = [f"line {i}" for i in range(16)]
    texts = {"b0": base, "b1": [*base[:15], "other", "line 0"], "b2": ["x"] * 16, "b3": ["line 0"] * 16}
    change = [("c", "d0", "deleted", None, "b0"), ("c", "a1", "added", "b1", None), ("c", "a2", "added", "b2", None), ("c", "a3", "added", "b3", None)]
    df = spark.createDataFrame(change, "commit_oid string, path string, change_kind string, blob_oid string, prev_blob_oid string")
    pairs = history.similar_renames(df, spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "blob_oid string, content string"))[0]
    joins = plan(pairs).count("SortMergeJoin") + plan(pairs).count("HashJoin")
    assert joins <= 2 and [tuple(r) for r in pairs.collect()] == [("c", "d0", "a1", 15, 17, "unique")]


def test_keys_of_unions_are_joined_once(spark):
    """A semi-join or an anti-join would be done once a branch of the union, each with its own keys."""
    from functools import reduce

    from grovewright.plans.helpers import having, lacking

    df = reduce(lambda a, b: a.union(b), [spark.range(k, k + 3).selectExpr("concat('n', id) AS k", f"{k} AS v") for k in range(5)])
    keys = spark.range(4).selectExpr("concat('n', id) AS k").union(spark.createDataFrame([("n1",), (None,)], "k string"))
    for rows, kind, n in ((having(df, keys, ["k"]), "left_semi", 9), (lacking(df, keys, ["k"]), "left_anti", 6)):
        assert rows.columns == df.columns and sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.join(keys, "k", kind).select("k", "v").collect())) and rows.count() == n
        p = plan(rows.select("*"))
        assert p.count("SortMergeJoin") + p.count("HashJoin") == 1
