"""Operators on small graphs of our own, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovewright.functions import scalars as S
from grovewright.functions import vocab
from grovewright.operators import claims, coverage, graph, history, incremental, lookup, memory
from grovewright.plans.helpers import closure, only_by
from grovewright.streaming import ingest

EVIDENCE = "assertion_id string, extractor_id string, extractor_version string, source_type int, file_path string, start_line long, end_line long"


def make(spark, seed=1, nodes=30, edges=70):
    rng = random.Random(seed)
    entity = [(f"n{i:02}", "unresolved" if i % 9 == 8 else "repository" if i == 0 else "function", f"name{i}", "m") for i in range(nodes)]
    claim = sorted({(f"n{rng.randrange(nodes):02}", rng.choice(["CALLS", "REFERENCES", "CONTAINS"]), f"n{rng.randrange(nodes):02}") for _ in range(edges)})
    assertion = [("|".join(c), *c) for c in claim]
    observation = [(a[0], rng.choice(["x", "y"]), "1", rng.randrange(12), f"p{rng.randrange(6)}", k, k) for a in assertion for k in range(rng.randrange(4))]
    occurrence = [(f"o{i}", f"n{i:02}", f"p{i % 6}", i, i + 1, i, f"h{i % 5}") for i in range(0, nodes, 3)]
    return {
        "entity": spark.createDataFrame(entity, "entity_id string, kind string, name string, scope_path string"),
        "assertion": spark.createDataFrame(assertion, "assertion_id string, source_id string, relation string, target_id string"),
        "observation": spark.createDataFrame(observation, EVIDENCE),
        "occurrence": spark.createDataFrame(occurrence, "occurrence_id string, entity_id string, file_path string, start_byte int, end_byte int, start_line int, content_hash string"),
    }, assertion


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scoped_derivation_and_pruning_equal_full(spark):
    snap, _ = make(spark)
    state = claims.derive_state(snap["observation"], snap["assertion"], snap["entity"])
    out, touched = claims.delete_paths(snap, spark.createDataFrame([("p1",), ("p2",)], "file_path string"))
    full = claims.prune_orphans(out)
    first = claims.prune_orphans(snap)  # scoped pruning starts from a pruned snapshot
    out2, touched2 = claims.delete_paths(first, spark.createDataFrame([("p1",), ("p2",)], "file_path string"))
    lost = first["occurrence"].join(out2["occurrence"].select("occurrence_id"), "occurrence_id", "left_anti").select("entity_id")
    scoped = claims.prune_scoped(out2, touched2, lost)
    assert rows(scoped["assertion"]) == rows(full["assertion"]) and rows(scoped["entity"].select("entity_id")) == rows(full["entity"].select("entity_id"))
    again = claims.derive_scoped(state, touched, out["observation"], out["assertion"], out["entity"])
    assert rows(again) == rows(claims.derive_state(out["observation"], out["assertion"], out["entity"]))
    assert all(r.offending == 0 for r in claims.validate(full).collect())


def test_upsert_and_batches(spark):
    snap, _ = make(spark)
    batch = {"entity": snap["entity"].withColumn("name", F.when(F.col("entity_id") == "n01", F.lit(None)).otherwise(F.col("name"))), "observation": snap["observation"]}
    once = claims.persist_batch(snap, batch)
    twice = claims.persist_batch(once, batch)
    assert rows(once["entity"]) == rows(twice["entity"]) and rows(once["observation"]) == rows(snap["observation"])
    _, counts = claims.upsert(snap["entity"], batch["entity"], ["entity_id"])
    assert tuple(counts.first()) == (0, 1, 29)
    with pytest.raises(ValueError):
        claims.persist_batch(snap, batch, declared=["AST_DIRECT"])
    gone, touched = claims.withdraw_claims(snap, "p0", "x")
    assert gone["observation"].where("extractor_id = 'y'").count() == snap["observation"].where("extractor_id = 'y'").count() and touched.count() > 0
    kept = claims.delete_directory_containment({**snap, "entity": snap["entity"].withColumn("kind", F.lit("directory"))})
    assert kept["observation"].where("assertion_id LIKE '%CONTAINS%'").count() == 0
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, t int")
    assert rows(claims.latest_wins(old, spark.createDataFrame([(1, "n", 5), (2, "o", 4)], old.schema), ["k"], "t")) == [(1, "n", 5), (2, "b", 5)]


def reach(claim, start, depth, relations):
    """First reach with its edge: frontier order, then relation, neighbour, assertion."""
    seen, frontier, out = set(start), sorted(start), {}
    for level in range(1, depth + 1):
        fresh = []
        for at in frontier:
            for a, s, r, t in sorted((x for x in claim if x[3] == at and x[2] in relations), key=lambda x: (x[2], x[1], x[0])):
                if s not in seen:
                    seen.add(s)
                    fresh.append(s)
                    out[s] = (level, r, at, a)
        frontier = fresh
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_impact_keeps_the_first_edge(spark, seed):
    snap, claim = make(spark, seed)
    found = graph.impact(snap["assertion"], spark.createDataFrame([("n03",)], "entity_id string"), 6)
    want = reach(claim, ["n03"], 6, vocab.IMPACT_RELATIONS)
    assert {r.entity_id: (r.depth, r.relation, r.via_id, r.assertion_id) for r in found.collect()} == want


def test_neighbourhood_budget(spark):
    snap, claim = make(spark, 4)
    got = graph.neighbourhood(snap["assertion"], snap["entity"], "n03", 3, 9)
    nodes = {r.entity_id for r in got["nodes"].collect()}
    admitted, frontier = ["n03"], ["n03"]
    for _ in range(3):
        fresh = []
        for at in frontier:
            for a, s, r, t in sorted((x for x in claim if at in (x[1], x[3])), key=lambda x: (x[2], x[1], x[3], x[0])):
                other = t if s == at else s
                if other not in admitted and len(admitted) < 9:
                    admitted.append(other)
                    fresh.append(other)
        frontier = fresh
    assert nodes == set(admitted)
    assert rows(got["edges"].select("assertion_id")) == sorted((a,) for a, s, _, t in claim if {s, t} <= nodes)
    assert not {r.entity_id for r in got["omitted"].collect()} & nodes


def test_paths(spark):
    snap, claim = make(spark, 5)
    got, cut = graph.find_paths(snap["assertion"], "n01", "n05", 5, 4)

    def walk(path, edges):
        if path[-1] == "n05":
            yield len(edges), edges, path
        elif len(edges) < 5:
            for a, s, r, t in claim:
                if s == path[-1] and t not in path:
                    yield from walk([*path, t], [*edges, f"{r}|{t}|{a}"])

    want = sorted(walk(["n01"], []))[:4]
    assert not cut and [(r.hops, r.edges, r.nodes) for r in got.collect()] == [tuple(w) for w in want]
    assert rows(graph.find_paths(snap["assertion"], "n01", "n01")[0]) == [(0, ["n01"], [])]


def test_cycles_and_closure(spark):
    rng = random.Random(7)
    edges = [(a, b) for a, b in {(rng.randrange(40), rng.randrange(40)) for _ in range(55)}] + [(100 + i, 100 + (i + 1) % 12) for i in range(12)]
    df = spark.createDataFrame(edges, "src long, dst long")

    def forward(n):
        out, todo = set(), [n]
        while todo:
            for b in [b for a, b in edges if a == todo[-1] and b not in out] or [todo.pop()][:0]:
                out.add(b)
                todo.append(b)
        return out

    reach_ = {n: forward(n) for e in edges for n in e}
    comp = {n: min([m for m in reach_[n] if n in reach_[m]] + [n]) for n in reach_}
    big = Counter(comp.values())
    assert dict(rows(graph.cycles(df))) == {n: c for n, c in comp.items() if big[c] > 1}
    got, ended = closure(df, spark.createDataFrame([(100,)], "node long"))
    assert ended and got.count() == 12 and not closure(df, spark.createDataFrame([(100,)], "node long"), 3)[1]


def test_lookup(spark):
    snap, claim = make(spark)
    assert lookup.resolve_selector(snap["entity"], "../x").first().outcome == "refused"
    assert lookup.resolve_selector(snap["entity"], "n03").first().stage == "id"
    assert lookup.resolve_selector(snap["entity"], "m#name3").first().stage == "path_qualified"
    assert lookup.resolve_selector(snap["entity"], "symbol:name3").first().entity_id == "n03"
    assert lookup.search(snap["entity"], "").count() == 0
    first = lookup.entity_list(snap["entity"], snap["occurrence"]).where("entity_id = 'n03'").first()
    assert first.location == "p3:3"
    c = spark.createDataFrame([(True, 1, 0, 0, 0, 0, False, 0, 0), (False, 1, 0, 1, 0, 0, False, 0, 0), (True, 0, 0, 1, 0, 0, False, 0, 0), (True, 1, 0, 1, 0, 0, True, 0, 0), (True, 1, 1, 1, 0, 0, True, 0, 0)], "schema_ok boolean, runs int, running int, changed int, missing int, added int, truncated boolean, refused int, unreadable int")
    assert [r.trust for r in lookup.trust(c).collect()] == ["current", "unusable", "no_index", "stale", "unverified"]


def test_scalars(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../b",), ("",)], "p string")
    assert [r[0] for r in df.select(S.normal_path(F.col("p"))).collect()] == ["a/c", None, None, ""]
    assert S.selector_shape("kind:a/b") == {"qualifier": "kind", "text": "a/b", "path": None, "name": None, "refused": False}
    assert S.selector_shape("a/b:c#d")["qualifier"] is None and S.selector_shape("/abs")["refused"]
    names = spark.createDataFrame([(".env",), ("d/.env.local",), ("id_rsa",), ("a.PEM",), ("x.key",), ("env.txt",)], "p string")
    assert [r[0] for r in names.select(S.is_secret(F.col("p"))).collect()] == [True, True, True, False, True, False]
    one = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string").select(S.digest(F.col("x"), F.col("y"), F.col("z")).alias("d"))
    assert one.distinct().count() == 2
    assert vocab.outside(spark.createDataFrame([("CALLS",), ("calls",), (None,)], "r string"), "r", "relation").count() == 2
    with pytest.raises(ValueError):
        graph.edges_of(spark.createDataFrame([("CALLS",)], "relation string"), relations=["NOPE"])


def test_similar_renames(spark):
    base = "\n".join(f"line {i}" for i in range(20))
    texts = {"b0": base, "b1": base.replace("line 3\n", "other\n"), "b2": base.replace("line", "row"), "b3": "a\nb", "b4": base + "\n\x00", "b5": base + "\nmore"}
    change = [("c1", "old", "deleted", None, "b0"), ("c1", "new", "added", "b1", None), ("c1", "far", "added", "b2", None), ("c1", "bin", "added", "b4", None), ("c1", "new2", "added", "b5", None), ("c2", "only", "added", "b1", None)]
    change += [("c3", f"d{i}", "deleted", None, "b0") for i in range(17)] + [("c3", f"a{i}", "added", "b1", None) for i in range(16)]
    df = spark.createDataFrame(change, "commit_oid string, path string, change_kind string, blob_oid string, prev_blob_oid string")
    pairs, analysis = history.similar_renames(df, spark.createDataFrame(list(texts.items()), "blob_oid string, content string"))
    assert rows(pairs) == [("c1", "old", "new", 19, 20, "many_from"), ("c1", "old", "new2", 20, 21, "many_from")]
    assert {r.commit_oid: r.completeness for r in analysis.collect()} == {"c1": "complete", "c2": "complete", "c3": "refused_bound"}
    same = spark.createDataFrame([("c", "x", "deleted", None, "b"), ("c", "y", "added", "b", None), ("c", "z", "added", "b", None)], df.schema)
    assert [r.ambiguity for r in history.exact_renames(same).collect()] == ["many_from"] * 2 and rows(history.exact_rename_tallies(same)) == [("c", "b", 1, 2)]


def test_state_diff(spark):
    commit = spark.createDataFrame([("a", 1, []), ("b", 2, ["a"]), ("c", 3, ["a"]), ("d", 4, ["b", "c"]), ("e", 5, ["gone"])], "commit_oid string, committer_time long, parent_oids array<string>")
    change = spark.createDataFrame([(x, "p") for x in "abcde"], "commit_oid string, path string")
    kind, commits, changes = history.state_diff(commit, change, "b", "d")
    assert kind == "diff" and [r.commit_oid for r in commits.collect()] == ["d", "c"] and changes.count() == 2
    assert history.state_diff(commit, change, "d", "b")[0] == "not_an_ancestor" and history.state_diff(commit, change, "a", "e")[0] == "ancestry_incomplete"
    assert history.state_diff(commit, change, "a", "zz")[0] == "state_not_recorded" and history.state_diff(commit, change, "a", "d", 1)[0] == "walk_budget_exhausted"
    heads = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, "a", "a"), (4, "a", "b")], "repo_id int, ingested_head string, head string")
    assert [r.freshness for r in sorted(history.history_freshness(heads).collect())] == ["no_history_ingested", "unverifiable", "current", "stale"]


def test_coverage(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 200), ("f", "inner", 10, 20), ("f", "twin", 30, 40), ("f", "twin2", 30, 40)], "file string, symbol string, start_line int, end_line int")
    lines = spark.createDataFrame([("f", n, h) for n, h in ((5, 1), (15, 0), (35, 1), (150, 2), (500, 1))], "file string, line int, hits int")
    got = {r.line: r.symbol for r in coverage.innermost(lines, spans).collect()}
    assert got == {5: "outer", 15: "inner", 35: None, 150: "outer", 500: None}
    assert {(r.symbol, r.degree) for r in coverage.symbol_tallies(lines, spans).collect()} == {("outer", "covered"), ("inner", None)}
    symbols = spark.createDataFrame([("s", "f")], "symbol string, file string")
    none = spark.createDataFrame([], "symbol string, degree string, covered_lines int, run_id int, observation_id int")
    nothing = coverage.gaps(symbols, none, spark.createDataFrame([], "file string"))
    assert tuple(coverage.gap_totals(nothing).first()) == (None,) * 4
    measured = coverage.gaps(symbols, none, spark.createDataFrame([("f",)], "file string"))
    assert tuple(coverage.gap_totals(measured).first()) == (0, 0, 1, 0)
    head = spark.createDataFrame([("c", "m"), ("c", "x"), (None, None)], "git_commit string, content_merkle string")
    assert [r.binding for r in coverage.trace_binding(head, "c", "m").collect()] == ["bound", "stale", "unverified"]
    assert only_by(lines, ["file"], [F.asc("hits")]).count() == 1 and only_by(lines, ["file"], [F.asc(F.lit(1))]).count() == 0


def test_notes(spark):
    ev = spark.createDataFrame([(1, 1, "proposed"), (1, 2, "active"), (2, 1, "active")], "memory_id int, event_id int, to_status string")
    status, illegal = memory.replay(ev)
    assert dict(rows(status)) == {1: "active", 2: "active"} and [r.memory_id for r in illegal.collect()] == [2]
    more = memory.append_events(ev, spark.createDataFrame([(1, 3, "proposed"), (1, 3, "superseded"), (3, 1, "proposed")], ev.schema))
    assert rows(more.where("event_id = 3 OR memory_id = 3")) == [(1, 3, "superseded"), (3, 1, "proposed")]
    notes = spark.createDataFrame([(1, "e1"), (2, "e2"), (3, "e3"), (4, "e4")], "memory_id int, subject string")
    link = spark.createDataFrame([("e2", "e1"), ("e3", "e1"), ("e3", "e5")], "left_id string, right_id string")
    entity = spark.createDataFrame([("e1",), ("e5",)], "entity_id string")
    assert {r.memory_id: r.subject_state for r in memory.subject_state(notes, entity, link).collect()} == {1: "resolved", 2: "via_identity_link", 3: "ambiguous", 4: "missing"}
    reg = spark.createDataFrame([("tombstoned", True, True, "r", "r", "s"), ("active", False, True, "r", "r", "s"), ("active", True, True, "r", "q", "s"), ("active", True, True, "r", "r", None), ("active", True, True, "r", "r", "s")], "status string, path_exists boolean, readable boolean, repo_id string, repo_id_now string, indexed_state string")
    assert [r.availability for r in memory.availability(reg).collect()] == ["tombstoned", "missing", "moved", "partially_indexed", "available"]


def test_incremental(spark):
    imports = spark.createDataFrame([("a/b.ts", "./c"), ("a/b.ts", "../d"), ("a/b.ts", "../../up"), ("a/b.ts", "lodash"), ("a/b.ts", "./none")], "importer string, specifier string")
    paths = spark.createDataFrame([("a/c.tsx",), ("a/c/index.ts",), ("d/index.js",)], "path string")
    got = {r.specifier: (r.target, r.reason) for r in incremental.resolve_imports(imports, paths).collect()}
    assert got == {"./c": ("a/c.tsx", None), "../d": ("d/index.js", None), "../../up": (None, "climbs_above_root"), "lodash": (None, "not_relative"), "./none": (None, "not_indexed")}
    local = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "default"), ("b", "y"), ("c", "z")], "module string, name string")
    named = spark.createDataFrame([("a", "q", "c", "z"), ("d", "y", "c", "z")], "module string, name string, target string, target_name string")
    star = spark.createDataFrame([("a", 0, "b"), ("d", 0, "a"), ("b", 0, "d")], "module string, position int, target string")
    out = {(r.module, r.name): (r.origin_module, r.origin_name) for r in incremental.export_closure(local, named, star).collect()}
    assert out[("a", "x")] == ("a", "x") and out[("a", "y")] == ("b", "y") and out[("d", "y")] == ("c", "z") and ("a", "default") not in out and out[("d", "q")] == ("c", "z")


def test_moves(spark):
    """The next best is taken where the best is claimed; ties take none; groups of many equal files are decided at once."""
    def side(**files):
        return spark.createDataFrame([(p, x) for p, xs in files.items() for x in xs], "path string, symbol string")

    twelve, four = [f"s{i}" for i in range(12)], [f"t{i}" for i in range(4)]
    removed, added = side(a=twelve, b=four, c=four), side(X=[*twelve, *(f"x{i}" for i in range(12))], Y=twelve[:11], P=four, Q=[*four[:3]])
    assert rows(incremental.move_proposals(removed, added).select("from_path", "to_path")) == [("a", "X"), ("b", "P"), ("c", "Q")]
    assert incremental.move_proposals(side(a=four), side(x=four, y=four)).isEmpty()
    many = incremental.move_proposals(side(**{f"f{i:02}": four for i in range(40)}), side(**{f"g{i:02}": four for i in range(40)}))
    assert many.isEmpty()  # all are tied; the last one too, for none is ever claimed
    assert rows(incremental.move_proposals(side(a=["x", "x", "y"]), side(b=["x", "y", "z"])).select("matched", "larger")) == [(2, 3)]


def test_export_chains(spark):
    """A chain of 18 re-exports, and two modules that forward each other."""
    local = spark.createDataFrame([("m0", "x"), ("c", "y"), ("d", "y")], "module string, name string")
    named = spark.createDataFrame([], "module string, name string, target string, target_name string")
    star = spark.createDataFrame([*[(f"m{i}", 0, f"m{i - 1}") for i in range(1, 19)], ("a", 0, "b"), ("a", 1, "d"), ("b", 0, "a"), ("b", 1, "c")], "module string, position int, target string")
    out = {(r.module, r.name): r.origin_module for r in incremental.export_closure(local, named, star).collect()}
    assert out == {("c", "y"): "c", ("d", "y"): "d", ("a", "y"): "c", ("b", "y"): "d"} | {(f"m{i}", "x"): "m0" for i in range(19)}


def test_streamed_evidence_equals_batch(spark, tmp_path):
    snap, _ = make(spark)
    snap["observation"].repartition(3).write.parquet(str(tmp_path / "in"))
    held = {"snap": {**snap, "observation": snap["observation"].limit(0)}}
    batches = []

    def save(new, number):
        held["snap"] = {**new, "observation": spark.createDataFrame(new["observation"].collect(), EVIDENCE)}
        batches.append(number)

    stream = spark.readStream.schema(EVIDENCE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest_evidence(stream, lambda: held["snap"], save, lambda b: {"entity": snap["entity"], "observation": b})
    assert len(batches) >= 2 and rows(held["snap"]["observation"]) == rows(snap["observation"].dropDuplicates(claims.EVIDENCE_KEY))
