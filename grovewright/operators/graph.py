"""Graph questions: impact, neighbourhood, simple paths, explanation, strongly connected components.

A level of a search is one join of the frontier with the edges. Where the answer depends
on the order of discovery, rows carry their rank in it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.vocab import IMPACT_RELATIONS, parse_all
from ..plans.helpers import among, checkpointed, closure, first_by, met, without


def edges_of(assertion: DataFrame, state: DataFrame | None = None, relations: list[str] | None = None, resolved_only: bool = False) -> DataFrame:
    """Claims of the given relations (none: all); a claim without a state counts as resolved."""
    rows = assertion if not relations else assertion.where(F.col("relation").isin(parse_all("relation", relations)))
    if resolved_only and state is not None:
        rows = rows.join(state.select("assertion_id", "is_unresolved"), "assertion_id", "left").where(~F.coalesce("is_unresolved", F.lit(False))).drop("is_unresolved")
    return rows


def impact(assertion: DataFrame, subject: DataFrame, depth: int = 6, relations: list[str] | None = None) -> DataFrame:
    """(entity_id, depth, relation, via_id, assertion_id): all that depends on the subject (entity_id), never cut.

    The edge kept is the first by discovery: frontier rank, then relation, neighbour, assertion.
    """
    edges = edges_of(assertion, relations=relations or IMPACT_RELATIONS).select(F.col("target_id").alias("via_id"), F.col("source_id").alias("entity_id"), "relation", "assertion_id")
    seen = checkpointed(subject.select("entity_id").distinct())
    start = seen.select("entity_id", F.row_number().over(Window.orderBy("entity_id")).cast("long").alias("rank"))  # the subjects of one question
    frontier, parts = start, []
    for level in range(1, depth + 1):
        step = without(met(edges, frontier.withColumnRenamed("entity_id", "via_id"), "via_id"), seen, "entity_id")
        # the edge found first, as a least struct, so that a hub's edges are combined before they are shuffled
        first = step.groupBy("entity_id").agg(F.min(F.struct("rank", "relation", "assertion_id", "via_id")).alias("e"))
        reached = checkpointed(first.select("entity_id", F.lit(level).alias("depth"), "e.relation", "e.via_id", "e.assertion_id", "e.rank"))
        if reached.isEmpty():
            break
        parts.append(reached.drop("rank"))
        if level < depth:
            seen = seen.union(reached.select("entity_id"))
            frontier = dense_ranks(reached, ["rank", "relation", "entity_id", "assertion_id"])
    if parts:
        return reduce(DataFrame.union, parts)
    return step.select("entity_id", F.lit(0).alias("depth"), "relation", "via_id", "assertion_id").limit(0)


def dense_ranks(rows: DataFrame, order: list[str]) -> DataFrame:
    """(entity_id, rank): positions in a total order, from a range partitioning and the sizes of its parts."""
    sorted_ = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    local = sorted_.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = sorted_.groupBy("__part").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return local.join(F.broadcast(base), "__part").select("entity_id", (F.col("base") + F.col("__at")).alias("rank"))


def impact_report(assertion: DataFrame, state: DataFrame | Callable[[DataFrame | None], DataFrame], entity: DataFrame, evidence: DataFrame, freshness: DataFrame, subject: DataFrame, depth: int = 6, relations: list[str] | None = None, limit: int = 50) -> dict[str, DataFrame]:
    """An impact answer: rows in their order up to limit, totals over all of it, and the account of what it can't see.

    evidence: one representative observation a claim (assertion_id, file_path, start_line);
    freshness: (file_path, freshness). The account covers the same relations and is there
    whether or not anything was found. Rows are by depth, kind, qualified name and id.
    state may be a function from claims (assertion_id) to their state, so that the state of
    other claims need not be derived for the rows.
    """
    from .lookup import unresolved_account

    found = checkpointed(impact(assertion, subject, depth, relations))
    claims = checkpointed(found.select("assertion_id").distinct())
    state_of = state if callable(state) else lambda ids: state if ids is None else among(state, ids, "assertion_id")
    seen = among(evidence.select("assertion_id", "file_path", "start_line"), claims, "assertion_id")
    named = met(entity.select("entity_id", "kind", S.qualified_name(F.col("kind"), F.col("scope_path"), F.col("name")).alias("qualified")), found, "entity_id")
    placed = named.join(seen, "assertion_id", "left").join(freshness, "file_path", "left")
    stale = placed.agg(F.count_if(F.col("file_path").isNotNull() & (F.coalesce("freshness", F.lit("file-missing")) != "fresh")).alias("n")).select(F.lit("stale").alias("metric"), F.lit("").alias("name"), "n")
    rows = placed.join(state_of(claims), "assertion_id", "left")
    return {
        "rows": rows.orderBy("depth", "kind", "qualified", "entity_id").limit(limit), "totals": impact_totals(found, entity).union(stale), "unresolved": unresolved_account(state_of(None), assertion, relations or IMPACT_RELATIONS),
    }


def impact_totals(found: DataFrame, entity: DataFrame) -> DataFrame:
    """(metric, name, n) over the whole closure: totals by depth, relation and kind."""
    kinds = checkpointed(met(entity.select("entity_id", "kind"), checkpointed(found), "entity_id"))
    parts = [kinds.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(f"by_{c}").alias("metric"), "name", "n") for c in ("depth", "relation", "kind")]
    parts.append(kinds.agg(F.count("*").alias("n")).select(F.lit("entities"), F.lit(""), "n"))
    return reduce(DataFrame.union, parts)


def neighbourhood(assertion: DataFrame, entity: DataFrame, focus: str, depth: int = 1, max_nodes: int = 60) -> dict[str, DataFrame]:
    """Nodes admitted in order of discovery up to max_nodes, the edges among them, and how many were left out."""
    way = lambda a, b: assertion.select(F.col(a).alias("anchor"), F.col(b).alias("entity_id"), "relation", "source_id", "target_id", "assertion_id")
    both = way("source_id", "target_id").union(way("target_id", "source_id"))
    spark = entity.sparkSession
    admitted = checkpointed(spark.createDataFrame([(focus, 0, 1)], "entity_id string, depth int, rank int"))
    frontier, omitted, n = admitted, [], 1
    for level in range(1, depth + 1):
        step = without(met(both, frontier.select(F.col("entity_id").alias("anchor"), "rank"), "anchor"), admitted, "entity_id")
        first = first_by(step, ["entity_id"], [F.asc("rank"), F.asc("relation"), F.asc("source_id"), F.asc("target_id"), F.asc("assertion_id")])
        found = checkpointed(first.select("entity_id", "rank", "relation", "source_id", "target_id", "assertion_id"))
        room = max_nodes - n
        taken = checkpointed(found.orderBy("rank", "relation", "source_id", "target_id", "assertion_id").limit(max(0, room)).withColumn("place", F.row_number().over(Window.orderBy("rank", "relation", "source_id", "target_id", "assertion_id"))))  # max_nodes rows
        omitted.append(without(found, taken, "entity_id").select("entity_id"))
        frontier = checkpointed(taken.select("entity_id", F.lit(level).alias("depth"), (F.col("place") + n).alias("rank")))
        k = frontier.count()
        if not k:
            break
        n += k
        admitted = checkpointed(admitted.union(frontier))
    inside = among(among(assertion, admitted.withColumnRenamed("entity_id", "source_id"), "source_id"), admitted.withColumnRenamed("entity_id", "target_id"), "target_id")
    left = without(reduce(DataFrame.union, omitted).distinct(), admitted, "entity_id") if omitted else admitted.select("entity_id").limit(0)
    return {"nodes": met(entity, admitted, "entity_id").select("depth", "kind", "name", "entity_id").orderBy("depth", "kind", "name", "entity_id"), "edges": inside.orderBy("relation", "source_id", "target_id", "assertion_id"), "omitted": left}


def find_paths(assertion: DataFrame, source: str, target: str, depth: int = 6, limit: int = 3, directed: bool = True) -> tuple[DataFrame, bool]:
    """(hops, nodes, edges): simple paths, shortest first, then by their edges; and whether the search was cut, which it never is.

    From the target backwards, a level at a time, each node keeps its first simple paths to
    the target by their edges, `width` at most. A row without nodes marks where such a list
    was cut: of what comes at or after its edges nothing is known. Only what precedes every
    mark is an answer; if that is too little, the search is done again with a greater width,
    so nothing is lost to it. From a node to itself there is one empty path.
    """
    spark = assertion.sparkSession
    schema = "hops int, nodes array<string>, edges array<string>"
    if source == target:
        return spark.createDataFrame([(0, [source], [])], schema), False
    e = assertion.select(F.col("source_id").alias("from"), F.col("target_id").alias("at"), F.concat_ws("|", "relation", "target_id", "assertion_id").alias("edge"))
    if not directed:
        e = e.union(assertion.select("target_id", "source_id", F.concat_ws("|", "relation", "source_id", "assertion_id", F.lit("back"))))
    width = 4 * max(limit, 1)
    while (found := paths_within(e.where(F.col("from") != target), source, target, depth, limit, width)) is None:
        width *= 8
    return (reduce(DataFrame.union, found).orderBy("hops", "edges").limit(limit) if found else spark.createDataFrame([], schema)), False


def paths_within(e: DataFrame, source: str, target: str, depth: int, limit: int, width: int) -> list[DataFrame] | None:
    """The paths of find_paths() by their length, from lists of `width` paths a node; none if that is too narrow."""
    tails = checkpointed(e.sparkSession.createDataFrame([(target, [target], [])], "at string, nodes array<string>, edges array<string>"))
    order = Window.partitionBy("at").orderBy("edges")
    found, hits = [], 0
    for hops in range(1, depth + 1):
        # the source is no inner node, so its own list is taken out below
        step = met(e, tails, "at").where(F.col("nodes").isNull() | ~F.array_contains("nodes", F.col("from")))
        grown = step.select(F.col("from").alias("at"), F.concat(F.array("from"), "nodes").alias("nodes"), F.concat(F.array("edge"), "edges").alias("edges")).distinct()
        first = grown.withColumn("n", F.row_number().over(order)).where(F.col("n") <= width + 1)
        first = first.withColumn("nodes", F.when(F.col("n") <= width, F.col("nodes")))
        known = F.count_if(F.col("nodes").isNull()).over(order.rowsBetween(Window.unboundedPreceding, -1)) == 0
        tails = checkpointed(first.withColumn("known", known).where("known").select("at", "nodes", "edges"))
        done = tails.where(F.col("at") == source)
        sizes = tails.agg(F.count("*").alias("all"), F.count_if((F.col("at") == source) & F.col("nodes").isNotNull()).alias("done"), F.count_if((F.col("at") == source) & F.col("nodes").isNull()).alias("cut")).first()
        hits += sizes["done"]
        found.append(done.where("nodes IS NOT NULL").select(F.lit(hops).alias("hops"), "nodes", "edges"))
        if hits >= limit or not sizes["all"]:
            break
        if sizes["cut"]:
            return None
        tails = tails.where(F.col("at") != source)
    return found


def explain(assertion: DataFrame, observation: DataFrame, subject: str, other: str | None = None) -> DataFrame:
    """Every claim that touches the subject (and the other end, if named) with every piece of evidence."""
    touches = (F.col("source_id") == subject) | (F.col("target_id") == subject)
    if other is not None:
        touches = ((F.col("source_id") == subject) & (F.col("target_id") == other)) | ((F.col("source_id") == other) & (F.col("target_id") == subject))
    claims = assertion.where(touches).withColumns({"outgoing": F.col("source_id") == subject, "other_end": F.when(F.col("source_id") == subject, F.col("target_id")).otherwise(F.col("source_id"))})
    rows = claims.join(observation, "assertion_id", "left")
    return rows.orderBy("relation", F.desc("outgoing"), "other_end", "assertion_id", "file_path", "start_line")


def explain_runs(claims: DataFrame, run: DataFrame, freshness: DataFrame) -> DataFrame:
    """Rows of explain() with the state that each piece of evidence was recorded in, by its run, and the freshness of its file."""
    return claims.join(run.select("run_id", "state_id", F.col("finished_at").isNotNull().alias("finished")), "run_id").join(freshness, "file_path", "left")


def reachable(assertion: DataFrame, start: DataFrame, relations: list[str] | None = None, reverse: bool = False, depth: int | None = None) -> DataFrame:
    """(node, depth) along claims; start (node) is included at depth 0."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return closure(edges_of(assertion, relations=relations).select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct(), start, depth)[0]


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of more than one node, by forward-backward colouring.

    Nodes without an edge in or out are trimmed; then each round colours nodes by the
    greatest node that reaches them and takes, from each root backwards, what has its colour.
    """
    left = checkpointed(edges.where("src != dst").select("src", "dst").distinct())
    out = []
    while True:
        while True:  # trim
            n = left.count()
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            left = checkpointed(kept.select("src", "dst"))
            if left.count() == n:
                break
        if not n:
            break
        colour = checkpointed(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            best = colour.join(left, colour["node"] == left["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            nxt = checkpointed(colour.join(best, "node", "left").select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), "colour").toDF("node", "colour", "old"))
            stable = nxt.where("colour != old").isEmpty()
            colour = nxt.drop("old")
            if stable:
                break
        same = left.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2")
        back = checkpointed(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members, _ = closure(back, colour.where("node = colour").select("node"))
        members = checkpointed(members.join(colour, "node").select("node", F.col("colour").alias("component")))
        out.append(members)
        gone = members.select("node")
        left = checkpointed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if not out:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    rows = reduce(DataFrame.union, out)
    big = rows.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("name")).where("n > 1")
    return rows.join(big, "component").select("node", F.col("name").alias("component"))
