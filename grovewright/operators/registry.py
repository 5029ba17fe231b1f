"""Repository registry and cross-repository contracts: guarded writes and the scan of declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.helpers import cascade


def insert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """New entries are active; an id that is known stays as it is."""
    fresh = new.join(registry.select("registry_id"), "registry_id", "left_anti").withColumn("status", F.lit("active"))
    return registry.unionByName(fresh, allowMissingColumns=True)


def update_where(registry: DataFrame, ids: DataFrame, required: str, **columns: Column) -> DataFrame:
    """Set columns of the named entries whose status is `required`; all others stay."""
    marks = ids.select("registry_id").distinct().withColumn("__hit", F.lit(True))
    rows = registry.join(marks, "registry_id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)) & (F.col("status") == required))
    return rows.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in columns.items()}).select(*registry.columns)


def tombstone(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return update_where(registry, ids, "active", status=F.lit("tombstoned"))


def relocate(registry: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    return update_where(registry, ids, "active", path=F.lit(path))


def write_links(link: DataFrame, seen: DataFrame, at: str) -> DataFrame:
    """Links after a scan at a time: an identity seen before only moves its last_seen_at, a new one is inserted.

    The identity is all but link_id, times, hashes and status, so the hashes recorded first
    stay comparable.
    """
    key = ["registry_id", "source_path", "specifier", "target_path", "method"]
    known = seen.select(*key).distinct().withColumn("__seen", F.lit(True))
    touched = link.join(known, key, "left").withColumn("last_seen_at", F.when(F.col("__seen"), F.lit(at)).otherwise(F.col("last_seen_at"))).select(*link.columns)
    fresh = seen.dropDuplicates(key).join(link.select(*key), key, "left_anti").withColumns({"link_id": S.digest(*[F.col(c) for c in key]), "status": F.lit("active"), "last_seen_at": F.lit(at)})
    return touched.unionByName(fresh.select(*link.columns))


def withdraw(link: DataFrame, registry_id: str | None = None, link_id: str | None = None) -> DataFrame:
    hit = (F.col("registry_id") == registry_id) if registry_id is not None else (F.col("link_id") == link_id)
    return link.withColumn("status", F.when(hit & (F.col("status") == "active"), "withdrawn").otherwise(F.col("status")))


def classify(declaration: DataFrame, neighbour: DataFrame) -> DataFrame:
    """Declarations (path, section, name, specifier) with form, verdict and target repository.

    neighbour (registry_id, package, path) are the registered packages. Workspace and
    path forms are checked against the neighbour's path; version ranges link by name only;
    remote forms are unsupported; what names no neighbour is unresolved with a reason.
    """
    spec = F.col("specifier")
    form = cascade([
        (F.col("section").isin("package"), "self"), (F.col("section") == "workspaces", "workspace_glob"),
        (spec.rlike(r"^(git\+|git:|github:|https?:|ssh:)"), "remote"), (spec.startswith("workspace:"), "workspace"),
        (spec.rlike(r"^(file:|link:|portal:|\.{1,2}/)"), "path"), (spec.startswith("npm:"), "alias"), (spec.rlike(r"^[\^~<>=*0-9v ].*$|^$|^latest$"), "range"),
    ], "other")
    rows = declaration.withColumn("form", form)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    target = S.normal_path(F.concat_ws("/", folder, F.regexp_replace(spec, "^(file:|link:|portal:)", "")))
    rows = rows.withColumn("wanted_path", F.when(F.col("form") == "path", target))
    by_name = neighbour.groupBy(F.col("package").alias("name")).agg(F.count("*").alias("n"), F.min("registry_id").alias("by_name"))
    by_path = neighbour.select(F.col("path").alias("wanted_path"), F.col("registry_id").alias("by_path"), F.col("package").alias("package_there"))
    out = rows.join(by_name, "name", "left").join(by_path, "wanted_path", "left")
    climbs = (F.col("form") == "path") & F.col("wanted_path").isNull()
    verdict = cascade([
        (F.col("form") == "self", "not_a_dependency"), (F.col("form").isin("remote", "alias", "other", "workspace_glob"), "unsupported"), (climbs, "unsupported"),
        ((F.col("form") == "path") & F.col("by_path").isNull(), "unresolved"), ((F.col("form") == "path") & (F.col("package_there") != F.col("name")), "unresolved"), (F.col("form") == "path", "linked"),
        (F.col("n") > 1, "ambiguous"), (F.col("n") == 1, "linked"),
    ], "unresolved")
    reason = cascade([(climbs, "escapes_root"), ((F.col("form") == "path") & F.col("by_path").isNull(), "no_neighbour_at_path"), ((F.col("form") == "path") & (F.col("package_there") != F.col("name")), "name_differs"), (F.col("n").isNull() & F.col("form").isin("range", "workspace"), "no_neighbour_of_name")])
    return out.select("path", "section", "name", "specifier", "form", verdict.alias("verdict"), F.when(verdict == "linked", F.coalesce("by_path", "by_name")).alias("target"), reason.alias("reason"))
