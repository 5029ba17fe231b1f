"""Identity, path, name and selector expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import CONTAINER_KINDS, CONTENT_KINDS, PREFIXES, SYMBOL_KINDS, VOCABULARIES

SEPARATOR = "\x1f"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*fields: Column) -> Column:
    """Hex digest of fields joined by 0x1f; a null field counts as empty, so tuples never shift."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def entity_id(kind: Column, *fields: Column) -> Column:
    prefix = F.coalesce(*[F.when(kind == k, F.lit(p)) for k, p in PREFIXES.items()])
    return F.concat(prefix, F.lit("_"), F.substring(digest(kind, *fields), 1, 32))


def assertion_id(source: Column, relation: Column, target: Column) -> Column:
    return digest(source, relation, target)


def content_merkle(path: str, content: str) -> Column:
    """Aggregate: ordered digest over (path, hash)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(content).alias("h"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["p"], F.lit(SEPARATOR), r["h"], F.lit("\n"))), ""), 256)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_text(c: Column, needle: str) -> Column:
    """Substring search that ignores ASCII case; signs of LIKE have no meaning."""
    return F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def under_path(c: Column, prefix: str) -> Column:
    """c is the path or lies below it; trailing slashes of the path don't count, and "" covers all."""
    p = prefix.rstrip("/")
    return F.lit(True) if not p else (c == p) | c.startswith(p + "/")


def qualified_name(kind: Column, scope: Column, name: Column) -> Column:
    return F.when(kind.isin(SYMBOL_KINDS) & (F.coalesce(scope, F.lit("")) != ""), F.concat_ws(".", scope, name)).otherwise(name)


def repository_path(kind: Column, scope: Column, name: Column) -> Column:
    return F.when(kind.isin(CONTENT_KINDS), scope).when(kind.isin(CONTAINER_KINDS), F.when(F.coalesce(scope, F.lit("")) == "", name).otherwise(F.concat_ws("/", scope, name)))


def location(path: Column, line: Column) -> Column:
    return F.when(path.isNull(), F.lit("-")).when(line.isNull(), path).otherwise(F.concat(path, F.lit(":"), line.cast("string")))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")


def normal_path(c: Column) -> Column:
    """Fold "." and ".." segments; null if the path climbs above its root."""
    parts = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))
    bad = F.array(F.lit("\x00"))
    step = lambda acc, s: (
        F.when(acc == bad, bad).when((s == "..") & (F.size(acc) == 0), bad).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    )
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(folded != bad, F.array_join(folded, "/"))


def safe_path(c: Column) -> Column:
    """Neither absolute nor climbing, without control characters or empty."""
    return (c != "") & ~c.startswith("/") & ~c.rlike(r"[\x00-\x1f\x7f\\]") & ~F.array_contains(F.split(c, "/"), "..")


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), "typescript").when(ext.isin("py", "pyi"), "python").when(ext.isin("md", "markdown"), "markdown")


# Names of files that are never read.
SECRET_PATTERNS = [".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.keystore", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".netrc", ".npmrc", ".pypirc", "credentials"]


def is_secret(path: Column) -> Column:
    import fnmatch

    base = F.substring_index(path, "/", -1)
    return base.rlike("|".join(f"(?:{fnmatch.translate(p)})".replace("\\Z", "$").replace("\\z", "$").replace("(?s:", "(?:") for p in SECRET_PATTERNS))


def category(meta: Column) -> Column:
    """The category that a JSON text names, if it is one of the vocabulary; else, and for what is no JSON, `uncategorised`."""
    named = F.get_json_object(meta, "$.category")
    return F.when(named.isin(VOCABULARIES["unresolved_category"]), named).otherwise("uncategorised")


def degree(meta: Column) -> Column:
    """The degree of coverage that a JSON text names; `covered` where it names none."""
    named = F.get_json_object(meta, "$.degree")
    return F.when(named.isin("covered", "partial"), named).otherwise("covered")


def civil_date(seconds: Column) -> Column:
    """Epoch seconds as a date and time in UTC, to the second; years of more than four digits have no sign."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.ltrim(day.cast("string"), F.lit("+")), F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def selector_shape(selector: str) -> dict:
    """Split a selector into qualifier, path and name.

    A qualifier counts only if its colon stands before any "/" and "#"; a path that climbs
    or is absolute is refused by its syntax.
    """
    text, qualifier = selector, None
    colon = text.find(":")
    stops = [i for i in (text.find("/"), text.find("#")) if i >= 0]
    if colon > 0 and all(colon < i for i in stops) and text[:colon] in {"kind", "symbol", "adr", *PREFIXES}:
        qualifier, text = text[:colon], text[colon + 1 :]
    path, _, name = text.partition("#")
    refused = text.startswith("/") or ".." in path.split("/") or any(ord(c) < 32 for c in text)
    return {"qualifier": qualifier, "text": text, "path": path if "#" in text else None, "name": name or None, "refused": refused}
