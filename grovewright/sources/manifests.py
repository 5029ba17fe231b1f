"""package.json and pyproject.toml as rows of declarations; export maps."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_BYTES = 1 << 20
# Conditions of an export map, in order, and fields of old packages.
CONDITIONS, LEGACY = ["import", "require", "default"], ["module", "main", "types"]
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*(?:@\s*(\S+))?(.*)$")


def npm(text: str) -> Iterator[tuple[str, str, str]]:
    """(section, name, specifier)"""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("not an object")
    if isinstance(data.get("name"), str):
        yield "package", data["name"], str(data.get("version") or "")
    for section in ("dependencies", "devDependencies"):
        for k, v in (data.get(section) or {}).items():
            yield section, k, v if isinstance(v, str) else json.dumps(v)
    spaces = data.get("workspaces") or []
    for w in spaces.get("packages", []) if isinstance(spaces, dict) else spaces:
        yield "workspaces", w, ""


def python(text: str) -> Iterator[tuple[str, str, str]]:
    data = tomllib.loads(text)
    project = data.get("project") or {}
    if project.get("name"):
        yield "package", project["name"], str(project.get("version") or "")
    for r in project.get("dependencies") or []:
        m = REQUIREMENT.match(r)
        if m:
            yield "dependencies", normal_name(m[1]), m[3] or m[4].strip()
    poetry = (data.get("tool") or {}).get("poetry") or {}
    for k, v in (poetry.get("dependencies") or {}).items():
        yield "poetry", normal_name(k), v["path"] if isinstance(v, dict) and "path" in v else json.dumps(v) if isinstance(v, dict) else str(v)
    for k, v in (((data.get("tool") or {}).get("uv") or {}).get("sources") or {}).items():
        yield "uv", normal_name(k), v.get("path") or json.dumps(v)


def normal_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def declarations(files: DataFrame) -> DataFrame:
    """(path, section, name, specifier, problem) of manifests (path, text)."""

    def run(frames):
        for pdf in frames:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"]):
                t = t or ""
                if len(t.encode()) > MAX_BYTES:
                    rows.append((p, None, None, None, "too_large"))
                    continue
                try:
                    rows += [(p, *r, None) for r in (python if p.endswith(".toml") else npm)(t)]
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((p, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "section", "name", "specifier", "problem"])

    return files.select("path", "text").mapInPandas(run, "path string, section string, name string, specifier string, problem string")


def split_specifier(specifier: str) -> tuple[str, str] | None:
    """(package, subpath from "."); null for relative and malformed ones."""
    if not specifier or specifier[0] in "./":
        return None
    parts = specifier.split("/")
    n = 2 if specifier[0] == "@" else 1
    if len(parts) < n or not all(parts[:n]):
        return None
    return "/".join(parts[:n]), "/".join([".", *parts[n:]])


def resolve_export(manifest: dict, subpath: str) -> str | None:
    """The file that an export map gives for a subpath, conditions in their order; patterns by their longest prefix."""
    exports = manifest.get("exports")
    if exports is None:
        return next((manifest[k] for k in LEGACY if isinstance(manifest.get(k), str)), None) if subpath == "." else None
    if isinstance(exports, str) or isinstance(exports, dict) and not any(k.startswith(".") for k in exports):
        exports = {".": exports}

    def pick(target, star: str = "") -> str | None:
        if isinstance(target, str):
            return target.replace("*", star)
        if isinstance(target, list):
            return next((x for x in (pick(t, star) for t in target) if x), None)
        if isinstance(target, dict):
            return next((x for x in (pick(target[c], star) for c in CONDITIONS if c in target) if x), None)
        return None

    if subpath in exports:
        return pick(exports[subpath])
    best = max((k for k in exports if "*" in k and subpath.startswith(k.split("*")[0]) and subpath.endswith(k.split("*")[1]) and len(subpath) >= len(k) - 1), key=lambda k: len(k.split("*")[0]), default=None)
    if best is None:
        return None
    head, tail = best.split("*", 1)
    return pick(exports[best], subpath[len(head) : len(subpath) - len(tail)])
