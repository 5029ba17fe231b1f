"""Python structure and references from the standard parser, as rows.

Rows: (path, row, kind, name, scope, line, end_line, target). `row` is symbol, import,
call, export or error. A name assigned anywhere in a function is local to all of it;
class scopes are not searched from within methods.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, row string, kind string, name string, scope string, line int, end_line int, target string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def scan(path: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield path, "error", type(e).__name__, "", "", getattr(e, "lineno", 0) or 0, 0, None
        return
    yield from walk(path, tree, [], "module")
    exported = [n for n in tree.body if isinstance(n, (ast.Assign, ast.AnnAssign)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in (n.targets if isinstance(n, ast.Assign) else [n.target]))]
    if len(exported) == 1 and isinstance(exported[0].value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in exported[0].value.elts):
        for e in exported[0].value.elts:
            yield path, "export", "all", e.value, "", e.lineno, e.lineno, None
    elif exported:
        yield path, "export", "unsupported", "", "", exported[0].lineno, exported[0].lineno, None


def walk(path: str, node: ast.AST, scope: list[str], kind: str) -> Iterator[tuple]:
    for child in ast.iter_child_nodes(node):
        here = ".".join(scope)
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(child, ast.ClassDef)
            start = min([child.lineno, *[d.lineno for d in child.decorator_list]])
            yield path, "symbol", "class" if is_class else "method" if kind == "class" else "function", child.name, here, start, child.end_lineno, None
            for b in child.bases if is_class else []:
                yield path, "extends", "class", ast.unparse(b), here, child.lineno, child.lineno, child.name
            token = child.name if is_class or kind == "class" else f"<local:{child.name}>"
            yield from walk(path, child, [*scope, token], "class" if is_class else "function")
            continue
        if isinstance(child, ast.Import):
            for a in child.names:
                yield path, "import", "module", a.asname or a.name.split(".")[0], here, child.lineno, child.end_lineno, a.name
        elif isinstance(child, ast.ImportFrom):
            for a in child.names:
                yield path, "import", "wildcard" if a.name == "*" else "from", a.asname or a.name, here, child.lineno, child.end_lineno, "." * child.level + (child.module or "") + ":" + a.name
        elif isinstance(child, ast.Call):
            yield path, "call", type(child.func).__name__.lower(), ast.unparse(child.func), here, child.lineno, child.end_lineno, None
        yield from walk(path, child, scope, kind)


def structure(files: DataFrame) -> DataFrame:
    """Rows of all files (path, text)."""

    def run(frames):
        for pdf in frames:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) for r in scan(p, t or "")]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "int32", "end_line": "int32"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def disambiguated(rows: DataFrame) -> DataFrame:
    """Symbols with their 0-based number among equals (path, kind, scope, name) in source order."""
    from pyspark.sql import Window

    order = Window.partitionBy("path", "kind", "scope", "name").orderBy("line", "end_line")
    return rows.where("row = 'symbol'").withColumn("disambiguator", F.row_number().over(order) - 1)


def module_candidates(importer: str, target: str) -> list[str]:
    """Paths that an absolute or dotted module name may stand for, first match first; empty if the dots climb above the root."""
    dots = len(target) - len(target.lstrip("."))
    base = importer.split("/")[:-1]
    if dots:
        if dots - 1 > len(base):
            return []
        base = base[: len(base) - (dots - 1)]
    else:
        base = []
    stem = "/".join([*base, *[p for p in target.lstrip(".").split(".") if p]])
    return [f"{stem}.py", f"{stem}/__init__.py"] if stem else ["__init__.py"]


def endpoints(rows_source: DataFrame) -> DataFrame:
    """(path, method, route, handler): literal routes of apps made at the top of a module from FastAPI, APIRouter, Flask or Blueprint."""

    def run(frames):
        for pdf in frames:
            out = []
            for p, t in zip(pdf["path"], pdf["text"]):
                try:
                    tree = ast.parse(t or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                imported = {a.asname or a.name: n.module for n in tree.body if isinstance(n, ast.ImportFrom) for a in n.names if n.module in ("fastapi", "flask") and a.name in ("FastAPI", "APIRouter", "Flask", "Blueprint")}
                apps = {x.id: imported[n.value.func.id] for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id in imported for x in n.targets if isinstance(x, ast.Name)}
                for f in tree.body:
                    for d in f.decorator_list if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) else []:
                        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in apps and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
                            continue
                        verb = d.func.attr
                        if verb in ("get", "post", "put", "delete", "patch", "head", "options"):
                            methods = [verb.upper()]
                        elif verb == "route" and apps[d.func.value.id] == "flask":
                            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
                            literal = isinstance(given, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in given.elts)
                            methods = ["GET"] if given is None else [str(e.value).upper() for e in given.elts] if literal else []
                        else:
                            methods = []
                        out += [(p, m, d.args[0].value, f.name) for m in methods]
            yield pd.DataFrame(out, columns=["path", "method", "route", "handler"])

    return rows_source.select("path", "text").mapInPandas(run, "path string, method string, route string, handler string")
