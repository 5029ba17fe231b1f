"""Python references: calls and base classes resolved through scopes and imports, or kept with a reason.

Scopes follow the language: a name bound anywhere in a function is local to all of it, the
scope of a class is not searched from its methods, `global` goes to the module and
`nonlocal` to an enclosing function. What can't be decided is an unresolved row, never
dropped: opaque_local, unknown_name, method_on_value, computed_callee, star_import.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, scope string, relation string, name string, line int, target string, reason string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
BUILTINS = set(dir(builtins))


class Scope:
    def __init__(self, kind: str, name: str, parent: Scope | None):
        self.kind, self.name, self.parent = kind, name, parent
        self.symbols: dict[str, str] = {}  # name -> qualified name of a function or class
        self.imports: dict[str, str] = {}  # name -> module or module:name
        self.opaque: set[str] = set()
        self.star, self.globals, self.nonlocals = False, set(), set()

    def path(self) -> str:
        return ".".join(s.name for s in self.chain()[::-1] if s.name)

    def chain(self) -> list[Scope]:
        out, s = [], self
        while s:
            out.append(s)
            s = s.parent
        return out


def bind(scope: Scope, body: list[ast.AST]) -> None:
    """Everything that the statements bind in this scope, nested scopes aside."""
    todo = list(body)
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            scope.symbols[n.name] = f"{scope.path()}.{n.name}".lstrip(".")
            continue
        if isinstance(n, ast.Lambda):
            continue
        if isinstance(n, ast.Import):
            scope.imports |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            scope.star |= any(a.name == "*" for a in n.names)
            scope.imports |= {a.asname or a.name: "." * n.level + (n.module or "") + ":" + a.name for a in n.names if a.name != "*"}
        elif isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            scope.opaque.add(n.id)
        elif isinstance(n, ast.Global):
            scope.globals |= set(n.names)
        elif isinstance(n, ast.Nonlocal):
            scope.nonlocals |= set(n.names)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            scope.opaque.add(n.name)
        elif isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            continue
        todo += ast.iter_child_nodes(n)


def lookup(scope: Scope, name: str) -> tuple[str | None, str | None]:
    """(target, reason) of a bare name."""
    chain = scope.chain()
    if name in scope.globals:
        chain = chain[-1:]
    elif name in scope.nonlocals:
        chain = [s for s in chain[1:] if s.kind == "function"]
    for k, s in enumerate(chain):
        if k and s.kind == "class":
            continue
        if name in s.opaque:
            return None, "opaque_local"
        if name in s.symbols:
            return s.symbols[name], None
        if name in s.imports:
            return "import " + s.imports[name], None
    if any(s.star for s in chain):
        return None, "star_import"
    return (None, "unknown_name") if name not in BUILTINS else ("builtins." + name, None)


def resolve(scope: Scope, node: ast.AST, classes: dict[str, set[str]]) -> tuple[str, str | None, str | None]:
    """(text, target, reason) of a callee or base."""
    text = ast.unparse(node)
    if isinstance(node, ast.Name):
        return text, *lookup(scope, node.id)
    parts, n = [], node
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    if not isinstance(n, ast.Name) or not parts:
        return text, None, "computed_callee"
    parts.reverse()
    target, reason = lookup(scope, n.id)
    if target is None:
        return text, None, "method_on_value" if reason == "opaque_local" else reason
    if target.startswith("import "):
        return text, target + "." + ".".join(parts), None
    if len(parts) == 1 and parts[0] in classes.get(target, ()):
        return text, f"{target}.{parts[0]}", None
    return text, None, "method_on_value"


def references(path: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    module = Scope("module", "", None)
    bind(module, tree.body)
    classes: dict[str, set[str]] = {}

    def declare(body: list, prefix: str) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                name = f"{prefix}.{n.name}".lstrip(".")
                classes[name] = {m.name for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
                declare(n.body, name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                declare(n.body, f"{prefix}.{n.name}".lstrip("."))

    declare(tree.body, "")

    def visit(node: ast.AST, scope: Scope) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(n, ast.Call):
                yield path, scope.path(), "CALLS", *_row(n, resolve(scope, n.func, classes))
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                inner = Scope(kind, getattr(n, "name", ""), scope)
                if kind == "class":
                    for b in n.bases:
                        yield path, scope.path(), "EXTENDS", *_row(b, resolve(scope, b, classes))
                    bind(inner, n.body)
                elif hasattr(n, "args"):
                    a = n.args
                    inner.opaque |= {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]}
                    bind(inner, n.body if isinstance(n.body, list) else [n.body])
                else:
                    for g in n.generators:
                        bind(inner, [g.target])
                declared = inner.globals | inner.nonlocals
                inner.opaque -= declared
            yield from visit(n, inner)

    yield from visit(tree, module)


def _row(node: ast.AST, found: tuple[str, str | None, str | None]) -> tuple:
    text, target, reason = found
    return text, node.lineno, target, reason


def resolved(files: DataFrame) -> DataFrame:
    """References of all files (path, text)."""

    def run(frames):
        for pdf in frames:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) for r in references(p, t or "")]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "int32"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def link_imports(found: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """References whose target is an import, joined to the module's path and symbol where both are indexed.

    modules (path, module), symbols (path, qualified). A from-import may name a symbol or
    a module; a name behind it is a symbol of that. All else stays with `not_indexed`.
    """
    text = F.regexp_replace("target", "^import ", "")
    rows = found.where(F.col("target").startswith("import ")).withColumns({"base": F.regexp_extract(text, r"^([^:.]*(?:\.[^:.]+)*)", 1), "flat": F.translate(text, ":", ".")})
    parts = F.split("flat", r"\.")
    tries = rows.select("*", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("module"), F.array_join(F.slice(parts, n + 1, F.size(parts)), ".").alias("rest")))).alias("at", "x")).select("*", "x.module", "x.rest").drop("x")
    hit = tries.join(modules.select(F.col("path").alias("target_path"), "module"), "module")
    key = ["path", "scope", "relation", "name", "line", "target"]
    best = hit.groupBy(*key).agg(F.min_by(F.struct("target_path", "rest"), "at").alias("b")).select(*key, "b.target_path", "b.rest")
    known = symbols.select(F.col("path").alias("target_path"), F.col("qualified").alias("rest"), F.lit(True).alias("known")).distinct()
    linked = best.join(known, ["target_path", "rest"], "left").where("known OR rest = ''").drop("known")
    return rows.drop("base", "flat").join(linked, key, "left").withColumn("reason", F.when(F.col("target_path").isNull(), "not_indexed"))
