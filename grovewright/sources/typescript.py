"""A restricted scanner for TypeScript and JavaScript: structure without a full parser.

It reads what stands in plain sight: imports, exports, re-exports, declarations with their
nesting and span, and literal Express routes. Strings, templates, comments and regular
expressions are blanked first, so braces in them don't count. What it can't decide (computed
names, dynamic imports, object literals with methods) is counted as `unmodelled`, never guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, row string, kind string, name string, scope string, line int, end_line int, target string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]

SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:\[!&|?{};\n])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*""", re.S)
DECLARED = re.compile(
    r"\b(?:(?P<export>export)\s+(?:(?P<default>default)\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:"
    r"(?:async\s+)?(?P<function>function)\s*\*?\s*(?P<f>[A-Za-z_$][\w$]*)?|(?P<class>class)\s+(?P<c>[A-Za-z_$][\w$]*)?(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+))?(?P<impl>[^{;]*)"
    r"|(?P<interface>interface)\s+(?P<i>[A-Za-z_$][\w$]*)|(?:const|let|var)\s+(?P<v>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?P<arrow>(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=;{]+)?=>)?)"
)
METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*(?P<m>[A-Za-z_$#][\w$]*)\s*(?:<[^>(]*>)?\([^()]*\)\s*(?::[^{;=]+)?\{")
IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?(?P<what>[^'";]*?)\s*from\s*(?P<q>['"])(?P<spec>[^'"\n]+)(?P=q)|\bimport\s*(?P<q2>['"])(?P<bare>[^'"\n]+)(?P=q2)|\b(?:const|let|var)\s+(?P<r>[\w${}\s,:]+?)\s*=\s*require\(\s*(?P<q3>['"])(?P<req>[^'"\n]+)(?P=q3)\s*\)""")
EXPORT = re.compile(r"""\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+(?P<ns>[\w$]+))?|\{(?P<names>[^}]*)\})(?:\s*from\s*(?P<q>['"])(?P<spec>[^'"\n]+)(?P=q))?""")
ROUTE = re.compile(r"""\b(?P<app>[A-Za-z_$][\w$]*)\.(?P<verb>get|post|put|delete|patch|head|options)\(\s*(?P<q>['"])(?P<path>[^'"\n]*)(?P=q)\s*,\s*(?:[A-Za-z_$][\w$.]*\s*,\s*)*(?P<handler>[A-Za-z_$][\w$]*)\s*\)""")
WORDS = {"if", "for", "while", "switch", "catch", "with", "return", "function"}


def blank(text: str) -> str:
    """The text with everything that is no code turned to spaces; line breaks stay."""
    return SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(code: str, at: int) -> int:
    """Where the brace that opens at or after `at` closes."""
    start, depth = code.find("{", at), 0
    if start < 0:
        return len(code)
    for i in range(start, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if not depth:
            return i
    return len(code)


def names_of(clause: str) -> Iterator[tuple[str, str]]:
    """(local name, imported name) of an import clause."""
    braces = re.search(r"\{([^}]*)\}", clause)
    rest = clause.replace(braces[0], "") if braces else clause
    for part in rest.split(","):
        part = part.strip()
        if m := re.match(r"\*\s+as\s+([\w$]+)$", part):
            yield m[1], "*"
        elif part:
            yield part, "default"
    for part in braces[1].split(",") if braces else []:
        p = re.sub(r"^type\s+", "", part.strip())
        if p:
            a, _, b = p.partition(" as ")
            yield (b or a).strip(), a.strip()


def scan(path: str, text: str) -> Iterator[tuple]:
    code = blank(text)
    live = lambda m: code[m.start() : m.start() + 3].strip() != ""  # noqa: E731  not inside a comment or string
    line = lambda i: text.count("\n", 0, i) + 1
    for m in IMPORT.finditer(text):
        if live(m):
            spec, clause = m["spec"] or m["bare"] or m["req"], m["what"] or ""
            pairs = list(names_of(clause)) if m["spec"] else [(m["r"].strip(), "*")] if m["req"] and "{" not in m["r"] else [("", "")]
            for name, imported in pairs:
                yield path, "import", "namespace" if imported == "*" else "default" if imported == "default" else "named" if imported else "bare", name, "", line(m.start()), line(m.end()), f"{spec}#{imported}"
    for m in re.finditer(r"\bimport\s*\(", code):
        yield path, "unmodelled", "dynamic_import", "", "", line(m.start()), line(m.start()), None
    for m in EXPORT.finditer(text):
        if live(m):
            if m["names"] is None:
                yield path, "reexport" if m["spec"] else "unmodelled", "namespace" if m["ns"] else "star", m["ns"] or "*", "", line(m.start()), line(m.end()), m["spec"]
            for part in (m["names"] or "").split(","):
                a, _, b = re.sub(r"^type\s+", "", part.strip()).partition(" as ")
                if a.strip():
                    yield path, "reexport" if m["spec"] else "export", "named", (b or a).strip(), "", line(m.start()), line(m.end()), f"{m['spec']}#{a.strip()}" if m["spec"] else a.strip()
    found = []  # (start, end, kind, name, exported as, base)
    for m in DECLARED.finditer(code):
        if m["v"] and not m["arrow"]:
            if m["export"]:
                yield path, "export", "value", m["v"], "", line(m.start()), line(m.end()), m["v"]
            continue
        kind = "class" if m["class"] else "interface" if m["interface"] else "function"
        name = m["f"] or m["c"] or m["i"] or m["v"] or ("default" if m["default"] else None)
        if name is None:
            continue
        end = closing(code, m.end() - 1 if m["arrow"] is None else m.end())
        if m["arrow"] and not re.match(r"\s*\{", code[m.end() :]):
            end = min(x for x in (code.find(";", m.end()), code.find("\n", m.end()), len(code)) if x >= 0)
        found.append((m.start(), end, kind, name, "default" if m["default"] else name if m["export"] else None, m["base"]))
    for s, e, *_ in [x for x in found if x[2] == "class"]:
        body = code.find("{", s)
        for m in METHOD.finditer(code, body, e):
            if m["m"] not in WORDS and code.count("{", body, m.start("m")) - code.count("}", body, m.start("m")) == 1:
                found.append((m.start("m"), closing(code, m.end() - 1), "method", m["m"], None, None))
    found.sort()
    for s, e, kind, name, exported, base in found:
        around = [x for x in found if x[0] < s and e <= x[1] and x[2] != "interface"]
        scope = ".".join(x[3] if x[2] in ("class",) else f"<local:{x[3]}>" for x in around)
        yield path, "symbol", kind, name, scope, line(s), line(min(e, len(text) - 1)), None
        if exported and not around:
            yield path, "export", "local", exported, "", line(s), line(s), name
        if base:
            yield path, "extends", kind, base, scope, line(s), line(s), name
    apps = set(re.findall(r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:express|Router|express\.Router)\(\s*\)", code))
    for m in ROUTE.finditer(text):
        if live(m) and m["app"] in apps:
            yield path, "endpoint", m["verb"].upper(), m["path"], "", line(m.start()), line(m.end()), m["handler"]


def structure(files: DataFrame) -> DataFrame:
    """Rows of all files (path, text)."""

    def run(frames):
        for pdf in frames:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) for r in scan(p, t or "")]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "int32", "end_line": "int32"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)
