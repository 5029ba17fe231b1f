"""Readers on inputs of our own: Markdown, LCOV, traces, Python, manifests, Git, files."""

import hashlib
import json
import struct
import zlib

import pytest

from grovewright.sources import adr, files, git, manifests, markdown, python_code, traces


def test_markdown():
    text = "---\ntitle: x\n---\n# One\ntext [a](b.md#l) and `[no](x)`\n\n```py\n# not a heading\n```\nTwo\n---\n####### seven\n> # quoted\n\n    # code\n### Three ###\n[r]: <c.md>\nmore\nlines\n====\n"
    got = [(k, v, t) for k, v, t, _ in markdown.scan(text)]
    assert [x for x in got if x[0] == "heading"] == [("heading", 1, "One"), ("heading", 2, "Two"), ("heading", 3, "Three")]
    assert [x[2] for x in got if x[0] == "link"] == ["b.md#l", "c.md"]
    assert len([x for x in got if x[0] == "unsupported"]) == 3 and got[0][0] == "front_matter"


def test_markdown_tables(spark):
    docs = spark.createDataFrame([("a.md", "# A\n\n## B\nx [l](b.md) [e](http://x) [f](#a) [u](../../x)\n\n# C\n")], "path string, text string")
    found = markdown.blocks(docs)
    ends = {r.text: r.end_line for r in markdown.sections(found, spark.createDataFrame([("a.md", 7)], "path string, lines int")).collect()}
    assert ends == {"A": 5, "B": 5, "C": 7}
    links = found.where("kind = 'link'").selectExpr("text AS destination")
    got = {r.destination: r.outcome for r in markdown.link_outcomes(links, spark.createDataFrame([("b.md",)], "path string")).collect()}
    assert got == {"b.md": "file", "http://x": "external", "#a": "fragment", "../../x": "refused"}


def test_lcov(spark, tmp_path):
    (tmp_path / "a.info").write_text("TN:t\nSF:x.ts\nDA:1,0\nDA:2,3\nDA:bad\nend_of_record\nSF:x.ts\nDA:1,5,abc\nend_of_record\nDA:9,9\nend_of_record\nSF:y.ts\nDA:1,1\n")
    lines, refused = traces.read_lcov(spark, str(tmp_path))
    assert sorted((r.file, r.line, r.hits) for r in lines.collect()) == [("x.ts", 1, 5), ("x.ts", 2, 3)]
    assert {r.tag: r.n for r in refused.collect()} == {"bad_line": 1, "record_without_file": 1, "unterminated": 1, "test_name_ignored": 1}


def test_traces(spark, tmp_path):
    header = dict.fromkeys(traces.names(traces.HEADER)) | {"format": "t", "format_version": 1, "repository_root_name": "r", "run_id": "1", "producer_limitations": []}
    record = {"test_id": "t", "caller_file": "a", "caller_line": 1, "callee_file": "b", "callee_line": 2, "count": 3, "resolution": "located"}
    rows = [header, record, record | {"count": 0}, record | {"resolution": "unresolved"}, record | {"unsupported_form": "eval"}]
    (tmp_path / "good.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    (tmp_path / "bad.jsonl").write_text("\n".join(map(json.dumps, [header | {"extra": 1}, record])) + "\n")
    head, body = traces.read_traces(spark, str(tmp_path))
    assert head.count() == 1
    assert sorted(str(r.refused) for r in body.collect()) == ["None", "bad_number", "limitation", "unresolved"]


SOURCE = '''
from fastapi import FastAPI
import os.path as p
app = FastAPI()
__all__ = ["f", "C"]

@app.get("/x")
def f():
    def inner():
        pass
    return p.join("a")

class C(Base):
    def m(self):
        return f()
    def m(self):
        return 1
'''


def test_python(spark):
    df = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def (")], "path string, text string")
    rows = python_code.structure(df).collect()
    symbols = {(r.kind, r.scope, r.name) for r in rows if r.row == "symbol"}
    assert symbols == {("function", "", "f"), ("function", "<local:f>", "inner"), ("class", "", "C"), ("method", "C", "m")}
    assert next(r.line for r in rows if r.name == "f" and r.row == "symbol") == 7
    assert {r.name for r in rows if r.row == "export"} == {"f", "C"} and [r.path for r in rows if r.row == "error"] == ["b.py"]
    numbered = python_code.disambiguated(python_code.structure(df)).where("name = 'm'").collect()
    assert sorted(r.disambiguator for r in numbered) == [0, 1]
    assert [tuple(r) for r in python_code.endpoints(df).collect()] == [("a.py", "GET", "/x", "f")]
    assert python_code.module_candidates("p/q/a.py", "..x.y") == ["p/x/y.py", "p/x/y/__init__.py"] and python_code.module_candidates("a.py", "...x") == []


def test_manifests(spark):
    npm = json.dumps({"name": "@o/app", "version": "1", "dependencies": {"lib": "workspace:*"}, "workspaces": ["p/*"]})
    py = '[project]\nname = "S_x"\ndependencies = ["Foo.Bar>=1", "z @ file:../z"]\n[tool.uv.sources]\nfoo-bar = { path = "../f" }\n'
    df = spark.createDataFrame([("package.json", npm), ("pyproject.toml", py), ("x/package.json", "[")], "path string, text string")
    rows = {(r.section, r.name, r.specifier) for r in manifests.declarations(df).collect() if r.problem is None}
    assert rows == {("package", "@o/app", "1"), ("dependencies", "lib", "workspace:*"), ("workspaces", "p/*", ""), ("package", "S_x", ""), ("dependencies", "foo-bar", ">=1"), ("dependencies", "z", "file:../z"), ("uv", "foo-bar", "../f")}
    assert manifests.split_specifier("@o/p/a/b") == ("@o/p", "./a/b") and manifests.split_specifier("./a") is None
    m = {"exports": {".": {"require": "./r.js", "import": "./i.js"}, "./f/*": "./src/*.js", "./f/deep/*": {"default": "./d/*.js"}}}
    assert manifests.resolve_export(m, ".") == "./i.js" and manifests.resolve_export(m, "./f/a") == "./src/a.js"
    assert manifests.resolve_export(m, "./f/deep/a") == "./d/a.js" and manifests.resolve_export(m, "./no") is None
    assert manifests.resolve_export({"main": "m.js"}, ".") == "m.js"


def obj(kind: str, body: bytes) -> tuple[str, bytes]:
    data = f"{kind} {len(body)}".encode() + b"\0" + body
    return hashlib.sha1(data).hexdigest(), data


@pytest.fixture
def repository(tmp_path):
    """Three commits: the objects of the first are loose, of the others in a pack with an offset delta."""
    objects = tmp_path / "objects"
    entries = lambda *e: b"".join(m.encode() + b" " + n.encode() + b"\0" + bytes.fromhex(o) for m, n, o in e)
    commit = lambda tree, parents, t, msg: f"tree {tree}\n{''.join(f'parent {p}\n' for p in parents)}author A <a> {t} +0000\ncommitter A <a> {t} +0000\n\n{msg}\n".encode()
    loose, packed = [], []
    one, d1 = obj("blob", b"one\n" * 50)
    sub, d2 = obj("tree", entries(("100644", "a.txt", one)))
    root, d3 = obj("tree", entries(("40000", "d", sub)))
    c1, d4 = obj("commit", commit(root, [], 100, "first"))
    loose += [(one, d1), (sub, d2), (root, d3), (c1, d4)]
    base = b"two\n" * 60
    two, _ = obj("blob", base)
    three, _ = obj("blob", base + b"tail\n")
    t2, _ = obj("tree", entries(("100644", "b.txt", two), ("40000", "d", sub)))
    c2, _ = obj("commit", commit(t2, [c1], 200, "second"))
    t3, _ = obj("tree", entries(("100755", "b.txt", three)))
    c3, _ = obj("commit", commit(t3, [c2], 300, "third"))
    for oid, data in loose:
        p = objects / oid[:2] / oid[2:]
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(zlib.compress(data))
    out, offsets = bytearray(b"PACK" + struct.pack(">II", 2, 6)), {}

    def head(kind, size):
        byte, size, h = (kind << 4) | (size & 15), size >> 4, bytearray()
        while size:
            h.append(byte | 128)
            byte, size = size & 127, size >> 7
        return bytes(h) + bytes([byte])

    def put(oid, kind, body, prefix=b""):
        offsets[oid] = len(out)
        out.extend(head(kind, len(body)) + prefix + zlib.compress(body))

    put(two, 3, base)
    varint = lambda n: bytes([n & 127 | 128, n >> 7]) if n > 127 else bytes([n])
    delta = varint(len(base)) + varint(len(base) + 5) + bytes([0x80 | 0x10, len(base)]) + bytes([5]) + b"tail\n"
    back = len(out) - offsets[two]
    put(three, 6, delta, bytes([back]) if back < 128 else bytes([(back >> 7) - 1 | 128, back & 127]))
    for oid, kind, body in ((t2, 2, entries(("100644", "b.txt", two), ("40000", "d", sub))), (t3, 2, entries(("100755", "b.txt", three))), (c2, 1, commit(t2, [c1], 200, "second")), (c3, 1, commit(t3, [c2], 300, "third"))):
        put(oid, kind, body)
    names = sorted(offsets)
    fan = b"".join(struct.pack(">I", sum(int(n[:2], 16) <= i for n in names)) for i in range(256))
    index = b"\xfftOc\0\0\0\2" + fan + b"".join(bytes.fromhex(n) for n in names) + b"\0" * 4 * len(names) + b"".join(struct.pack(">I", offsets[n]) for n in names)
    (objects / "pack").mkdir()
    (objects / "pack/p.idx").write_bytes(index)
    (objects / "pack/p.pack").write_bytes(bytes(out))
    (tmp_path / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / "packed-refs").write_text(f"# pack-refs\n{c3} refs/heads/main\n")
    return tmp_path, (c1, c2, c3), (one, two, three)


def test_git(spark, repository):
    path, (c1, c2, c3), (one, two, three) = repository
    commits, changes, end = git.history(spark, str(path))
    assert end == "exhausted" and [r.summary for r in commits.orderBy("committer_time").collect()] == ["first", "second", "third"]
    got = {tuple(r) for r in changes.collect()}
    assert got == {(c1, "d/a.txt", "added", None, one), (c2, "b.txt", "added", None, two), (c3, "b.txt", "modified", two, three), (c3, "d/a.txt", "deleted", one, None)}
    assert git.Store(path).read(three)[1].endswith(b"tail\n")
    assert git.history(spark, str(path), budget=1)[2] == "commit_budget"
    (path / "shallow").write_text(c2 + "\n")
    commits, _, end = git.history(spark, str(path))
    assert end == "shallow_boundary" and commits.count() == 2
    with pytest.raises(git.GitError):
        git.apply_delta(b"abc", bytes([9, 1, 1]) + b"x")


def test_files(spark, tmp_path):
    for name, text in {"a.py": "x", "id_rsa": "s", "d/b.md": "l1\nl2\nl3", "node_modules/c.js": "no", "d/skip.log": "l", "big.ts": "x" * (files.MAX_BYTES + 1)}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    found = files.discover(spark, str(tmp_path), ["*.log", "# c", "d/", "!d/b.md"])
    got = {r.path: (r.outcome, r.language) for r in found.collect()}
    assert got == {"a.py": ("file", "python"), "id_rsa": ("denied", None), "d/b.md": ("file", "markdown"), "d/skip.log": ("ignored", None), "big.ts": ("skipped", "typescript")}
    assert files.snippet(found, "d/b.md", 2, 3).first().text == "l2\nl3"


def test_adr(spark):
    rows = [("adr/0001-a.md", "# ADR-1\nStatus: Accepted\n"), ("adr/0002-b.md", "# B\n\n## Status\n\nAccepted\nSupersedes: [one](0001-a.md)\n"), ("adr/0003-c.md", "Supersedes: ADR-2\n"), ("adr/0004-d.md", "Supersedes: ADR-1 and ADR-2\nStatus: **Rejected**\n"), ("adr/0005-e.md", "Supersedes: ADR-77\n")]
    found = adr.records(spark.createDataFrame(rows, "path string, text string"))
    links = adr.supersession(found)
    assert {(r.source[-4], r.target and r.target[-4], r.reason) for r in links.collect()} == {("b", "a", None), ("c", "b", None), ("e", None, "no_such_number")}
    assert [r.path for r in found.where("ambiguous").collect()] == ["adr/0004-d.md"] and adr.contradictions(links, found).first()[0] == 2


TS = """
import express, { Router as R, type T } from 'express';
import * as fs from "fs";
// import no from 'no';
const util = require('./util');
export * from './star';
export { a as b } from './named';
export const LIMIT = 3;
const s = "function fake() {}", r = /function no\\(\\) {/;
const app = express();
export default class Car extends base.Vehicle<T> implements X {
  private speed = 1;
  drive(to: string): void {
    if (to) { const inner = () => { return 1; }; }
  }
}
export function list(req, res) { return `}${req}`; }
const arrow = async (x: number): Promise<void> => { await import('./late'); };
interface Shape { area(): number }
app.get('/items', list);
other.get('/no', list);
export { arrow };
"""


def test_typescript(spark):
    from grovewright.sources import typescript

    rows = typescript.structure(spark.createDataFrame([("a.ts", TS)], "path string, text string")).collect()
    of = lambda row: {(r.kind, r.name, r.target) for r in rows if r.row == row}
    assert of("import") == {("default", "express", "express#default"), ("named", "R", "express#Router"), ("named", "T", "express#T"), ("namespace", "fs", "fs#*"), ("namespace", "util", "./util#*")}
    assert of("reexport") == {("star", "*", "./star"), ("named", "b", "./named#a")}
    assert of("export") == {("value", "LIMIT", "LIMIT"), ("local", "default", "Car"), ("local", "list", "list"), ("named", "arrow", "arrow")}
    symbols = {(r.kind, r.scope, r.name) for r in rows if r.row == "symbol"}
    assert symbols == {("class", "", "Car"), ("method", "Car", "drive"), ("function", "Car.<local:drive>", "inner"), ("function", "", "list"), ("function", "", "arrow"), ("interface", "", "Shape")}
    assert of("extends") == {("class", "base.Vehicle", "Car")} and of("endpoint") == {("GET", "/items", "list")} and of("unmodelled") == {("dynamic_import", "", None)}
