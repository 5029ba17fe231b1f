"""Registry, contracts and Python references."""

from grovewright.operators import memory, registry
from grovewright.sources import pyrefs

SOURCE = '''
import os.path as osp
import pkg.util
from .mod import thing as t, Klass
from other import *

GLOBAL = 1

def helper():
    x = 1
    x()
    GLOBAL()
    return helper

class A(Klass):
    def helper(self):
        helper()
        self.run()
        osp.join("a")
        t()
        pkg.util.go()
        [q() for q in range(3)]

    def shadow(self, t):
        t()

A.helper()
missing()
(lambda: 1)()
'''


def test_python_references(spark):
    df = spark.createDataFrame([("p/a.py", SOURCE), ("p/b.py", "def (")], "path string, text string")
    found = pyrefs.resolved(df)
    got = {(r.scope, r.relation, r.name): (r.target, r.reason) for r in found.collect()}
    assert got[("", "EXTENDS", "Klass")] == ("import .mod:Klass", None)
    assert got[("helper", "CALLS", "x")] == (None, "opaque_local") and got[("helper", "CALLS", "GLOBAL")] == (None, "opaque_local")
    assert got[("A.helper", "CALLS", "helper")] == ("helper", None) and got[("A.helper", "CALLS", "self.run")] == (None, "method_on_value")
    assert got[("A.helper", "CALLS", "osp.join")] == ("import os.path.join", None) and got[("A.helper", "CALLS", "t")] == ("import .mod:thing", None)
    assert got[("A.shadow", "CALLS", "t")] == (None, "opaque_local") and got[("", "CALLS", "A.helper")] == ("A.helper", None)
    assert got[("", "CALLS", "missing")] == (None, "star_import") and got[("", "CALLS", "lambda: 1")] == (None, "computed_callee")
    modules = spark.createDataFrame([("pkg/util.py", "pkg.util")], "path string, module string")
    linked = pyrefs.link_imports(found, modules, spark.createDataFrame([("pkg/util.py", "go")], "path string, qualified string"))
    assert {r.name: (r.target_path, r.rest, r.reason) for r in linked.where("name LIKE 'pkg%' OR name LIKE 'osp%'").collect()} == {"pkg.util.go": ("pkg/util.py", "go", None), "osp.join": (None, None, "not_indexed")}


def test_registry(spark):
    reg = spark.createDataFrame([("r1", "/a", "active"), ("r2", "/b", "tombstoned")], "registry_id string, path string, status string")
    new = registry.insert(reg, spark.createDataFrame([("r1", "/x"), ("r3", "/c")], "registry_id string, path string"))
    moved = registry.relocate(new, spark.createDataFrame([("r2",), ("r3",)], "registry_id string"), "/z")
    gone = registry.tombstone(moved, spark.createDataFrame([("r1",)], "registry_id string"))
    assert sorted(map(tuple, gone.collect())) == [("r1", "/a", "tombstoned"), ("r2", "/b", "tombstoned"), ("r3", "/z", "active")]


def test_links(spark):
    link = spark.createDataFrame([("l1", "r1", "a", "x", "t", "name", "h", "active", "1")], "link_id string, registry_id string, source_path string, specifier string, target_path string, method string, source_hash string, status string, last_seen_at string")
    seen = spark.createDataFrame([("r1", "a", "x", "t", "name", "h2"), ("r1", "b", "x", "t", "name", "h")], "registry_id string, source_path string, specifier string, target_path string, method string, source_hash string")
    out = registry.write_links(link, seen, "2")
    assert sorted((r.source_path, r.source_hash, r.last_seen_at) for r in out.collect()) == [("a", "h", "2"), ("b", "h", "2")]
    assert registry.write_links(out, seen, "2").count() == 2
    assert {r.status for r in registry.withdraw(out, registry_id="r1").collect()} == {"withdrawn"}
    assert {r.ambiguity for r in memory.contract_ambiguity(out).collect()} == {"unique"}


def test_classification(spark):
    rows = [("app/package.json", "dependencies", n, s) for n, s in (("lib", "^1.0"), ("lib", "file:../lib"), ("lib", "file:../other"), ("zed", "workspace:*"), ("two", "1"), ("lib", "git+ssh://x"), ("lib", "file:../../../x"), ("lib", "link:../none"))]
    rows.append(("app/package.json", "package", "app", "1"))
    decl = spark.createDataFrame(rows, "path string, section string, name string, specifier string")
    near = spark.createDataFrame([("r1", "lib", "lib"), ("r2", "oth", "other"), ("r3", "two", "t1"), ("r4", "two", "t2")], "registry_id string, package string, path string")
    got = {(r.name, r.specifier): (r.verdict, r.target, r.reason) for r in registry.classify(decl, near).collect()}
    assert got == {
        ("lib", "^1.0"): ("linked", "r1", None), ("lib", "file:../lib"): ("linked", "r1", None), ("lib", "file:../other"): ("unresolved", None, "name_differs"), ("zed", "workspace:*"): ("unresolved", None, "no_neighbour_of_name"), ("two", "1"): ("ambiguous", None, None),
        ("lib", "git+ssh://x"): ("unsupported", None, None), ("lib", "file:../../../x"): ("unsupported", None, "escapes_root"), ("lib", "link:../none"): ("unresolved", None, "no_neighbour_at_path"), ("app", "1"): ("not_a_dependency", None, None),
    }
