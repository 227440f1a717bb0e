from stratalens.sources import repo
from stratalens.sources.parsers import headings, parse, sections

MODULE = '''"""Reads things.

More.
"""
import os
from pkg.mod import Thing as T

LIMIT = 10
KEY = "s3cret-value"
TABLE = {"a": 1}
log = make()


class Color(IntEnum):
    RED = 1


class Reader(Base, metaclass=Meta):
    name: Literal["top"] = "x"

    def read(self, path: str = "hidden", *, n=3) -> Literal["deep"]:
        local = 5
        return self.inner.load(path)


async def run():
    Reader().read("a")
'''


def test_python():
    path, lang, sha, lines, symbols, edges = parse("a/b.py", MODULE.encode())
    by = {s["name"]: s for s in symbols}
    assert (path, lang, lines, len(sha)) == ("a/b.py", "python", MODULE.count("\n") + 1, 64)
    assert by["<module>"]["signature"] == "Reads things."
    assert by["LIMIT"]["signature"] == "LIMIT = 10" and by["KEY"]["signature"] == "KEY = <str>" and by["TABLE"]["signature"] == "TABLE = <dict>"
    assert "log" not in by and "Reader.read.local" not in by
    assert by["Color.RED"]["kind"] == "enum_member" and by["Reader.name"]["signature"] == "name: Literal[<str>] = <str>"
    assert by["Reader"]["signature"] == "class Reader(Base, metaclass=Meta)"
    assert by["Reader.read"]["kind"] == "method" and by["Reader.read"]["signature"] == "def read(self, path: str=<str>, *, n=3) -> Literal[<str>]"
    assert by["run"]["signature"] == "async def run()"
    e = {(x["from_name"], x["to_name"], x["kind"]) for x in edges}
    assert {("<module>", "os", "import"), ("<module>", "pkg.mod.Thing", "import"), ("Color", "IntEnum", "inherit"), ("Reader", "Base", "inherit")} <= e
    assert {("Reader.read", "self.inner.load", "call"), ("Reader.read", "load", "call"), ("run", "Reader", "call"), ("run", "read", "call"), ("<module>", "make", "call")} <= e
    assert not any(x in str(symbols) for x in ("s3cret", "hidden", "deep", '"top"'))


def test_bad_python_keeps_its_lines():
    assert parse("x.py", b"def (\n\n")[3:] == (3, [], [])


def test_markdown():
    text = "# A\n\n## B\n```\n# no\n~~~\n```\n### C\n## B\n## B #2\n"
    assert [h[:2] for h in headings(text.splitlines())] == [(1, "A"), (2, "B"), (3, "C"), (2, "B"), (2, "B #2")]
    s = sections(headings(text.splitlines()), 10)
    assert [(x[0], x[2], x[4]) for x in s] == [("A", 1, 10), ("B", 3, 8), ("C", 8, 8), ("B #2", 9, 9), ("B #2 #2", 10, 10)]


def test_braces():
    js = 'import {a} from "lib/a";\n// call(x)\nfunction go(x) { return a.run(x, "no(") }\nclass K {\n  m(y) { go(y) }\n}\nconst f = (z) => go(z);\n'
    _, lang, _, _, symbols, edges = parse("x.js", js.encode())
    assert lang == "javascript" and {"go", "K", "K.m", "f"} <= {s["name"] for s in symbols}
    e = {(x["from_name"], x["to_name"], x["kind"]) for x in edges}
    assert {("<module>", "lib/a", "import"), ("go", "a.run", "call"), ("go", "run", "call"), ("K.m", "go", "call")} <= e
    assert not any(t in ("call", "no") for _, t, _ in e)
    java = "import a.b.C;\npublic class P {\n  public int size(int n) {\n    return new C(n).len();\n  }\n}\n"
    _, _, _, _, symbols, edges = parse("P.java", java.encode())
    assert {"P", "P.size"} <= {s["name"] for s in symbols}
    assert {("<module>", "a.b.C", "import"), ("P.size", "C", "call")} <= {(x["from_name"], x["to_name"], x["kind"]) for x in edges}
    c = '#include <stdio.h>\nint add(int a, int b) {\n  printf("x");\n  return a;\n}\n'
    _, lang, _, _, symbols, edges = parse("m.c", c.encode())
    assert lang == "c" and [s["name"] for s in symbols] == ["add"]
    assert {("<module>", "stdio.h", "import"), ("add", "printf", "call")} <= {(x["from_name"], x["to_name"], x["kind"]) for x in edges}


def test_braces_survive_any_tokens():
    """Deep nesting, brackets that nothing opens or closes, keywords in odd places: always a result."""
    for path in ("x.ts", "x.java", "x.c", "x.cpp"):
        for text in ("[ ~ class K ] function { x", "] class A } ) {", "class A { " * 400 + "} " * 400, "function f() { " * 400 + "} " * 400, "f(" * 2000, "let a, b, c\n" * 50, "class", "", "template <", "enum class"):
            assert parse(path, text.encode())[3] == text.count("\n") + 1
    names = {s["name"] for s in parse("x.js", b"let a, b = () => 1, c, d = (x) => x;\n")[4]}
    assert names == {"b", "d"}


def test_repository_to_graph(spark, tmp_path):
    """Two modules, a call across files, a hidden-looking file name: all of them are indexed and resolved."""
    from stratalens.operators import graph as G

    pkg = tmp_path / "pkg"
    (pkg / "__pycache__").mkdir(parents=True)
    (pkg / "__init__.py").write_text("")
    (pkg / "_maker.py").write_text("def build(x: int) -> int:\n    return x\n\n\nclass Maker:\n    def make(self):\n        return build(1)\n")
    (pkg / "flow.py").write_text("from pkg._maker import Maker, build\n\n\ndef flow():\n    m = Maker()\n    m.make()\n    return build(2)\n")
    (pkg / "__pycache__" / "x.py").write_text("def no(): pass\n")
    (pkg / "a.key.md").write_text("# side\n")
    (pkg / "b.go").write_text("package b\n")
    listed = repo.paths(spark, [str(tmp_path)])
    assert repo.index_roots(str(tmp_path)) == [str(pkg)]
    assert [tuple(r) for r in repo.unsupported(listed).collect()] == [(".go", 1)] and repo.sidecars(listed).count() == 1
    files, symbols, edges = repo.relations(repo.parse_files(repo.sources(listed)))
    assert {r["path"].rsplit("/", 1)[1] for r in files.collect()} == {"__init__.py", "_maker.py", "flow.py"}
    pairs = G.file_graph(G.resolve(edges, symbols)).collect()
    assert [(p["from_path"][-7:], p["to_path"][-9:]) for p in pairs] == [("flow.py", "_maker.py")]
    from pyspark.sql import functions as F

    stems = files.select("path", F.regexp_extract("path", "([^/]+)\\.py$", 1).alias("stem"))
    got = {(r["name"], r["from_path"][-7:]) for r in G.gated_callers(symbols, edges, stems).collect()}
    assert {("build", "flow.py"), ("Maker", "flow.py"), ("Maker.make", "flow.py")} <= got
