"""Trees, ignore rules, repository listings and exports."""

import json
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F
from test_sessions import column

from ctxlake.operators.symbols import build, extract_symbols, refresh, symbols_of
from ctxlake.sources import exports, files


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, body in {"a.py": b"def a(): b()\n", "sub/b.py": b"def b(): pass\n", "sub/deep/c.md": b"# C\n", "node_modules/x.py": b"def no(): pass\n", ".git/y.py": b"def no(): pass\n", "blob.py": b"\0def no(): pass\n", "x.log": b"l", "skip/z.py": b"def no(): pass\n", "sub/skip.py": b"def no(): pass\n", ".gitignore": b"# c\nskip/\n*.log\n", "sub/.gitignore": b"skip.py\n", "empty.txt": b" \n", "long.txt": b"w" * 300, "go.mod": b"require a.b/c v1.0\n", "sub/__init__.py": b"def i(): pass\n"}.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as out:
            out.write(body)
    os.symlink(f"{root}/a.py", f"{root}/link.py")
    return files.with_content(files.tree(spark, str(root)), str(root))


def test_source_files(tree):
    got = {r.path for r in files.source_files(tree).collect()}
    assert got == {"a.py", "sub/b.py", "sub/deep/c.md", "blob.py", "go.mod", "sub/__init__.py"}
    nodes, edges = build(extract_symbols(files.source_files(tree)))
    assert {r.name for r in nodes.where("kind <> 'module'").collect()} == {"a", "b", "C", "c", "i"} and edges.where("relation = 'calls'").count() == 1


def test_ignore_rules(spark):
    lines = ["*.log", "build/", "/top.py", "docs/**", "!docs/keep.md", "a?c.txt", "[!x]y.md", "**/deep/z", "", "# no", "!"]
    rules = [r for r in (files.ignore_rule(x) for x in lines) if r]
    want = {"x/y.log": True, "build/x.py": True, "build": False, "top.py": True, "sub/top.py": False, "docs/a.md": True, "docs/keep.md": False, "abc.txt": True, "a/c.txt": False, "ay.md": True, "xy.md": False, "q/deep/z": True, "ok.py": False}
    assert dict(zip(want, column(spark, list(want), lambda p: files.ignored(p, rules, ())))) == want
    nested = [files.ignore_rule("*.py", "src/"), files.ignore_rule("!keep.py", "src/in/")]
    assert column(spark, ["src/a.py", "a.py", "src/in/keep.py"], lambda p: files.ignored(p, nested)) == [True, False, False]


def test_store_files(tree):
    rows = files.store_files(tree, 200, 100).collect()
    got = {r.path: r for r in rows}
    assert got["blob.py"].status == "binary" and got["empty.txt"].status == "empty" and got["long.txt"].truncated and len(got["long.txt"].text) == 100 and got["a.py"].status == "indexed"
    assert "node_modules/x.py" not in got and len(files.store_files(tree, 3).collect()) == 3
    assert {r.path: r.ok for r in tree.select("path", files.readable(F.col("content"), F.col("size")).alias("ok")).collect()}["blob.py"] is False


def test_listings(spark):
    one = lambda text, name="text": spark.createDataFrame([(text,)], f"{name} string")
    assert [tuple(r) for r in files.worktrees(one("worktree /a\nHEAD abc\nbranch refs/heads/m\n\nworktree /b\nHEAD def\ndetached\n")).collect()] == [("/a", "abc", "refs/heads/m", False, False), ("/b", "def", None, False, True)]
    assert [tuple(r) for r in files.numstat(one("3\t1\ta.py\n-\t-\tx.png\n")).collect()] == [(3, 1, "a.py"), (None, None, "x.png")]
    assert files.valid_ref("main~1") and not any(map(files.valid_ref, ("", "-x", "a b", "a\0")))
    assert column(spark, ["a.py\n\n b.py \n"], files.changed_names) == [["a.py", "b.py"]]
    pulls = files.pull_requests(one(json.dumps([{"number": 2, "title": "t", "author": {"login": "x"}, "headRefName": "b", "updatedAt": "u", "url": "w"}]), "json"))
    assert tuple(pulls.first()) == (2, "t", "x", "b", "u", "w")
    assert [tuple(r) for r in files.pull_request_files(one('{"number": 2, "files": [{"path": "a"}, {}]}', "json")).collect()] == [(2, "a")]
    lines = ['{"type":"assistant","message":{"usage":{"output_tokens":5}}}', "x", '{"type":"user"}', '{"type":"assistant","message":{"model":"m","usage":{"output_tokens":7}}}', '{"type":"assistant","message":{}}']
    assert tuple(files.transcripts(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, at int, line string")).first()) == ("s", 12, 2, "m")
    sizes = spark.createDataFrame([("d/a.original.md", 10), ("d/a.md", 4), ("d/b.original.md", 3), ("d/b.md", 4), ("a.md", 1)], "path string, size long")
    assert [tuple(r) for r in files.compressed_pairs(sizes).collect()] == [("d/", "a", 10, 4)]
    assert files.tags(spark, "{x").count() == 0 and {tuple(r) for r in files.tags(spark, '{"a":"preferred","b":"odd"}').collect()} == {("a", "preferred")}
    changes = spark.createDataFrame([("a", None), ("c", "contested"), (None, "preferred")], "id string, tag string")
    assert {tuple(r) for r in files.retagged(files.tags(spark, '{"a":"preferred","b":"contested"}'), changes).collect()} == {("b", "contested"), ("c", "contested")}
    asked = spark.createDataFrame([('{"jsonrpc":"2.0","id":1,"method":"m","params":{"a":1}}',), ("{",), ('{"id":2}',)], "line string")
    assert [(r.id, r.method, r.error) for r in files.requests(asked).collect()] == [("1", "m", None), (None, None, -32700), ("2", None, -32600)]


def test_exports(spark, tree, tmp_path):
    nodes, edges = build(extract_symbols(files.source_files(tree)))
    exports.save_graph(nodes, edges, f"{tmp_path}/g")
    again = exports.load_graph(spark, f"{tmp_path}/g")
    assert sorted(map(repr, again[0].collect())) == sorted(map(repr, nodes.collect()))
    exports.save_graph(nodes.where("id <> 'a.py'"), edges, f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        exports.load_graph(spark, f"{tmp_path}/bad")
    text = exports.node_link(nodes, edges)
    back = exports.from_node_link(spark, text)
    assert exports.node_link(*back) == text
    for bad in ("{", "[]", '{"nodes":[],"edges":[{"source":"x","target":"y","relation":"r","provenance":"p"}]}', '{"nodes":[{"id":"a\\u0001","name":"","kind":"","file":"","line":1}],"edges":[]}'):
        with pytest.raises(ValueError):
            exports.from_node_link(spark, bad)
    root = ET.fromstring(exports.graphml(nodes, edges))
    assert len(root.findall(".//{*}node")) == nodes.count() and len(root.findall(".//{*}edge")) == edges.count()
    drawing = exports.svg(nodes, edges, 3)
    assert len(ET.fromstring(drawing).findall("{*}circle")) == 3 and drawing in exports.html(drawing)
    tags = spark.createDataFrame([("a.py::a", "preferred"), ("sub/b.py::b", "contested")], "id string, tag string")
    assert exports.lessons(nodes, tags) == "# Lessons\n\n- a (a.py:1)\n"
    exports.replace_file(f"{tmp_path}/deep/x.md", "t")
    assert open(f"{tmp_path}/deep/x.md").read() == "t" and os.listdir(f"{tmp_path}/deep") == ["x.md"]


def test_caches(spark, tree, tmp_path):
    assert exports.load_index(spark, f"{tmp_path}/none") is None and exports.load_communities(spark, f"{tmp_path}/none").count() == 0
    index = refresh(files.source_files(tree))
    exports.save_index(index, f"{tmp_path}/i")
    kept = exports.load_index(spark, f"{tmp_path}/i")
    assert symbols_of(kept).count() == symbols_of(index).count() and all(r.reused for r in refresh(files.source_files(tree), kept).collect())
    exports.save_index(kept.withColumn("sha256", F.when(F.col("path") == "a.py", "x").otherwise(F.col("sha256"))), f"{tmp_path}/bad")
    assert exports.load_index(spark, f"{tmp_path}/bad") is None
    exports.save_communities(spark.createDataFrame([("a", 1)], "id string, community int"), f"{tmp_path}/c")
    assert exports.load_communities(spark, f"{tmp_path}/c").count() == 1
    assert exports.named_graph("/x/", "my.tree") == "/x/graphs/my.tree"
    with pytest.raises(ValueError):
        exports.named_graph("/x", "../y")
    assert exports.log_query(f"{tmp_path}/log/q.jsonl", {"q": "é"}) and not exports.log_query(f"{tmp_path}/log", {"q": 1}) and json.loads(open(f"{tmp_path}/log/q.jsonl").read()) == {"q": "é"}
