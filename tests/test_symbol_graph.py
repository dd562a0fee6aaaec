"""Graphs of sources, questions to them and algorithms over them, against plain Python and facts stated by hand."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from ctxlake.operators import explore, network
from ctxlake.operators import graph as plain_graph
from ctxlake.operators.symbols import build, changed, extract_symbols, refresh, stamp, symbols_of

ALPHA = "import json\n\ndef load_config(path):\n    return json.load(path)\n\ndef parse_entry(raw):\n    return load_config(raw)\n\nclass Store:\n    def save(self):\n        return parse_entry(1)\n"
BETA = "from alpha import parse_entry\n\ndef run_pipeline(x):\n    return parse_entry(x)\n"
HUB = "def log(m):\n    return m\n\n" + "".join(f"def task_{i}():\n    log({i})\n\n" for i in range(30))
TYPES = "class Base:\n    pass\nclass Child(Base):\n    pass\n"
FILES = {"alpha.py": ALPHA, "beta.py": BETA, "hub.py": HUB, "sub/types.py": TYPES, "web.js": "export function parseEntry() {}\nfunction render() { parseEntry() }\n", "package.json": '{"dependencies": {"left": "1"}}'}


def table_of(spark, files):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")


@pytest.fixture(scope="module")
def g(spark):
    return explore.Graph(*build(extract_symbols(table_of(spark, FILES))))


def test_edges_and_their_provenance(g):
    edges = {(e.source, e.target, e.relation, e.provenance) for e in g.edges.collect()}
    for e in [("beta.py::run_pipeline", "alpha.py::parse_entry", "calls", "INFERRED"), ("alpha.py::parse_entry", "alpha.py::load_config", "calls", "EXTRACTED"), ("beta.py::parse_entry", "alpha.py::parse_entry", "imports", "INFERRED"), ("alpha.py", "alpha.py::Store", "defines", "EXTRACTED"), ("sub/types.py::Child", "sub/types.py::Base", "inherits", "EXTRACTED"), ("package.json", "package.json::left", "depends_on", "EXTRACTED"), ("beta.py::parse_entry", "alpha.py", "imports", "INFERRED")]:
        assert e in edges
    ids = {n.id for n in g.nodes.collect()}
    assert all(s in ids and t in ids and s != t for s, t, _, _ in edges) and len({e[:3] for e in edges}) == len(edges)


def plain_build(files):
    """The same graph, one symbol after the other."""
    from ctxlake.functions.extract import stem, symbols

    nodes, edges, seen, rows = {}, [], set(), []

    def node(i, *what):
        if i in nodes:
            i = f"{i}@{what[-1]}"
            if i in nodes:
                return i
        nodes[i] = what
        return i

    def edge(s, t, r, p):
        if s != t and (s, t, r) not in seen:
            seen.add((s, t, r))
            edges.append((s, t, r, p))

    for path in sorted(files, key=lambda p: [*("1" + x for x in p.split("/")[:-1]), "0" + p.split("/")[-1]]):
        own = symbols(path, files[path].encode())
        module = own and node(path, stem(path), "module", path, 1)
        for s in own:
            i = node(f"{path}::{s.name}", s.name, s.kind, path, s.line)
            rows.append((path, i, s))
            edge(module, i, "defines", "EXTRACTED")
            if s.kind == "dependency":
                edge(module, i, "depends_on", "EXTRACTED")
    short = {}
    for i, (name, kind, *_) in nodes.items():
        if kind not in ("import", "dependency"):
            short.setdefault(name.rsplit(".", 1)[-1], []).append(i)
    for path, i, s in rows:
        for ref in dict.fromkeys(s.refs):
            targets = short.get(ref, [])
            same = [t for t in targets if nodes[t][2] == path]
            for t in same + ([t for t in targets if t not in same] if len(targets) <= 8 else []):
                relation = "inherits" if ref in s.inherits else "implements" if ref in s.implements else {"import": "imports", "dependency": "depends_on"}.get(s.kind) or ("calls" if nodes[t][1] in ("function", "method") else "references")
                edge(i, t, relation, "EXTRACTED" if t in same else "INFERRED")
    return nodes, edges


def test_build_equals_insertion_one_by_one(spark, g):
    rng = random.Random(1)
    names = [f"f{i}" for i in range(12)] + ["get"]
    body = lambda: "".join(f"def {rng.choice(names)}():\n    {rng.choice(names)}(); {rng.choice(names)}()\n" for _ in range(5))
    more = {f"{d}m{i}.py": body() for i, d in enumerate(["", "a/", "a/b/", "c/", "", "a/", "c/", "a/", "", "c/"])}
    for files, got in ((FILES, g), (more, explore.Graph(*build(extract_symbols(table_of(spark, more)))))):
        nodes, edges = plain_build(files)
        assert [r.id for r in got.nodes.orderBy("ord").collect()] == list(nodes)
        assert [(e.source, e.target, e.relation, e.provenance) for e in got.edges.orderBy("ord").collect()] == edges


def plain_walk(nodes, edges, seeds, depth, limit, cap, mode):
    out, inc = {}, {}
    for s, t, *_ in edges:
        out.setdefault(s, []).append(t)
        inc.setdefault(t, []).append(s)
    near = lambda i: list(dict.fromkeys(x for x in out.get(i, []) + inc.get(i, []) if x != i))
    degree = lambda i: len(out.get(i, [])) + len(inc.get(i, []))
    chosen, seen, open_ = [], set(), deque((s, 0) for s in seeds)
    while open_:
        i, d = open_.pop() if mode == "dfs" else open_.popleft()
        if i in seen:
            continue
        seen.add(i)
        if len(chosen) >= limit:
            return chosen, True
        chosen.append(i)
        if d < depth and (degree(i) <= cap or i in seeds):
            step = near(i)
            open_.extend((n, d + 1) for n in (reversed(step) if mode == "dfs" else step) if n not in seen)
    return chosen, False


@pytest.mark.parametrize("mode,depth,limit,cap", [("bfs", 3, 20, None), ("bfs", 3, 100, 5), ("bfs", 3, 100, 10_000), ("dfs", 3, 12, None), ("dfs", 2, 100, 10_000), ("bfs", 0, 3, None)])
def test_walks(g, mode, depth, limit, cap):
    nodes, edges = plain_build(FILES)
    seeds = ["hub.py::task_3", "alpha.py::Store", "web.js"]
    assert explore.walk(g, seeds, depth, limit, cap, mode) == plain_walk(nodes, edges, seeds, depth, limit, g.threshold if cap is None else cap, mode)


def test_a_hub_is_kept_but_not_left(g):
    capped = explore.ask(g, "task_3", limit=100, cap=5)
    ids = [r.id for r in capped.nodes]
    assert "hub.py::log" in ids and sum(i.startswith("hub.py::task_") for i in ids) < 6
    assert len(explore.ask(g, "task_3", limit=100, cap=10_000).nodes) > len(ids) + 10
    assert [r.id for r in plain_graph.hubs(g.nodes, g.edges).collect()] == ["hub.py::log"]


def test_questions(spark, g):
    got = explore.ask(g, "parse entry pipeline")
    listed = [r.listed for r in got.nodes]
    assert "alpha.py:6  parse_entry [function]" in listed and len(listed) <= 20 and all("def " not in x for x in listed)
    ids = {r.id for r in got.nodes}
    assert got.edges and all(e.source in ids and e.target in ids for e in got.edges)
    assert explore.ask(g, "prase_entyr confg").seeds and not explore.ask(g, "zzzxqwvk").seeds and not explore.ask(g, "").nodes
    assert explore.question("how does the cache work") == ["cache"] and explore.question("how does the") == ["how", "does", "the"]
    small = explore.ask(g, "parse entry pipeline", budget=60)
    assert small.packed and small.truncated and 1 <= len(small.nodes) < len(listed)
    tags = spark.createDataFrame([("web.js::parseEntry", "preferred"), ("alpha.py::parse_entry", "contested")], "id string, tag string")
    first = lambda t: explore.ask(g, "parse entry", tags=t).seeds[0]
    assert first(tags) == "web.js::parseEntry" != first(None)


def test_scores_against_plain_python(g):
    import math
    import re

    rows = g.nodes.join(g.degree, "id").collect()
    words = lambda t: re.findall("[a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", t).lower())
    tokens = {r.id: set(words(r.name)) | set(words(r.file.split("/")[-1])) for r in rows}
    for text in ("parse entry pipeline", "task loads configs", "savee"):
        asked = explore.question(text)
        idf = {t: math.log((len(rows) + 1) / (sum(t in x for x in tokens.values()) + 1)) + 1 for t in asked}
        want = {}
        for r in rows:
            total = 0
            for t in asked:
                own = tokens[r.id]
                total += idf[t] if t in own else 0.5 * idf[t] if len(t) >= 3 and t in r.name.lower() else 0.4 * idf[t] if len(t) >= 4 and any((k.startswith(t) or t.startswith(k)) and len(k) >= 4 for k in own) else 0
            if total:
                want[r.id] = total * (1.2 if r.kind in ("function", "method", "class") else 1)
        got = {r.id: r.score for r in explore.seed_scores(g, text)[0].collect()}
        assert {i: got[i] for i in want} == pytest.approx(want) and (len(want) < 5 or len(got) == len(want))


def test_cards(spark, g):
    assert explore.resolve(g.nodes, "alpha.py::Store.save") == explore.resolve(g.nodes, "Store.save") == explore.resolve(g.nodes, "SAVE") == "alpha.py::Store.save"
    assert explore.resolve(g.nodes, "nothing") is None and explore.card(g, "nothing") is None
    found = explore.explain(g, "log")
    assert found["edge_count"] == 31 and len(found["edges"]) == 20 and found["relations"] == {"calls": 30, "defines": 1} and len(found["callers"]) == 10 and found["why"][0].startswith("hub")
    near = [(r.direction, r.id) for r in explore.incident(g, "alpha.py::parse_entry").orderBy("turn").collect()]
    assert near[0] == ("->", "alpha.py::load_config") and ("<-", "beta.py::run_pipeline") in near
    assert set(explore.hops(g, "alpha.py::load_config", "in", 2)) >= {"alpha.py::parse_entry", "alpha.py::Store.save", "beta.py::run_pipeline"}
    assert len(explore.hops(g, "hub.py::log", limit=7)) == 7 and explore.hops(g, "hub.py::log", mode="dfs", depth=2, limit=3)
    s = explore.stats(g).first()
    assert (s.nodes, s.edges, s.kinds["module"], s.files) == (g.nodes.count(), g.edges.count(), len(FILES), len(FILES)) and s.avg_degree == round(2 * s.edges / s.nodes, 3)
    assert explore.whole("7", 3) == 7 and explore.whole(True, 3) == explore.whole("x", 3) == 3 and explore.whole(-5, 3, 1) == 1


@pytest.fixture(scope="module")
def cliques(spark):
    nodes = spark.createDataFrame([(i, i, "function", "f.py" if i[0] == "a" else "g.py", 1, k) for k, i in enumerate(["a1", "a2", "a3", "b1", "b2", "b3", "iso"])], "id string, name string, kind string, file string, line int, ord int")
    pairs = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1"), ("b1", "a1")]
    edges = spark.createDataFrame([(a, b, "calls", "EXTRACTED", k) for k, (a, b) in enumerate(pairs)], "source string, target string, relation string, provenance string, ord int")
    return explore.Graph(nodes, edges)


def test_paths_communities_and_centrality(cliques):
    assert network.shortest_path(cliques, "a3", "b3") == ["a3", "a1", "b1", "b3"] and network.shortest_path(cliques, "a1", "a1") == ["a1"]
    assert network.shortest_path(cliques, "a1", "iso") is None and network.shortest_path(cliques, "a1", "no") is None
    found = network.communities(cliques)
    assert {r.id: r.community for r in found.collect()} == {"a1": 0, "a2": 0, "a3": 0, "b1": 1, "b2": 1, "b3": 1, "iso": 2}
    assert [(r.community, r["size"]) for r in network.listed_communities(found, 2).collect()] == [(0, 3), (1, 3)] and network.listed_communities(found, top=1).count() == 1
    assert {r.id for r in network.central(cliques, 2).collect()} == {"a1", "b1"} and {r.id: r.score for r in network.betweenness(cliques).collect()}["a1"] == 6.0
    assert [r.id for r in network.central(cliques, 2, "degree").collect()] == ["a1", "b1"]
    stamped = stamp(cliques.nodes, found)
    assert [r.id for r in explore.members(stamped, 1).collect()] == ["b1", "b2", "b3"] == [r.id for r in explore.members(cliques.nodes, 1, found).collect()]


def test_blast_radius_and_triage(spark, g):
    files = {"a.py": "def base():\n    pass\n", "b.py": "from a import base\ndef mid():\n    base()\n", "c.py": "from b import mid\ndef top():\n    mid()\n"}
    chain = explore.Graph(*build(extract_symbols(table_of(spark, files))))
    changed_files = spark.createDataFrame([("a.py",)], "file string")
    two = {r.id: r.distance for r in network.affected_by_files(chain, changed_files, 2).collect()}
    assert (two["a.py::base"], two["b.py::mid"], two["c.py::top"]) == (0, 1, 2) and "c.py::top" not in {r.id for r in network.affected_by_files(chain, changed_files, 1).collect()}
    pulls = spark.createDataFrame([(1, "a.py"), (2, "c.py"), (3, "none.py"), (4, "b.py")], "number int, file string")
    assert [r.number for r in network.triage(chain, pulls).collect()] == [1, 4, 2, 3]
    shared = {(r.a, r.b): r.shared_files for r in network.overlaps(chain, pulls).collect()}
    assert shared[(1, 4)] == ["a.py", "b.py", "c.py"][-len(shared[(1, 4)]):] and all(a < b for a, b in shared) and not any(3 in k for k in shared)


def test_refresh_reuses_what_is_unchanged(spark):
    def rows(files, mtime):
        return spark.createDataFrame([(p, len(t), mtime.get(p, 1), bytearray(t.encode())) for p, t in files.items()], "path string, size long, mtime long, content binary")

    one = {"a.py": "def a(): b()\n", "b.py": "def b(): pass\n", "c.py": "def c(): a()\n", "empty.py": ""}
    index = refresh(rows(one, {}))
    index = spark.createDataFrame(index.collect(), index.schema)
    assert not any(r.reused for r in index.collect()) and not changed(rows(one, {}), index) and changed(rows(one, {}), index.limit(0))
    two = {"a.py": "def z(): b()\n", "b.py": one["b.py"], "d.py": "def d(): a()\n", "empty.py": ""}
    again = refresh(rows(two, {"a.py": 2, "b.py": 2}), index)
    assert {r.path: r.reused for r in again.collect()} == {"a.py": False, "b.py": True, "d.py": False, "empty.py": True} and changed(rows(two, {}), index)
    key = lambda s: sorted(map(repr, s.collect()))
    assert key(symbols_of(again).orderBy("file", "pos")) == key(extract_symbols(rows(two, {}).select("path", "content")))


def test_union_of_graphs(g):
    nodes, edges = plain_graph.union([("/x/one", g.nodes, g.edges), ("/x/two/", g.nodes, g.edges)])
    assert nodes.count() == 2 * g.nodes.count() and {r.file.split("/")[0] for r in nodes.collect()} == {"one", "two"}
    assert edges.where(F.split("source", "::")[0] != F.split("target", "::")[0]).count() == 0
