"""Graphs and notes in files: node-link JSON, GraphML, SVG, HTML, and Markdown of lessons; an append-only event log."""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
from html import escape

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.operators.graph import degrees

NODE, EDGE = ("id", "name", "kind", "file", "line"), ("source", "target", "relation", "provenance")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet under ``path``; of any size."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved graph. One without its columns, or with an edge whose ends aren't nodes, is refused."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if {*NODE, "ord"} - set(nodes.columns) or {*EDGE, "ord"} - set(edges.columns):
        raise ValueError("not a graph")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    if ends.join(nodes, "id", "left_anti").limit(1).count():
        raise ValueError("an edge without its node")
    return nodes, edges


def replace_file(path: str, text: str) -> None:
    """Write a file aside and put it in place at once."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, aside = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(aside, path)


def node_link(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph that fits a file, as JSON."""
    data = {"nodes": [r.asDict() for r in nodes.orderBy("ord").select(*NODE).collect()], "edges": [r.asDict() for r in edges.orderBy("ord").select(*EDGE).collect()]}
    return json.dumps(data, ensure_ascii=False)


def from_node_link(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """The graph of such JSON. What isn't one is refused, as are ids with control characters and loose edges."""
    try:
        data = json.loads(text)
        nodes = [(str(n["id"]), str(n["name"]), str(n["kind"]), str(n["file"]), int(n["line"]), k) for k, n in enumerate(data["nodes"])]
        edges = [(*(str(e[c]) for c in EDGE), k) for k, e in enumerate(data["edges"])]
    except (ValueError, TypeError, KeyError, RecursionError) as error:
        raise ValueError("not a graph") from error
    ids = {n[0] for n in nodes}
    if any(ord(c) < 32 or ord(c) == 127 for i in ids for c in i) or any(e[0] not in ids or e[1] not in ids for e in edges):
        raise ValueError("not a graph")
    return spark.createDataFrame(nodes, "id string, name string, kind string, file string, line int, ord int"), spark.createDataFrame(edges, "source string, target string, relation string, provenance string, ord int")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(at, line): the elements of a GraphML document, escaped in place, so that a graph of any size is written by tasks."""
    def xml(c):
        out = F.col(c).cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")

    data = lambda c: F.concat(F.lit(f'<data key="{c}">'), F.coalesce(xml(c), F.lit("")), F.lit("</data>"))
    node = F.concat(F.lit('<node id="'), xml("id"), F.lit('">'), *map(data, NODE[1:]), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), xml("source"), F.lit('" target="'), xml("target"), F.lit('">'), *map(data, EDGE[2:]), F.lit("</edge>"))
    return nodes.select(F.lit(0).alias("at"), F.col("id").alias("by"), node.alias("line")).unionByName(edges.select(F.lit(1).alias("at"), F.concat_ws(" ", "source", "target", "relation").alias("by"), edge.alias("line")))


def graphml(nodes: DataFrame, edges: DataFrame) -> str:
    """The whole document of a graph that fits a file."""
    keys = "".join(f'<key id="{k}" for="{what}" attr.name="{k}" attr.type="{"int" if k == "line" else "string"}"/>' for what, names in (("node", NODE[1:]), ("edge", EDGE[2:])) for k in names)
    body = "\n".join(r.line for r in graphml_lines(nodes, edges).orderBy("at", "by").collect())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{keys}\n<graph edgedefault="directed">\n{body}\n</graph>\n</graphml>\n'


def svg(nodes: DataFrame, edges: DataFrame, top: int = 50, size: int = 800) -> str:
    """The ``top`` nodes by degree on a circle, and the edges between them."""
    shown = degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(top)
    rows = shown.join(nodes.select("id", "name"), "id").orderBy(F.desc("degree"), "id").collect()
    ids = [r.id for r in rows]
    r, mid = 0.4 * size, size / 2
    place = {i: (mid + r * math.cos(2 * math.pi * k / max(1, len(ids))), mid + r * math.sin(2 * math.pi * k / max(1, len(ids)))) for k, i in enumerate(ids)}
    inside = edges.where(F.col("source").isin(ids) & F.col("target").isin(ids)).select("source", "target").distinct().orderBy("source", "target").collect()
    lines = [f'<line x1="{place[e.source][0]:.1f}" y1="{place[e.source][1]:.1f}" x2="{place[e.target][0]:.1f}" y2="{place[e.target][1]:.1f}" stroke="#999"/>' for e in inside]
    dots = [f'<circle cx="{place[x.id][0]:.1f}" cy="{place[x.id][1]:.1f}" r="4"><title>{escape(x.id)}</title></circle><text x="{place[x.id][0] + 6:.1f}" y="{place[x.id][1]:.1f}" font-size="10">{escape(x.name)}</text>' for x in rows]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">\n' + "\n".join(lines + dots) + "\n</svg>\n"


def html(drawing: str, title: str = "graph") -> str:
    return f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>\n{drawing}</body></html>\n'


def lessons(nodes: DataFrame, tags: DataFrame, most: int = 100) -> str:
    """Markdown of the preferred nodes, as pointers."""
    rows = nodes.join(tags.where("tag = 'preferred'"), "id").orderBy("id").limit(most).collect()
    return "# Lessons\n\n" + ("".join(f"- {r['name']} ({r.file}:{r.line})\n" for r in rows) or "None yet.\n")


def append_events(events: DataFrame, path: str) -> None:
    """Add ``events`` (session, seq, ts, kind, summary) to the log under ``path``, partitioned by nothing: each write is a
    set of files that appears at once."""
    events.select("session", "seq", "ts", "kind", "summary").write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("session string, seq long, ts long, kind string, summary string").parquet(path)


def save_index(index: DataFrame, path: str) -> None:
    """The fingerprints and symbols of operators.symbols.refresh()."""
    index.select("path", "size", "mtime", "sha256", "symbols").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved index; None, so that all is built anew, if there is none or any entry of it isn't sound."""
    try:
        index = spark.read.parquet(path)
    except AnalysisException:
        return None
    if {"path", "size", "mtime", "sha256", "symbols"} - set(index.columns):
        return None
    sound = "path <> '' and size >= 0 and mtime is not null and (sha256 = '' or sha256 rlike '^[0-9a-f]{64}$') and symbols is not null and forall(symbols, s -> s.name is not null and s.kind is not null and s.line >= 1 and s.refs is not null)"
    unsound = index.where(~F.coalesce(F.expr(sound), F.lit(False))).limit(1).count()
    twice = index.groupBy("path").count().where("count > 1").limit(1).count()
    return None if unsound or twice else index


def save_communities(found: DataFrame, path: str) -> None:
    found.select("id", "community").write.mode("overwrite").parquet(path)


def load_communities(spark: SparkSession, path: str) -> DataFrame:
    """(id, community); empty if there are none or they aren't what they should be."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        found = None
    if found is None or {"id", "community"} - set(found.columns) or dict(found.dtypes)["community"] not in ("int", "bigint"):
        return spark.createDataFrame([], "id string, community int")
    return found.select("id", "community")


def named_graph(folder: str, name: str) -> str:
    """Where the graph of that name is kept below a folder that several trees share."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError("a name of letters, digits, dots, dashes and underscores")
    return f"{folder.rstrip('/')}/graphs/{name}"


def log_query(path: str, entry: dict) -> bool:
    """Add a line of JSON to a local log. A question is never lost for its log: failures are told, not raised."""
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "a", encoding="utf-8") as out:
            out.write(json.dumps(entry, ensure_ascii=False) + "\n")
        return True
    except (OSError, TypeError, ValueError):
        return False
