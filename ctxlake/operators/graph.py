"""Property graphs as tables: nodes (id, name, kind, file, line, ord) and edges (source, target, relation, provenance, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.sources import table
from ctxlake.sources.scratch import staged


KINDS = [("r", "region", "r_regionkey", "r_name", "class"), ("n", "nation", "n_nationkey", "n_name", "class"), ("s", "supplier", "s_suppkey", "s_name", "function"), ("c", "customer", "c_custkey", "c_name", "function"), ("p", "part", "p_partkey", "p_name", "function")]
#: (table, source's letter and column, target's letter and column, relation)
LINKS = [("nation", "n", "n_nationkey", "r", "n_regionkey", "in_region"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "in_nation"), ("customer", "c", "c_custkey", "n", "c_nationkey", "in_nation"), ("lineitem", "s", "l_suppkey", "p", "l_partkey", "supplies")]


def from_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The graph of a folder's keys: regions, nations, suppliers, customers and parts. Nodes are in the order of (file,
    key), edges of (relation, source, target). Pairs of keys are made distinct as numbers, which take a fraction of the
    memory of ids."""
    nodes = edges = None
    for short, name, key, label, kind in KINDS:
        k = F.col(key).cast("long")
        part = table(spark, folder, name).select(F.concat(F.lit(short + ":"), k.cast("string")).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("kind"), F.lit(name).alias("file"), (k + 1).alias("line"), F.struct(F.lit(name).alias("file"), k.alias("key")).alias("ord"))
        nodes = part if nodes is None else nodes.unionByName(part)
    for t, a, x, b, y, relation in LINKS:
        keys = table(spark, folder, t).select(x, y)
        keys = keys.distinct() if t == "lineitem" else keys
        part = keys.select(F.concat(F.lit(a + ":"), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b + ":"), F.col(y).cast("string")).alias("target"), F.lit(relation).alias("relation"))
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges.select("source", "target", "relation", F.lit("EXTRACTED").alias("provenance"), F.struct("relation", "source", "target").alias("ord"))


def relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(relation, n): how many of clean_edges() of the folder's graph there are, found on keys as numbers. Ends of one edge
    are of different tables, so that none is a self-edge."""
    own = {short: (name, key) for short, name, key, _, _ in KINDS}
    ids = lambda short, c: table(spark, folder, own[short][0]).select(F.col(own[short][1]).cast("long").alias(c))
    found = None
    for t, a, x, b, y, relation in LINKS:
        keys = table(spark, folder, t).select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
        part = keys.join(ids(a, "x"), "x", "left_semi").join(ids(b, "y"), "y", "left_semi").distinct().select(F.lit(relation).alias("relation"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("relation").agg(F.count("*").alias("n"))


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The first edge per (source, target, relation), without self-edges and loose ends."""
    ids = nodes.select("id")
    whole = edges.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return whole.groupBy("source", "target", "relation").agg(F.min(F.struct("ord", "provenance")).alias("e")).select("source", "target", "relation", "e.provenance", "e.ord")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): in and out edges, 0 where there are none; partly added up before the shuffle."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


THRESHOLD = "cast(greatest(10, coalesce(ceil(avg(degree) + 2 * stddev_pop(degree)), 10)) as bigint)"


def hub_threshold(degree: DataFrame) -> int:
    """max(10, ceil(mean + 2 population deviations)) of all nodes' degrees."""
    return degree.agg(F.expr(THRESHOLD).alias("t")).first().t


def hubs(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Nodes of that many edges or more that aren't modules, the greatest first."""
    d = degrees(nodes, edges).join(nodes.select("id", "kind"), "id")
    least = d.agg(F.expr(THRESHOLD).alias("threshold"))
    return d.crossJoin(F.broadcast(least)).where("degree >= threshold and kind <> 'module'").orderBy(F.desc("degree"), F.desc("id")).limit(top).drop("kind")


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of all nodes from which a seed (id) is reached in ``depth`` edges or fewer, seeds at 0. Edges and
    every frontier are written once, so that work grows with the depth alone."""
    edges = staged(edges.select("source", "target"), "edges")
    seen = staged(seeds.select("id", F.lit(0).cast("long").alias("distance")).distinct(), "seen")
    front = seen
    for d in range(1, depth + 1):
        near = edges.join(front.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
        front = staged(near.join(seen, "id", "left_anti").withColumn("distance", F.lit(d).cast("long")), "front")
        seen = seen.unionByName(front)
    return seen


def union(graphs: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One graph of several (root, nodes, edges), ids and files prefixed by the last part of their roots."""
    nodes = edges = None
    for root, n, e in graphs:
        name = F.lit(root.rstrip("/").rsplit("/", 1)[-1])
        n = n.select(F.concat_ws("::", name, "id").alias("id"), "name", "kind", F.concat_ws("/", name, "file").alias("file"), "line", F.struct(name.alias("root"), F.col("ord").alias("own")).alias("ord"))
        e = e.select(F.concat_ws("::", name, "source").alias("source"), F.concat_ws("::", name, "target").alias("target"), "relation", "provenance", F.struct(name.alias("root"), F.col("ord").alias("own")).alias("ord"))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes, edges
