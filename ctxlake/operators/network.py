"""Algorithms over whole graphs: paths, communities, centrality, blast radius and triage of change sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxlake.operators.explore import LISTED, Graph, resolve
from ctxlake.sources.scratch import staged

MOST_SOURCES, SWEEPS, RADIUS = 1500, 10, 2


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) of both directions, without self-loops."""
    return edges.where("source <> target").selectExpr("source a", "target b").union(edges.where("source <> target").selectExpr("target", "source")).distinct()


def shortest_path(g: Graph, source: str, target: str, most: int = 100) -> list[str] | None:
    """Ids of a shortest path over undirected edges; of several that which a breadth-first walk over sorted neighbours
    finds first, which is the least by its ids. None if there is none within ``most`` steps or a name is unknown.

    A level of the walk is a table of (id, path). The frontier is distributed, whatever its size; paths are as long as
    the level."""
    a, b = resolve(g.nodes, source), resolve(g.nodes, target)
    if a is None or b is None:
        return None
    if a == b:
        return [a]
    pairs = staged(undirected(g.edges), "pairs")
    front = g.nodes.sparkSession.createDataFrame([(a, [a])], "id string, path array<string>")
    seen = front.select("id")
    for _ in range(most):
        near = pairs.join(front.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = staged(near.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"), "front")
        found = front.where(F.col("id") == b).first()
        if found or not front.limit(1).count():
            return found and list(found.path)
        seen = seen.unionByName(front.select("id"))
    return None


def connected(edges: DataFrame) -> DataFrame:
    """(id, part): the least id that each end of an edge reaches."""
    pairs = staged(undirected(edges), "pairs")
    labels = staged(pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
    while True:
        around = pairs.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        spread = labels.join(around, "a").select("a", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("a").alias("l"), F.col("l").alias("jump"))
        new = staged(spread.join(jump, "l", "left").select("a", "was", F.least("l", "jump").alias("l")), "labels")
        labels = new.select("a", "l")
        if not new.where("was <> l").limit(1).count():
            return labels.select(F.col("a").alias("id"), F.col("l").alias("part"))


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """Labels of one connected part: sorted nodes take their neighbours' most frequent label, the least of several."""
    near = {a: sorted(b) for a, b in rows.groupby("a")["b"]}
    order = sorted(near)
    label = {a: min(a, near[a][0]) for a in order}
    for _ in range(SWEEPS):
        moved = False
        for a in order:
            n: dict[str, int] = {}
            for b in near[a]:
                n[label[b]] = n.get(label[b], 0) + 1
            best = min(n, key=lambda x: (-n[x], x))
            moved |= best != label[a]
            label[a] = best
        if not moved:
            break
    return pd.DataFrame({"id": order, "label": [label[a] for a in order]})


def communities(g: Graph) -> DataFrame:
    """(id, community, size): label propagation from the least id of each closed neighbourhood, in at most SWEEPS sweeps
    over sorted nodes. Sweeps depend on their order, but never across connected parts, so that each part is one group; a
    part must fit a task. Communities are numbered from the largest, then by least member."""
    pairs = undirected(g.edges)
    parted = pairs.join(connected(g.edges).withColumnRenamed("id", "a"), "a")
    labels = parted.groupBy("part").applyInPandas(lambda x: _sweep(x), "id string, label string")
    labels = staged(g.nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # Numbering is a global sort of one row per community.
    numbered = sizes.withColumn("community", (F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).cast("int"))
    return labels.join(numbered, "label").select("id", "community", "size")


def listed_communities(found: DataFrame, min_size: int = 1, top: int | None = None) -> DataFrame:
    """(community, size) of min_size and more, in order; numbers stay those of all communities."""
    rows = found.select("community", "size").distinct().where(F.col("size") >= min_size).orderBy("community")
    return rows if top is None else rows.limit(top)


def affected(g: Graph, seeds: DataFrame, depth: int = RADIUS) -> DataFrame:
    """(id, distance): seeds (id) at 0 and what reaches them over ``depth`` edges at most. Each level is written, so that
    none is computed again."""
    seen = staged(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "seen")
    front = seen.select("id")
    for d in range(1, depth + 1):
        front = staged(g.edges.join(front.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        seen = seen.unionByName(front.withColumn("distance", F.lit(d)))
    return seen


def affected_by_files(g: Graph, files: DataFrame, depth: int = RADIUS) -> DataFrame:
    """(distance, id, listed): what depends on the symbols of ``files`` (file), which are at 0."""
    seeds = g.nodes.join(files.select(F.replace("file", F.lit("\\"), F.lit("/")).alias("file")), "file", "left_semi")
    return affected(g, seeds, depth).join(g.nodes, "id").select("distance", "id", "file", F.expr(LISTED).alias("listed"))


def _shares(near: dict[str, list[str]], source: str) -> dict[str, float]:
    """One source's part of betweenness: shortest paths counted forwards, dependencies summed backwards."""
    order, before, paths, dist = [source], {source: []}, {source: 1.0}, {source: 0}
    for v in order:
        for w in near.get(v, ()):
            if w not in dist:
                dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                order.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    own = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            own[v] += paths[v] / paths[w] * (1 + own[w])
    return {w: s for w, s in own.items() if w != source and s}


def betweenness(g: Graph) -> DataFrame:
    """(id, score) of a graph of MOST_SOURCES nodes or fewer, whose neighbour lists therefore fit every task: sources are
    spread over tasks and their shares added up and halved."""
    if g.nodes.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"betweenness takes at most {MOST_SOURCES} nodes")
    rows = undirected(g.edges).groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("b")).collect()
    sent = g.nodes.sparkSession.sparkContext.broadcast({r.a: list(r.b) for r in rows})

    def run(batches):
        for batch in batches:
            found = [x for s in batch["id"] for x in _shares(sent.value, s).items()]
            yield pd.DataFrame(found, columns=["id", "share"])

    shares = g.nodes.select("id").repartition(8).mapInPandas(run, "id string, share double").groupBy("id").agg((F.sum("share") / 2).alias("score"))
    return g.nodes.select("id").join(shares, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def central(g: Graph, top: int = 10, method: str = "auto") -> DataFrame:
    """(id, score, degree, pointer) of the most central nodes: by betweenness if the graph is small, else by degree."""
    if method not in ("auto", "betweenness", "degree"):
        raise ValueError(f"unknown method {method!r}")
    small = g.nodes.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    scores = betweenness(g) if method == "betweenness" or (method == "auto" and small) else g.degree.select("id", F.col("degree").cast("double").alias("score"))
    rows = scores.join(g.degree, "id").join(g.nodes.select("id", F.expr(LISTED).alias("listed")), "id")
    return rows.orderBy(F.desc("score"), "id").limit(max(0, top)).select("id", F.round("score", 4).alias("score"), "degree", "listed")


def impacts(g: Graph, changes: DataFrame, depth: int = RADIUS) -> DataFrame:
    """(number, id, file, distance): the blast radius of every change set of ``changes`` (number, file) at once."""
    seen = staged(changes.join(g.nodes.select("id", "file"), "file").select("number", "id").distinct().withColumn("distance", F.lit(0)), "seen")
    front = seen
    for d in range(1, depth + 1):
        near = g.edges.select(F.col("target").alias("id"), "source").join(front.select("number", "id"), "id").select("number", F.col("source").alias("id")).distinct()
        front = staged(near.join(seen, ["number", "id"], "left_anti").withColumn("distance", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen.join(g.nodes.select("id", "file"), "id").select("number", "id", "file", "distance")


def triage(g: Graph, changes: DataFrame, depth: int = RADIUS, limit: int = 20) -> DataFrame:
    """(number, blast): change sets by how many symbols they reach."""
    blast = impacts(g, changes, depth).groupBy("number").agg(F.count("*").alias("blast"))
    return changes.select("number").distinct().join(blast, "number", "left").select("number", F.coalesce("blast", F.lit(0)).cast("long").alias("blast")).orderBy(F.desc("blast"), "number").limit(max(0, limit))


def overlaps(g: Graph, changes: DataFrame, depth: int = RADIUS, limit: int = 20) -> DataFrame:
    """(a, b, shared_count, shared_files): pairs of the listed change sets that reach the same files, found through the
    files. At most ``limit`` sets take part, so a file meets at most that many."""
    top = triage(g, changes, depth, limit).select("number")
    reached = impacts(g, changes, depth).select("number", "file").unionByName(changes.select("number", "file")).distinct().join(F.broadcast(top), "number", "left_semi")
    pairs = reached.withColumnRenamed("number", "a").join(reached.withColumnRenamed("number", "b"), "file").where("a < b")
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("shared_count"), F.slice(F.array_sort(F.collect_list("file")), 1, 20).alias("shared_files"))
    return found.orderBy(F.desc("shared_count"), "a", "b")
