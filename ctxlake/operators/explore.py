"""Questions to a symbol graph: seed scores, bounded walks, cards and statistics. Results are pointers, never contents.

Scoring and statistics are column expressions over all nodes; only what a limit bounds (seeds, at most ``limit`` nodes of
a walk and the first neighbours of each) comes to the driver, which asks for the neighbours of a whole frontier at once.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ctxlake.functions.text import identifier_tokens, identifier_words, trigrams
from ctxlake.operators.graph import degrees, hub_threshold
from ctxlake.sources.scratch import staged

DEPTH, LIMIT, SEEDS, SHARE = 3, 20, 5, 0.2
BOOST = {"preferred": 1.5, "contested": 0.6}
#: Words of a question that say nothing about code.
FILLER = frozenset("a an and are as at be been by did do does for from how in is it its of on or that the this to was were what when where which who why with work working works".split())


@dataclass
class Graph:
    """Nodes (id, name, kind, file, line, ord) and edges (source, target, relation, provenance, ord), with degrees."""

    nodes: DataFrame
    edges: DataFrame

    def __post_init__(self) -> None:
        self.nodes, self.edges = staged(self.nodes, "nodes"), staged(self.edges, "edges")
        self.degree = staged(degrees(self.nodes, self.edges), "degrees")
        self.threshold = hub_threshold(self.degree)


def whole(value: Any, default: int, least: int = 0, most: int | None = None) -> int:
    """A parameter as a whole number within bounds; booleans and what isn't a number give the default."""
    try:
        n = default if isinstance(value, bool) or value is None else int(value)
    except (TypeError, ValueError, OverflowError):
        n = default
    return max(least, n if most is None else min(n, most))


def node_tokens(name: str = "name", file: str = "file") -> Column:
    return F.array_union(identifier_tokens(F.col(name)), identifier_tokens(F.element_at(F.split(file, "/"), -1)))


def question(text: str) -> list[str]:
    """Distinct words of a question without filler; if it is all filler, all of them."""
    words = list(dict.fromkeys(identifier_words(text)))
    return [w for w in words if w not in FILLER] or words


def _credit(word: str, weight: float) -> Column:
    """What a node earns for a word: in its tokens, else inside its name, else as a common beginning with a token."""
    starts = F.exists("tokens", lambda t: (t.startswith(word) | F.lit(word).startswith(t)) & (F.length(t) >= 4))
    out = F.when(F.array_contains("tokens", word), weight)
    if len(word) >= 3:
        out = out.when(F.contains(F.lower("name"), F.lit(word)), 0.5 * weight)
    if len(word) >= 4:
        out = out.when(starts, 0.4 * weight)
    return out.otherwise(0.0)


#: Definitions count a little more than imports and modules.
_PREFERENCE = "if(kind in ('function', 'method', 'class'), 1.2D, 1.0D)"


def _similar(rows: DataFrame, words: list[str], weight: dict[str, float]) -> DataFrame:
    """Scores of nodes that share a trigram with a misspelled word and have a token within its edit budget."""
    total = F.lit(0.0)
    for w in (w for w in words if len(w) >= 4):
        budget = 1 if len(w) < 6 else 2
        far = F.transform("tokens", lambda t: F.levenshtein(t, F.lit(w), budget))  # noqa: B023
        best = F.array_min(F.filter(far, lambda d: d >= 0))
        near = F.arrays_overlap(trigrams(F.substring_index("name", ".", -1)), F.array(*(F.lit(w[i : i + 3]) for i in range(len(w) - 2))))
        total = total + F.when(near & (best == 1), 0.35 * weight[w]).when(near & best.isNotNull(), 0.2 * weight[w]).otherwise(0.0)
    scored = rows.withColumn("score", total).where("score > 0")
    return scored.select("id", (F.col("score") * F.expr(_PREFERENCE)).alias("score"))


def idf(nodes: DataFrame, words: list[str]) -> dict[str, float]:
    """Weight of each word: ln((nodes + 1) / (nodes with it + 1)) + 1."""
    rows = nodes.withColumn("tokens", node_tokens())
    n, *found = rows.agg(F.array(F.count("*"), *(F.count_if(F.array_contains("tokens", w)) for w in words)).alias("n")).first().n
    return {w: math.log((n + 1) / (k + 1)) + 1 for w, k in zip(words, found)}


def seed_scores(g: Graph, text: str) -> tuple[DataFrame, list[str]]:
    """(id, score) of all nodes that a question finds, and the best node of each word that found one, in the order in
    which the words first met one."""
    words = question(text)
    if not words:
        return g.nodes.select("id", F.lit(0.0).alias("score")).limit(0), []
    weight = idf(g.nodes, words)
    rows = g.nodes.withColumn("tokens", node_tokens())
    credits = [f"c{i}" for i in range(len(words))]
    rows = staged(rows.select("*", *(_credit(w, weight[w]).alias(c) for c, w in zip(credits, words))).join(g.degree, "id"), "credits")
    total = sum((F.col(c) for c in credits[1:]), F.col(credits[0]))
    scored = rows.withColumn("score", total).where("score > 0").select("id", (F.col("score") * F.expr(_PREFERENCE)).alias("score"))
    best = [F.min(F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("c"), (-F.col("degree")).alias("d"), "ord", "id"))).alias(c) for c in credits]
    met = [F.min(F.when(F.col(c) > 0, F.col("ord"))).alias("m" + c) for c in credits]
    found = rows.agg(*best, *met).first()
    order = sorted((i for i, c in enumerate(credits) if found[c] is not None), key=lambda i: (tuple(found["m" + credits[i]]), i))
    if scored.limit(SEEDS).count() < SEEDS:
        scored = scored.unionByName(_similar(rows.join(scored, "id", "left_anti"), words, weight))
    return scored, [found[credits[i]].id for i in order]


def overlay(scored: DataFrame, tags: DataFrame) -> DataFrame:
    """Scores times the weight of each node's tag (id, tag)."""
    weight = F.when(F.col("tag") == "preferred", BOOST["preferred"]).when(F.col("tag") == "contested", BOOST["contested"]).otherwise(1.0)
    return scored.join(tags, "id", "left").select("id", (F.col("score") * weight).alias("score"))


def ranked(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id")


def pick_seeds(scored: DataFrame, best: list[str]) -> list[str]:
    """At most SEEDS of the best nodes, each of SHARE of the top score at least, and then the words' best ones."""
    top = ranked(scored).limit(SEEDS).collect()
    seeds = [r.id for r in top if r.score >= SHARE * top[0].score]
    return list(dict.fromkeys([*seeds, *best])) if seeds else []


def neighbour_lists(edges: DataFrame, ids: list[str], direction: str = "both", most: int | None = None) -> dict[str, list[str]]:
    """The first ``most`` neighbours of each of the ``ids`` (a bounded list): along out edges, then in edges, in order."""
    sides = []
    if direction in ("out", "both"):
        sides.append(edges.where(F.col("source").isin(ids)).select(F.col("source").alias("at"), F.col("target").alias("other"), F.struct(F.lit(0).alias("side"), "ord").alias("turn")))
    if direction in ("in", "both"):
        sides.append(edges.where(F.col("target").isin(ids)).select(F.col("target").alias("at"), F.col("source").alias("other"), F.struct(F.lit(1).alias("side"), "ord").alias("turn")))
    met = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    first = met.groupBy("at", "other").agg(F.min("turn").alias("turn")).withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy("turn")))
    rows = (first if most is None else first.where(F.col("n") <= most)).select("at", "other", "n").collect()
    out: dict[str, list[str]] = {i: [] for i in ids}
    for r in sorted(rows, key=lambda r: r.n):
        out[r.at].append(r.other)
    return out


def walk(g: Graph, seeds: list[str], depth: int = DEPTH, limit: int = LIMIT, cap: int | None = None, mode: str = "bfs") -> tuple[list[str], bool]:
    """Nodes in the order of a breadth- or depth-first walk from the seeds over edges of both directions, at most
    ``limit``, and whether more were left. Nodes of more than ``cap`` edges are kept but only left again if seeds."""
    cap = g.threshold if cap is None else cap
    chosen: list[str] = []
    seen: set[str] = set()
    near: dict[str, list[str]] = {}
    open_ = deque((s, 0) for s in seeds)
    while open_:
        at, dist = open_.pop() if mode == "dfs" else open_.popleft()
        if at in seen:
            continue
        seen.add(at)
        if len(chosen) >= limit:
            return chosen, True
        chosen.append(at)
        if dist >= depth:
            continue
        if at not in near:
            # What else may be left soon, up to the limit, is asked for at the same time.
            wanted = list(dict.fromkeys([at, *(i for i, d in (reversed(open_) if mode == "dfs" else open_) if d < depth and i not in near and i not in seen)]))[: limit + 1]
            size = {r.id: r.degree for r in g.degree.where(F.col("id").isin(wanted)).collect()}
            leave = [i for i in wanted if size.get(i, 0) <= cap or i in seeds]
            near |= dict.fromkeys(wanted, []) | (neighbour_lists(g.edges, leave, most=2 * limit + 2) if leave else {})
        step = [n for n in near[at] if n not in seen]
        open_.extend((n, dist + 1) for n in (reversed(step) if mode == "dfs" else step))
    return chosen, False


def hops(g: Graph, start: str, direction: str = "both", depth: int = 1, limit: int = LIMIT, mode: str = "bfs") -> list[str]:
    """Nodes around one node, each met once, in the order of the walk."""
    chosen: list[str] = []
    seen, open_ = {start}, deque([(start, 0)])
    near: dict[str, list[str]] = {}
    while open_ and len(chosen) < limit:
        at, dist = open_.pop() if mode == "dfs" else open_.popleft()
        if at != start:
            chosen.append(at)
        if dist >= depth:
            continue
        if at not in near:
            wanted = list(dict.fromkeys([at, *(i for i, d in open_ if d < depth and i not in near)]))[: limit + 1]
            near |= neighbour_lists(g.edges, wanted, direction, None if mode == "dfs" else 2 * limit + 2)
        for n in near[at]:
            if n not in seen:
                seen.add(n)
                open_.append((n, dist + 1))
    return chosen


POINTER = "concat_ws(':', file, cast(line as string))"
LISTED = f"concat({POINTER}, '  ', name, ' [', kind, ']')"


def shown(g: Graph, ids: list[str], scored: DataFrame | None = None) -> DataFrame:
    """(rank, id, name, kind, file, line, degree, score, pointer, listed) of a bounded list of nodes."""
    spark = g.nodes.sparkSession
    order = F.broadcast(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, rank int"))
    rows = g.nodes.join(order, "id").join(g.degree, "id")
    rows = rows.withColumn("score", F.lit(0.0)) if scored is None else rows.join(scored, "id", "left")
    return rows.select("rank", "id", "name", "kind", "file", "line", "degree", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), F.expr(POINTER).alias("pointer"), F.expr(LISTED).alias("listed"))


def induced(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Edges with both ends in a bounded list of nodes."""
    return edges.where(F.col("source").isin(ids) & F.col("target").isin(ids))


def fit_budget(rows: list[Row], edges: list[Row], budget: int | None) -> tuple[list[Row], list[Row], bool]:
    """The longest beginning of ``rows`` (listed; one at least) that, with the edges inside it, is estimated at no more
    than ``budget`` tokens."""
    if not budget or budget <= 0:
        return rows, edges, False
    place = {r.id: k for k, r in enumerate(rows)}
    reach = [max(place[e.source], place[e.target]) for e in edges]
    for k in range(len(rows), 0, -1):
        inside = sum(r < k for r in reach)
        if k == 1 or max(1, (sum(len(r.listed) for r in rows[:k]) + 40 * k + 30 * inside) // 4) <= budget:
            return rows[:k], [e for e, r in zip(edges, reach) if r < k], k < len(rows)
    return rows, edges, False


@dataclass
class Answer:
    seeds: list[str]
    nodes: list[Row]
    edges: list[Row]
    truncated: bool
    packed: bool


def ask(g: Graph, text: str, depth: int = DEPTH, limit: int = LIMIT, cap: int | None = None, tags: DataFrame | None = None, mode: str = "bfs", budget: int | None = None) -> Answer:
    """Pointers to what a question is about, and the edges between them."""
    scored, best = seed_scores(g, text)
    scored = staged(scored if tags is None else overlay(scored, tags), "scored")
    seeds = pick_seeds(scored, best)
    ids, more = walk(g, seeds, whole(depth, DEPTH), whole(limit, LIMIT, 1), cap, mode if mode == "dfs" else "bfs")
    rows = shown(g, ids, scored).orderBy("rank").collect()
    edges = induced(g.edges, ids).orderBy("ord").collect()
    rows, edges, packed = fit_budget(rows, edges, budget)
    return Answer(seeds, rows, edges, more or packed, packed)


def resolve(nodes: DataFrame, ref: str) -> str | None:
    """A node by its id, else by its name, else by the last part of its name in any case; the first of several."""
    match = F.when(F.col("id") == ref, 0).when(F.col("name") == ref, 1).when(F.lower(F.substring_index("name", ".", -1)) == ref.lower(), 2)
    row = nodes.where(match.isNotNull()).agg(F.min(F.struct(match.alias("m"), "ord", "id")).alias("r")).first()
    return row.r.id if row.r else None


def incident(g: Graph, node: str, direction: str = "both") -> DataFrame:
    """(turn, direction, relation, provenance, id, name, kind, pointer): the edges of one node, out before in."""
    out = g.edges.where(F.col("source") == node).select(F.struct(F.lit(0).alias("side"), "ord").alias("turn"), F.lit("->").alias("direction"), "relation", "provenance", F.col("target").alias("id"))
    in_ = g.edges.where(F.col("target") == node).select(F.struct(F.lit(1).alias("side"), "ord").alias("turn"), F.lit("<-").alias("direction"), "relation", "provenance", F.col("source").alias("id"))
    rows = {"out": out, "in": in_}.get(direction, out.unionByName(in_))
    return rows.join(g.nodes.select("id", "name", "kind", F.expr(POINTER).alias("pointer")), "id").select("turn", "direction", "relation", "provenance", "id", "name", "kind", "pointer")


def card(g: Graph, ref: str, edges: int = 20) -> dict[str, Any] | None:
    """A node's row, how many edges it has and the first of them; None if nothing is called so."""
    node = resolve(g.nodes, ref)
    if node is None:
        return None
    row = g.nodes.where(F.col("id") == node).join(g.degree, "id").withColumn("pointer", F.expr(POINTER)).first()
    around = incident(g, node)
    return {"node": row, "edge_count": around.count(), "edges": around.orderBy("turn").limit(edges).collect()}


def explain(g: Graph, ref: str) -> dict[str, Any] | None:
    """The card with a histogram of relations, the first ten callers and callees, and why the node matters."""
    found = card(g, ref)
    if found is None:
        return None
    around = incident(g, found["node"].id)
    relations = {r.relation: r["count"] for r in around.groupBy("relation").count().collect()}
    line = F.concat(F.col("pointer"), F.lit("  "), F.col("name")).alias("line")
    side = lambda arrow: [r.line for r in around.where(F.col("direction") == arrow).orderBy("turn").limit(10).select(line).collect()]
    degree, community = found["node"].degree, found["node"].asDict().get("community")
    why = [f"hub: {degree} edges, threshold {g.threshold}"] * (degree >= g.threshold) + [f"community {community}"] * (community is not None)
    why += ["part of a type hierarchy"] * bool(relations.keys() & {"inherits", "implements"}) + ["declared dependency"] * ("depends_on" in relations)
    return found | {"relations": relations, "callers": side("<-"), "callees": side("->"), "why": why or ["ordinary symbol"]}


def members(nodes: DataFrame, community: int, mapping: DataFrame | None = None) -> DataFrame:
    """(id, listed) of a community's nodes, by their stamps or, where no node has that one, by a ``mapping`` (id, community)."""
    own = nodes.where(F.col("community") == community) if "community" in nodes.columns else nodes.limit(0)
    if mapping is not None and not own.limit(1).count():
        own = nodes.join(mapping.where(F.col("community") == community).select("id"), "id", "left_semi")
    return own.select("id", F.expr(LISTED).alias("listed")).orderBy("id")


def stats(g: Graph) -> DataFrame:
    """One row: nodes, edges, files, kinds, twice the edges per node, and the hub threshold."""
    n_edges = g.edges.count()
    kinds = g.nodes.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("kinds"))
    row = g.nodes.agg(F.count("*").alias("nodes"), F.lit(n_edges).cast("long").alias("edges"), F.count_distinct("file").alias("files"))
    ratio = F.when(F.col("nodes") > 0, F.bround(2 * F.col("edges") / F.col("nodes"), 3)).otherwise(0.0)
    return row.withColumn("avg_degree", ratio).withColumn("threshold", F.lit(g.threshold).cast("long")).crossJoin(kinds)
