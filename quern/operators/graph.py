"""Directed property graphs on two DataFrames: degrees, motifs, triangles, components, rank."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import stage

_TERM = re.compile(r"\A(!?)\s*\((\w*)\)\s*-\s*\[(\w*)\]\s*->\s*\((\w*)\)\s*\Z")


@dataclass(frozen=True)
class Graph:
    """``vertices`` with a column ``id``, ``edges`` with ``src`` and ``dst``; other columns are attributes."""

    vertices: DataFrame
    edges: DataFrame

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))

    def degrees(self) -> DataFrame:
        """Edges at each vertex, either way; vertices without any are absent."""
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))

    def find(self, pattern: str) -> DataFrame:
        return find_motif(self, pattern)


def parse_motif(pattern: str) -> list[tuple[bool, str, str, str]]:
    """``(negated, source, edge, target)`` of each term of ``(a)-[e]->(b); !(b)-[]->(a)``."""
    terms = []
    for part in filter(None, (p.strip() for p in pattern.split(";"))):
        if not (m := _TERM.match(part)):
            raise ValueError(f"not a motif term: {part}")
        terms.append((bool(m[1]), m[2], m[3], m[4]))
    named = {n for neg, a, e, b in terms if not neg for n in (a, b)}
    for neg, a, e, b in terms:
        if neg and (e or not {a, b} <= named or not a or not b):
            raise ValueError("a negated term has no edge name and only vertices named elsewhere")
    if not any(not t[0] for t in terms):
        raise ValueError("a motif needs a term that is not negated")
    return terms


def find_motif(graph: Graph, pattern: str) -> DataFrame:
    """One row per match, with a struct per named vertex and edge. Vertices may coincide; rotations are kept;
    unnamed parts are matched but not returned; repeated edges match each on their own."""
    terms = parse_motif(pattern)
    edge = F.struct(*[F.col(f"`{c}`") for c in graph.edges.columns])
    found, bound, order = None, {}, []
    for k, (_, a, e, b) in enumerate(t for t in terms if not t[0]):
        name = e or f"__e{k}"
        step = graph.edges.select(edge.alias(name), F.col("src").alias(f"__s{k}"), F.col("dst").alias(f"__d{k}"))
        tests = []
        for vertex, end in ((a, f"__s{k}"), (b, f"__d{k}")):
            if vertex and vertex in bound:
                tests.append((bound[vertex], end))
            elif vertex:
                bound[vertex] = end
        old = [(x, y) for x, y in tests if x not in (f"__s{k}", f"__d{k}")]
        same = [(x, y) for x, y in tests if x in (f"__s{k}", f"__d{k}")]
        for x, y in same:
            step = step.where(F.col(x) == F.col(y))
        if found is None:
            found = step
        elif old:
            on = F.lit(True)
            for x, y in old:
                on = on & (F.col(x) == F.col(y))
            found = found.join(step, on)
        else:
            found = found.crossJoin(step)
        order += dict.fromkeys(n for n in (a, e, b) if n and n not in order)
    for k, (_, a, _, b) in enumerate(t for t in terms if t[0]):
        gone = graph.edges.select(F.col("src").alias("__ns"), F.col("dst").alias("__nd")).distinct()
        found = found.join(gone, (F.col(bound[a]) == F.col("__ns")) & (F.col(bound[b]) == F.col("__nd")), "left_anti")
    vertex = F.struct(*[F.col(f"`{c}`") for c in graph.vertices.columns])
    for name in [n for n in order if n in bound]:
        found = found.join(graph.vertices.select(F.col("id").alias("__id"), vertex.alias(name)), F.col(bound[name]) == F.col("__id")).drop("__id")
    return found.select(*order)


def triangle_counts(graph: Graph) -> DataFrame:
    """``(id, triangles)`` on the undirected simple graph; isolated vertices have 0.

    Each edge points from its end of lower degree to the other, so that a vertex of very many edges starts few
    pairs; loops and repeated edges do not count."""
    pairs = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(degree.select(F.col("v").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
    up = F.struct("na", "a") < F.struct("nb", "b")
    arcs = stage(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "arcs").frame
    p, q, r = arcs.alias("p"), arcs.alias("q"), arcs.alias("r")
    closed = p.join(q, F.col("p.y") == F.col("q.x")).join(r, (F.col("r.x") == F.col("p.x")) & (F.col("r.y") == F.col("q.y")))
    counts = closed.select(F.explode(F.array("p.x", "p.y", "q.y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return graph.vertices.select("id").join(counts, F.col("id") == F.col("v"), "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def connected_components(graph: Graph, max_rounds: int = 60) -> DataFrame:
    """``(id, component)``: the smallest id connected with each vertex, edges taken both ways.

    Rounds of two steps: every vertex links its larger neighbours to its smallest one, then its smaller ones. Each round
    is written to the shared folder; the loop ends when links stop changing. Minima are combined before the
    shuffle. The joins with them meet on the vertex: one of very many edges is a skewed key there, which adaptive
    execution splits, as its links are shuffled on both ends afterwards.
    """
    links = graph.edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = stage(links, "links")
    for _ in range(max_rounds):
        both = now.frame.unionByName(now.frame.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        low = large.frame.groupBy("u").agg(F.min("v").alias("m"))
        small = large.frame.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = stage(small, "links")
        size = lambda s: s.frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        settled = size(following) == size(now)
        now.drop()
        large.drop()
        now = following
        if settled:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.frame.groupBy("u").agg(F.min("v").alias("m"))
    return graph.vertices.select("id").join(roots, F.col("id") == F.col("u"), "left").select("id", F.coalesce("m", "id").alias("component"))


def page_rank(graph: Graph, reset: float = 0.15, tol: float = 0.01, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(vertices with pagerank, edges with weight = 1 / out degree)``. Ranks add up to the number of vertices; the rank
    of vertices without out-edges is spread over all. Stops when no rank changes by ``tol`` or more in a round; that it
    does not settle in ``max_rounds`` is an error."""
    edges = graph.edges.join(graph.out_degrees(), F.col("src") == F.col("id")).withColumn("weight", 1.0 / F.col("out_degree")).drop("id", "out_degree")
    arcs = stage(edges.select("src", "dst", "weight"), "weights")
    sources = stage(arcs.frame.select(F.col("src").alias("id")).distinct().withColumn("leaves", F.lit(True)), "sources")
    ids = stage(graph.vertices.select("id").join(sources.frame, "id", "left").withColumn("leaves", F.coalesce("leaves", F.lit(False))), "ids")
    total = ids.count()
    ranks = stage(ids.frame.withColumn("rank", F.lit(1.0)), "ranks")
    for _ in range(max_rounds if total else 0):
        lost = ranks.frame.agg(F.coalesce(F.sum(F.when(~F.col("leaves"), F.col("rank"))), F.lit(0.0))).first()[0]
        given = arcs.frame.join(ranks.frame.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("weight")).alias("given"))
        new = ranks.frame.join(given, F.col("id") == F.col("to"), "left").select(
            "id", "leaves", (F.lit(reset) + (1 - reset) * (F.coalesce("given", F.lit(0.0)) + lost / total)).alias("rank"), F.col("rank").alias("old")
        )
        following = stage(new, "ranks")
        change = following.frame.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks.drop()
        ranks = following
        if change < tol:
            break
    else:
        if total:
            raise RuntimeError(f"ranks not settled after {max_rounds} rounds")
    ranked = graph.vertices.join(ranks.frame.select(F.col("id").alias("__id"), F.col("rank").alias("pagerank")), F.col("id") == F.col("__id")).drop("__id")
    return ranked, edges
