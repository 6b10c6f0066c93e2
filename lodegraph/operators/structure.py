"""Candidates by structure alone, their orders, and a range join over angles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import angle, dot, literal, norm
from ..plans.query import Query
from ..session import written
from .graph import Graph
from .match import roles, support


def domains(graph: Graph, query: Query) -> DataFrame:
    """(u, v): data vertices that have at least the query vertex's degree; a query vertex without edges takes every vertex."""
    need = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(len(n)).alias("need")) for u, n in enumerate(query.neighbours)])
    v = graph.vertices.select("id").join(graph.degrees(), "id", "left")
    each = v.select(F.col("id").alias("v"), F.coalesce("deg", F.lit(0)).alias("deg"), F.explode(need).alias("c"))
    return each.where("deg >= c.need").select("c.u", "v")


def _supported(graph: Graph, kept: DataFrame, u: int, others: list[int]) -> DataFrame:
    """(v) of u's domain that have a neighbour in the domain of each other query vertex; the edges are read once for all of them."""
    bit = F.element_at(F.array(*[F.lit(1 << others.index(w) if w in others else 0) for w in range(max(others) + 1)]), F.col("u") + 1)
    held = kept.where(F.col("u").isin(others)).groupBy(F.col("v").alias("dst")).agg(F.bit_or(bit).alias("m"))
    around = graph.edges.join(held, "dst").groupBy(F.col("src").alias("v")).agg(F.bit_or("m").alias("m"))  # a row for each vertex leaves a task
    return kept.where(F.col("u") == u).select("v").join(around.where(F.col("m") == (1 << len(others)) - 1), "v", "left_semi")


def refined(graph: Graph, query: Query, root: int | None = None) -> DataFrame:
    """(u, v): domains of structure after a pass from the root (each vertex has a neighbour in its tree parent's domain)
    and passes back to it until nothing changes (a neighbour in the domain of each tree child and of each other query neighbour).

    The root is the vertex of least domain size for its degree, unless given.
    """
    query.require_connected()
    near = query.neighbours
    kept = written(domains(graph, query))
    if root is None:
        counts = {r["u"]: r["n"] for r in kept.groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
        root = min(range(query.size), key=lambda u: (counts.get(u, 0) / max(1, len(near[u])), -len(near[u]), u))
    order = query.order(root)
    parent = {u: min((w for w in near[u] if order.index(w) < order.index(u)), key=order.index) for u in order[1:]}
    for u in order[1:]:
        own = _supported(graph, kept, u, [parent[u]]).select(F.lit(u).alias("u"), "v")
        kept = written(kept.where(F.col("u") != u).unionByName(own))
    others = {u: [w for w in near[u] if parent.get(u) != w] for u in order}
    count = kept.count()
    while True:
        for u in reversed(order):
            if others[u]:
                own = _supported(graph, kept, u, others[u]).select(F.lit(u).alias("u"), "v")
                kept = written(kept.where(F.col("u") != u).unionByName(own))
        now = kept.count()
        if now == count:
            return kept
        count = now


def support_by_roles(graph: Graph, query: Query, cand: DataFrame) -> DataFrame:
    """(u, w, a, b), as ``support``, by testing the bits of both ends' role masks: each data edge is read once for all query edges."""
    mask = roles(cand)
    both = graph.edges.join(mask.select(F.col("v").alias("src"), F.col("mask").alias("m")), "src").join(mask.select(F.col("v").alias("dst"), F.col("mask").alias("n")), "dst")
    pairs = [(u, w) for u, near in enumerate(query.neighbours) for w in near]
    if not pairs:
        return support(graph, query, cand)
    bit = lambda c, u: F.shiftright(c, u).bitwiseAND(F.lit(1)) == 1
    told = F.array_compact(F.array(*[F.when(bit(F.col("m"), u) & bit(F.col("n"), w), F.struct(F.lit(u).alias("u"), F.lit(w).alias("w"))) for u, w in pairs]))
    return both.where(F.bit_count("m") * F.bit_count("n") > 0).select("src", "dst", F.explode(told).alias("e")).select("e.u", "e.w", F.col("src").alias("a"), F.col("dst").alias("b"))


def angle_candidates(graph: Graph, query: Query, tau: float, landmark: int = 0, buckets: int = 256) -> DataFrame:
    """(u, v, score) by a range join: angles of all vertices to one landmark, the query vector of ``landmark``, against the
    interval of angles around each query vertex that tau allows; bucketed, so that it is an equi-join. The product decides.

    For unit vectors; others pass by every interval.
    """
    axis = query.vectors[landmark]
    unit = lambda x: abs(math.fsum(e * e for e in x) - 1) < 1e-6
    if not unit(axis):
        raise ValueError("the landmark must be of unit length")
    wide = math.acos(max(-1.0, min(1.0, tau))) + 5e-3
    turn = math.pi / buckets
    spans = []
    for u, q in enumerate(query.vectors):
        at = math.acos(max(-1.0, min(1.0, math.fsum(a * b for a, b in zip(q, axis, strict=True)))))
        lo, hi = (max(0.0, at - wide), min(math.pi, at + wide)) if unit(q) else (0.0, math.pi)
        spans += [(u, k, lo, hi) for k in range(int(lo / turn), int(hi / turn) + 1)]
    ranges = graph.vertices.sparkSession.createDataFrame([*spans, *[(u, -1, 0.0, math.pi) for u in range(query.size)]], "u int, bucket int, lo double, hi double")
    seen = graph.vertices.withColumn("angle", angle(dot("x", literal(axis))))
    seen = seen.withColumn("bucket", F.when(F.abs(norm("x") - 1) < 1e-6, F.floor(F.col("angle") / turn)).otherwise(-1).cast("int"))
    inside = (F.col("bucket") == -1) | F.col("angle").between(F.col("lo"), F.col("hi"))
    vectors = F.array(*[literal(q) for q in query.vectors])
    near = seen.join(F.broadcast(ranges), "bucket").where(inside)  # at most buckets + 2 rows for each query vertex
    return near.select("u", F.col("id").alias("v"), dot("x", F.element_at(vectors, F.col("u") + 1)).alias("score")).where(F.col("score") >= tau)


def in_order(cand: DataFrame, by: str, graph: Graph | None = None) -> DataFrame:
    """cand with place, 1, 2, ... for each query vertex: by "score" (falling, then v) or by "degree" of the data vertex (rising, then v)."""
    if by == "score":
        keys = [F.desc("score"), F.col("v")]
    elif by == "degree" and graph is not None:
        cand = cand.join(graph.degrees(), F.col("v") == F.col("id"), "left").drop("id").withColumn("deg", F.coalesce("deg", F.lit(0)))
        keys = [F.col("deg"), F.col("v")]
    else:
        raise ValueError("by is score, or degree with a graph")
    return cand.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(*keys)))


def similarity_sums(query: Query) -> list[float]:
    """Each query vector's products with all others, summed."""
    return [math.fsum(math.fsum(a * b for a, b in zip(x, y, strict=True)) for k, y in enumerate(query.vectors) if k != n) for n, x in enumerate(query.vectors)]


def query_tree(query: Query, root: int) -> list[tuple[int, int | None]]:
    """(vertex, parent) breadth first from the root; neighbours of greatest similarity first, then of greatest degree, then of least number."""
    near, out, seen = query.neighbours, [(root, None)], {root}
    sim = lambda a, b: math.fsum(x * y for x, y in zip(query.vectors[a], query.vectors[b], strict=True))
    for u, _ in out:
        for w in sorted(near[u], key=lambda w: (-sim(u, w), -len(near[w]), w)):
            if w not in seen:
                seen.add(w)
                out.append((w, u))
    return out
