"""Exact semantic subgraph matching, as joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import angle, bounded_dot, dot, literal, norm
from ..plans.query import Query
from ..session import written
from .graph import Graph


def _float(tau: float) -> float:
    """The threshold as single precision holds it."""
    import struct

    return struct.unpack("f", struct.pack("f", tau))[0]


def candidates(graph: Graph, query: Query, tau: float, degree_filter: bool = False, landmarks: bool = False, blocks: int = 0, single: bool = False, single_tau: bool = True) -> DataFrame:
    """(u, v, score): data vertices that reach tau for each query vertex.

    The few query vectors go into the expression, so every vertex is read once
    and nothing is joined. Options prune only: degrees, angles to the query
    vectors as landmarks (vectors that are not of unit length pass), bounds after
    blocks of the product. single: compare in single precision.
    """
    limit = _float(tau) if single_tau else tau
    near = query.neighbours
    v = graph.vertices
    if degree_filter:
        v = v.join(graph.degrees(), "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    told = []
    for u, q in enumerate(query.vectors):
        score = bounded_dot("x", q, limit, blocks) if blocks else dot("x", literal(q))
        keep: Column = (score.cast("float") >= F.lit(limit).cast("float")) if single else score >= limit
        if landmarks:
            unit = [k for k, other in enumerate(query.vectors) if abs(math.fsum(e * e for e in other) - 1) < 1e-6]
            if u in unit:
                # Angles near 0 carry the rounding of the vectors' lengths magnified.
                cap = math.acos(max(-1.0, min(1.0, limit))) + 5e-3
                own = {k: math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(q, query.vectors[k], strict=True))))) for k in unit}
                close = reduce(lambda a, b: a & b, [F.abs(angle(dot("x", literal(query.vectors[k]))) - own[k]) <= cap for k in unit])
                keep = (close | (F.abs(norm("x") - 1) >= 1e-6)) & keep
        if degree_filter:
            keep = (F.col("deg") >= len(near[u])) & keep
        told.append(F.when(keep, F.struct(F.lit(u).alias("u"), score.alias("score"))))
    return v.select(F.col("id").alias("v"), F.explode(F.array_compact(F.array(*told))).alias("c")).select("c.u", "v", "c.score")


def roles(cand: DataFrame) -> DataFrame:
    """(v, mask): a bit for every query vertex that v can play."""
    return cand.groupBy("v").agg(F.bit_or(F.expr("shiftleft(1L, u)")).alias("mask"))


def support(graph: Graph, query: Query, cand: DataFrame) -> DataFrame:
    """(u, w, a, b): data edges a-b that can play the directed query edge u-w."""
    if not query.edges:
        return cand.select("u", F.col("u").alias("w"), F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
    near = query.neighbours
    of_u = F.array(*[F.array(*[F.lit(w) for w in n]).cast("array<int>") for n in near])
    left = cand.select("u", F.col("v").alias("a"), F.explode(F.element_at(of_u, F.col("u") + 1)).alias("w"))
    e = left.join(graph.edges, F.col("a") == F.col("src")).select("u", "w", "a", F.col("dst").alias("b"))
    return e.join(cand.select(F.col("u").alias("w"), F.col("v").alias("b")), ["w", "b"], "left_semi").select("u", "w", "a", "b")


def arc_consistent(graph: Graph, query: Query, cand: DataFrame, rounds: int | None = None) -> DataFrame:
    """Candidates that keep, for each query edge, a neighbour among the other end's candidates; to the fixpoint or for some rounds."""
    near = query.neighbours
    degree = F.element_at(F.array(*[F.lit(len(n)) for n in near]), F.col("u") + 1)
    last = None
    n = 0
    while rounds is None or n < rounds:
        kept = support(graph, query, cand).groupBy("u", F.col("a").alias("v")).agg(F.countDistinct("w").alias("n"))
        alone = [u for u in range(query.size) if not near[u]]
        now = cand.join(kept.where(F.col("n") == degree), ["u", "v"], "left_semi")
        if alone:
            now = now.unionByName(cand.where(F.col("u").isin(alone)))
        n += 1
        cand = now
        if rounds is None:
            cand = written(now)
            count = cand.count()
            if count == last:
                break
            last = count
    return cand


def match(graph: Graph, query: Query, tau: float = 0.97, strategy: str = "early", arc_rounds: int = 0, degree_filter: bool = False, landmarks: bool = False, blocks: int = 0, max_matches: int = 0, scores: bool = False, cand: DataFrame | None = None, order: list[int] | None = None) -> DataFrame:
    """Every injective, edge-preserving mapping with all cosines at tau or more: columns q0, q1, ... (and s0, s1, ... with scores).

    The smallest candidate set is read first; each further query vertex joins
    along one edge to a placed neighbour, with the other edges to placed ones as
    semi-joins in the same step. Only data edges between candidates are read, and a
    step's edges lead to that vertex's candidates only, so a hub costs no more than the candidates around it. strategy "late" joins structure first, over the
    same edges, and tests which query vertex's candidate each vertex is at the end; it returns the same rows. max_matches keeps the first
    mappings by q0, q1, ...; 0 keeps all.
    """
    query.require_connected()
    if strategy not in ("early", "late"):
        raise ValueError("strategy is early or late")
    k, near = query.size, query.neighbours
    if cand is None:
        cand = candidates(graph, query, tau, degree_filter, landmarks, blocks)
    if arc_rounds:
        cand = arc_consistent(graph, query, cand, arc_rounds)
    if order is None:
        cand = written(cand)
        counts = {r["u"]: r["n"] for r in cand.groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
        order = query.join_order([counts.get(u, 0) for u in range(k)])
    held = cand.select(F.col("v").alias("id")).distinct()
    edges = written(graph.induced(held))  # a vertex that is no candidate at all stands in no match, so "late" needs no paths through it

    def own(u: int) -> DataFrame:
        return cand.where(F.col("u") == u).select(F.col("v").alias(f"q{u}"), F.col("score").alias(f"s{u}"))

    first = order[0]
    out = own(first) if strategy == "early" else held.select(F.col("id").alias(f"q{first}"))
    placed = [first]
    for u in order[1:]:
        back = [w for w in placed if w in near[u]]
        step = edges.select(F.col("src").alias(f"q{back[0]}"), F.col("dst").alias(f"q{u}"))
        out = out.join(step.join(own(u), f"q{u}") if strategy == "early" else step, f"q{back[0]}")
        out = out.where(reduce(lambda a, b: a & b, [F.col(f"q{u}") != F.col(f"q{w}") for w in placed]))
        for w in back[1:]:
            out = out.join(edges.select(F.col("src").alias(f"q{w}"), F.col("dst").alias(f"q{u}")), [f"q{w}", f"q{u}"], "left_semi")
        placed.append(u)
    if strategy == "late":
        for u in order:
            out = out.join(own(u), f"q{u}")
    names = [f"q{u}" for u in range(k)]
    out = out.select(*names, *([f"s{u}" for u in range(k)] if scores else []))
    return out.orderBy(*names).limit(max_matches) if max_matches else out


def ranked(found: DataFrame, k: int, top: int | None = None, truth: list[int] | None = None) -> DataFrame:
    """Matches with scores, as min_sim, sum_sim, is_truth, best first (then by mapping)."""
    low = F.least(*[F.col(f"s{u}") for u in range(k)]) if k > 1 else F.col("s0")
    total = reduce(lambda a, b: a + b, [F.col(f"s{u}") for u in range(k)])
    same = reduce(lambda a, b: a & b, [F.col(f"q{u}") == truth[u] for u in range(k)]) if truth else F.lit(False)
    out = found.select(*[f"q{u}" for u in range(k)], low.alias("min_sim"), total.alias("sum_sim"), same.alias("is_truth"))
    keys = [F.desc("min_sim"), F.desc("sum_sim"), *[f"q{u}" for u in range(k)]]
    return out.orderBy(*keys).limit(top) if top is not None else out


def disjoint(found: DataFrame, k: int, other: list[int]) -> DataFrame:
    """Matches that share no vertex with another mapping."""
    return found.where(~F.arrays_overlap(F.array(*[F.col(f"q{u}") for u in range(k)]), F.array(*[F.lit(v).cast("bigint") for v in other])))


def numbered(rows: DataFrame, keys: list[str], name: str = "match_id") -> DataFrame:
    """rows with their places 1, 2, ... in the order of keys: sorted by ranges, counted by part, and numbered from each part's offset."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = written(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted((r["_part"], r["n"]) for r in marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each part
    before, told = 0, []
    for part, n in sizes:
        told.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(told, "_part int, _before long")
    return marked.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def roles_of_matches(found: DataFrame, k: int, number: bool = True) -> DataFrame:
    """(match_id, role, id): one row a match and query vertex, matches numbered by mapping; without numbers if they aren't wanted."""
    names = [f"q{u}" for u in range(k)]
    rows = numbered(found.select(*names), names).select("match_id", *names) if number else found
    return rows.select(*(["match_id"] if number else []), F.posexplode(F.array(*names)).alias("role", "id"))


def mapping_key(k: int) -> Column:
    """A mapping's ids, joined by commas."""
    return F.concat_ws(",", *[F.col(f"q{u}").cast("string") for u in range(k)])


def representatives(found: DataFrame, k: int, truth: list[int] | None = None) -> tuple[list | None, list | None]:
    """(A, B): the mapping truth if it was found, else the best; and the best that shares no vertex with it. found has scores."""
    names = [f"q{u}" for u in range(k)]
    best = ranked(found, k, 1, truth)
    first = best
    if truth:
        true = reduce(lambda a, b: a & b, [F.col(q) == t for q, t in zip(names, truth, strict=True)])
        first = ranked(found.where(true), k, 1, truth)
    a = first.collect() or best.collect()
    if not a:
        return None, None
    b = ranked(disjoint(found, k, [a[0][q] for q in names]), k, 1, truth).collect()
    return [a[0][q] for q in names], [b[0][q] for q in names] if b else None


def truth_statistics(found: DataFrame, k: int, truth: list[int]) -> DataFrame:
    """(n, truth_count, truth_first_id): matches, those that equal truth, and the least number of such a one (matches numbered by mapping)."""
    names = [f"q{u}" for u in range(k)]
    same = reduce(lambda a, b: a & b, [F.col(q) == t for q, t in zip(names, truth, strict=True)])
    before = reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [F.col(names[i]) == truth[i] for i in range(n)], F.col(names[n]) < truth[n]) for n in range(k)])
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("truth_count"), F.count_if(before).alias("b"))
    return counts.select("n", "truth_count", F.when(F.col("truth_count") > 0, F.col("b") + 1).alias("truth_first_id"))
