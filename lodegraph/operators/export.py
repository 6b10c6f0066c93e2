"""Neighbourhood export: node and edge tables around matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Query
from ..session import written
from .graph import Graph
from .match import numbered, roles_of_matches


def node_roles(found: DataFrame, k: int) -> DataFrame:
    """(id, match_count, roles): in how many matches a vertex stands, and how often in each role, as 'q1:3;q2:1'."""
    each = roles_of_matches(found, k, False).groupBy("id", "role").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "role", "n")))
    text = F.array_join(F.transform(ordered, lambda s: F.concat(F.lit("q"), (s["role"] + 1).cast("string"), F.lit(":"), s["n"].cast("string"))), ";")
    return each.groupBy("id").agg(F.sum("n").alias("match_count"), text.alias("roles"))


def _first(rows: DataFrame, keys: list[str], ids: int) -> DataFrame:
    """(keys, match_ids): the first match numbers of each key; Spark cuts each task's rows to as many before they are dealt."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("match_id"))
    return rows.withColumn("_n", at).where(F.col("_n") <= ids).groupBy(*keys).agg(F.array_sort(F.collect_list("match_id")).alias("match_ids"))


def edge_counts(found: DataFrame, query: Query, ids: int = 50) -> DataFrame:
    """(a, b, n, match_ids): matches that use each data edge (a < b), with the first match numbers."""
    names = [f"q{u}" for u in range(query.size)]
    rows = written(numbered(found.select(*names), names))
    pairs = F.array(*[F.struct(F.least(names[a], names[b]).alias("a"), F.greatest(names[a], names[b]).alias("b")) for a, b in query.edges])
    used = rows.select("match_id", F.explode(F.array_distinct(pairs)).alias("e")).select("match_id", "e.a", "e.b")
    return used.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(_first(used, ["a", "b"], ids), ["a", "b"])


def node_support(found: DataFrame, k: int, ids: int = 50) -> DataFrame:
    """(id, match_ids): the first matches in which a vertex stands."""
    return _first(roles_of_matches(found, k).select("match_id", "id"), ["id"], ids)


def neighbourhood(graph: Graph, found: DataFrame, query: Query, hops: int = 1, cap: int | None = None, highlight: dict[str, list[int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around all matches: kinds, weights, counts and the matches they stand in.

    highlight: up to a few mappings by name (such as the best match and the best that is disjoint from it).
    """
    roles = node_roles(found, query.size)
    around = graph.context(roles.select("id"), hops, cap)
    marks = {n: set(m) for n, m in (highlight or {}).items()}
    marked_edges = {n: {(min(m[a], m[b]), max(m[a], m[b])) for a, b in query.edges} for n, m in (highlight or {}).items()}

    def names(tests: dict[str, F.Column]) -> F.Column:
        return F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(t, F.lit(n)) for n, t in sorted(tests.items())])), ";")

    nodes = around.join(roles, "id", "left").join(node_support(found, query.size), "id", "left").withColumn("highlight", names({n: F.col("id").isin(*m) for n, m in marks.items()}))
    kind = F.when(F.col("highlight") != "", "highlight_match_vertex").when(F.col("match_count").isNotNull(), "matched_vertex").otherwise("context_vertex")
    nodes = nodes.select("id", "hop", kind.alias("node_kind"), F.col("match_count").isNotNull().alias("is_matched_vertex"), F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce("roles", F.lit("")).alias("query_roles"), "highlight", F.coalesce(F.array_join("match_ids", ";"), F.lit("")).alias("support_match_ids"))
    inner = graph.induced(around.select("id")).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    e = inner.join(edge_counts(found, query), ["a", "b"], "left")
    for side in "ab":
        e = e.join(roles.select(F.col("id").alias(side), F.lit(1).alias(f"m{side}")), side, "left")
    e = e.withColumn("highlight", names({n: reduce_any([(F.col("a") == a) & (F.col("b") == b) for a, b in pairs]) for n, pairs in marked_edges.items()}))
    ends = F.coalesce("ma", F.lit(0)) + F.coalesce("mb", F.lit(0))
    kind = F.when(F.col("highlight") != "", "highlight_match_edge").when(F.col("n") > 0, "matched_query_edge").when(ends > 0, "context_incident_edge").otherwise("context_edge")
    edges = e.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("Undirected").alias("type"), (1.0 + F.coalesce("n", F.lit(0))).alias("weight"), kind.alias("edge_kind"), ends.alias("matched_endpoint_count"), F.coalesce("n", F.lit(0)).alias("match_edge_count"), "highlight", F.coalesce(F.array_join("match_ids", ";"), F.lit("")).alias("support_match_ids"))
    return nodes, edges


def reduce_any(tests: list[F.Column]) -> F.Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
