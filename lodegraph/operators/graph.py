"""Vector-attributed graphs as two tables, and operators on their structure."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm, normalized
from ..plans.query import Query
from ..session import written
from . import packed


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Both directions of each edge once; self-loops go."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    once = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return once.select(F.explode(both).alias("e")).select("e.src", "e.dst")  # not a union, which would make them once for each direction


@dataclass
class Graph:
    """vertices (id, x) and symmetric, distinct edges (src, dst)."""

    vertices: DataFrame
    edges: DataFrame
    _packed: DataFrame | None = field(default=None, repr=False, compare=False)

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, normalize: bool = True, check: bool = True) -> Graph:
        if check and edges.join(vertices, edges["src"] == vertices["id"], "left_anti").unionAll(edges.join(vertices, edges["dst"] == vertices["id"], "left_anti")).limit(1).count():
            raise ValueError("an edge names a vertex that does not exist")
        return Graph(vertices.select("id", (normalized("x") if normalize else F.col("x")).alias("x")), undirected(edges))

    def degrees(self) -> DataFrame:
        """(id, deg) of vertices that have edges."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))

    def induced(self, ids: DataFrame) -> DataFrame:
        """Edges with both ends in ids (id)."""
        e = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        return e.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")

    def packed(self) -> DataFrame:
        """The edges as packed lists, made once."""
        if self._packed is None:
            self._packed = packed.packed(self.edges)
        return self._packed

    def within(self, hops: int, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
        """(src, dst, dist): vertices 1 to ``hops`` edges away from starts (id; None: from all), with the least distance; ends: only those (id).

        With ends the last step follows only edges that lead to them, as joins;
        else each start's vertices are found in one task, from packed lists.
        """
        e = self.edges
        if ends is None:
            kind = self.edges.schema["src"].dataType.simpleString()
            from_ = (e.select(F.col("src").alias("id")) if starts is None else starts.select("id")).distinct()
            found = packed.each_start(self.packed(), from_, packed.hops(hops), "int", "src long, dst long, dist int")
            return found.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "dist")
        into = ends.select(F.col("id").alias("dst")).distinct()
        first = e if starts is None else e.join(starts.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
        out = ring = first.select("src", "dst", F.lit(1).alias("dist"))
        last = written(e.join(into, "dst", "left_semi").select("src", "dst")) if hops > 1 else e
        for d in range(2, hops + 1):
            on = last if d == hops else e
            step = ring.join(on.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").where("next <> src")
            step = step.select("src", F.col("next").alias("dst")).distinct()
            known = out.join(into, "dst", "left_semi").select("src", "dst", "dist") if d == hops else out
            ring = step.join(known, ["src", "dst"], "left_anti").select("src", "dst", F.lit(d).alias("dist"))
            out = known.unionByName(ring)
        return out if hops > 1 else out.join(into, "dst", "left_semi").select("src", "dst", "dist")

    def context(self, seeds: DataFrame, hops: int = 1, cap: int | None = None) -> DataFrame:
        """(id, hop): seeds (id) and what stands up to ``hops`` edges around; cap: neighbours of a vertex that are looked at, smallest ids first."""
        e = self.edges
        if cap:
            e = e.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("n") <= cap).drop("n")
        out = ring = seeds.select("id").distinct().withColumn("hop", F.lit(0))
        for h in range(1, hops + 1):
            ring = ring.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(out, "id", "left_anti").withColumn("hop", F.lit(h))
            out = out.unionByName(ring)
        return out

    def random_walk(self, seeds: DataFrame, rounds: int = 10, alpha: float = 0.85, only: list[int] | None = None) -> DataFrame:
        """(seed, id, mass): random walk with restart from each seed (id), scaled to sum 1; only: ids whose mass is told.

        Edges go both ways, so no vertex that is reached loses mass, and scaling
        changes nothing but for seeds without edges, which keep their own; so it
        is scaled once, at the end. Some seeds walk together in a task, over packed lists.
        """
        kind = seeds.schema["id"].dataType.simpleString()
        wanted = None if only is None else np.unique(np.array(only, np.int64))
        found = packed.each_start(self.packed(), seeds.select("id").distinct(), packed.walks(rounds, alpha, wanted), "double", "seed long, id long, mass double")
        return found.select(F.col("seed").cast(kind).alias("seed"), F.col("id").cast(kind).alias("id"), "mass")

    def query_of(self, ids: list[int], edges: list[tuple[int, int]] | None = None) -> Query:
        """A query made of some vertices (with the edges between them, or given ones)."""
        spark = self.vertices.sparkSession
        want = spark.createDataFrame([(i,) for i in ids], self.vertices.select("id").schema)
        x = {r["id"]: [float(v) for v in r["x"]] for r in self.vertices.join(F.broadcast(want), "id").collect()}
        if edges is None:
            place = {v: k for k, v in enumerate(ids)}
            edges = [(place[r["src"]], place[r["dst"]]) for r in self.induced(want).collect()]
        return Query([x[i] for i in ids], edges, list(ids))

    def sample_query(self, k: int, seed: int = 42, tries: int = 100) -> Query:
        """A connected set of k vertices with its edges, grown from a seeded start; the same for the same seed and graph."""
        for t in range(tries):
            start = self.degrees().orderBy(F.xxhash64(F.lit(seed), F.lit(t), "id"), "id").limit(1).collect()
            if not start:
                break
            ids = [start[0]["id"]]
            while len(ids) < k:
                near = self.edges.where(F.col("src").isin(ids) & ~F.col("dst").isin(ids)).select("dst").distinct().orderBy(F.xxhash64(F.lit(seed), F.lit(t), F.lit(len(ids)), "dst"), "dst").limit(1).collect()
                if not near:
                    break
                ids.append(near[0]["dst"])
            if len(ids) == k:
                return self.query_of(ids)
        raise ValueError(f"no connected query of {k} vertices was found in {tries} tries")

    def sample_ball_query(self, k: int, seed: int = 42, hops: int = 2, tries: int = 20) -> Query:
        """k vertices in the order of a shuffled breadth-first search within ``hops`` edges of a seeded start, vectors of length 0 left out; with the edges between them."""
        good = self.vertices.where(norm("x") > 1e-12).select("id")
        starts = [r["id"] for r in good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(tries).collect()]
        for t, start in enumerate(starts):
            spark = self.vertices.sparkSession
            ball = self.context(spark.createDataFrame([(start,)], good.schema), hops).select("id").join(good, "id", "left_semi")
            if ball.limit(k).count() < k:
                continue
            chosen, queue, seen = [], [start], {start}
            while queue and len(chosen) < k:
                at = queue.pop(0)
                chosen.append(at)
                near = self.edges.where(F.col("src") == at).select(F.col("dst").alias("id")).where(~F.col("id").isin(*seen)).join(ball, "id", "left_semi")
                # Of a hub, no more than can still be chosen.
                more = [r["id"] for r in near.orderBy(F.xxhash64(F.lit(seed), F.lit(t), F.lit(at), "id"), "id").limit(k).collect()]
                seen.update(more)
                queue += more
            if len(chosen) == k:
                query = self.query_of(chosen)
                if query.edges:
                    return query
        raise ValueError(f"no query of {k} vertices was found in {tries} tries")
