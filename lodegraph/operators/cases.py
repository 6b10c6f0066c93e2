"""Case studies: sampled queries that pass bounds, their matches, and the best match that shares nothing with the truth."""

from __future__ import annotations

import random
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Query
from ..session import written
from .graph import Graph
from .match import candidates, disjoint, match, ranked, truth_statistics
from .text import cohesion


@dataclass
class Bounds:
    """What a sampled query must meet."""

    edges: tuple[int, int] = (4, 8)
    pair_avg: float = -1.0
    centroid_min: float = -1.0
    candidates: tuple[int, int] = (1, 1 << 62)

    def holds(self, n_edges: int, pair_avg: float | None, centroid_min: float | None, counts: list[int] | None = None) -> bool:
        if not self.edges[0] <= n_edges <= self.edges[1]:
            return False
        if (1.0 if pair_avg is None else pair_avg) < self.pair_avg or (centroid_min or 0.0) < self.centroid_min:
            return False
        return counts is None or (min(counts) >= self.candidates[0] and max(counts) <= self.candidates[1])


@dataclass
class Case:
    """A query that was run: its figures and its matches with scores."""

    query: Query
    record: dict
    matches: DataFrame = field(repr=False)


def domain(graph: Graph, query: Query, tau: float) -> DataFrame:
    """(u, v, score) at tau or more with the query vertex's degree."""
    return candidates(graph, query, tau, degree_filter=True)


def run_query(graph: Graph, query: Query, tau: float = 0.70, least_disjoint: float = -1.0) -> Case:
    """All matches of a query, whether they hold the query's own vertices, and the best match that shares none of them."""
    began = time.time()
    cand = written(domain(graph, query, tau))
    found = {r["u"]: r["n"] for r in cand.groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
    matches = written(match(graph, query, tau, cand=cand, scores=True))
    stats = truth_statistics(matches, query.size, query.sources).first()
    best = ranked(disjoint(matches, query.size, query.sources), query.size).where(F.col("min_sim") >= least_disjoint)
    best = best.orderBy(F.desc("min_sim"), F.desc("sum_sim"), *[f"q{u}" for u in range(query.size)]).limit(1).collect()
    record = {
        "edge_count": len(query.edges),
        "candidate_counts": [found.get(u, 0) for u in range(query.size)],
        "match_count": stats["n"],
        "ground_truth_recovered": stats["truth_count"] > 0,
        "ground_truth_first_match_id": stats["truth_first_id"],
        "disjoint_found": bool(best),
        "disjoint_min_similarity": best[0]["min_sim"] if best else None,
        "disjoint_sum_similarity": best[0]["sum_sim"] if best else None,
        "disjoint_mapping": [best[0][f"q{u}"] for u in range(query.size)] if best else None,
        "seconds": round(time.time() - began, 3),
    }
    return Case(query, record, matches)


def search(graph: Graph, k: int, bounds: Bounds, tau: float = 0.70, attempts: int = 500, seed: int = 42, least_disjoint: float = -1.0, require_disjoint: bool = True, fail: bool = False) -> tuple[Case, list[dict]]:
    """(case, log of the attempts that passed the bounds): the first whose own vertices are found and that has a disjoint match;
    else, unless ``fail``, the best by the disjoint match's least similarity, mean similarity of pairs, and fewest candidates."""
    r = random.Random(seed)
    log: list[dict] = []
    best: tuple[tuple, Case] | None = None
    for attempt in range(attempts):
        try:
            query = graph.sample_query(k, r.randrange(1 << 31), 1)
        except ValueError:
            continue
        if not bounds.holds(len(query.edges), None, 1.0):
            continue
        told = cohesion(graph.vertices, query.sources).first()
        if not bounds.holds(len(query.edges), told["pair_avg"], told["centroid_min"]):
            continue
        counts = {x["u"]: x["n"] for x in domain(graph, query, tau).groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not bounds.holds(len(query.edges), told["pair_avg"], told["centroid_min"], [counts.get(u, 0) for u in range(k)]):
            continue
        case = run_query(graph, query, tau, least_disjoint)
        case.record = {"attempt": attempt, "source_node_ids": [str(s) for s in query.sources], "pair_avg": told["pair_avg"], "centroid_min": told["centroid_min"], **case.record}
        log.append(case.record)
        low = case.record["disjoint_min_similarity"]
        quality = (-1.0 if low is None else low, told["pair_avg"] or 0.0, -max(case.record["candidate_counts"]))
        if best is None or quality > best[0]:
            best = (quality, case)
        if case.record["ground_truth_recovered"] and (case.record["disjoint_found"] or not require_disjoint):
            return case, log
    if best is None or fail:
        raise RuntimeError(f"no acceptable case in {attempts} attempts")
    return best[1], log


def summary(query: Query, found: DataFrame, phases: dict[str, float] | None = None, preview: int = 20) -> dict:
    """A run in figures: matches found, the first ones by mapping, seconds of the phases."""
    names = [f"q{u}" for u in range(query.size)]
    first = [[r[q] for q in names] for r in found.select(*names).orderBy(*names).limit(preview).collect()]
    seconds = {n: round(s, 6) for n, s in (phases or {}).items()}
    return {"matches": found.count(), "preview": first, "seconds": {**seconds, "total": round(sum(seconds.values()), 6)}}


def report(case: Case, papers: DataFrame | None = None, top: int = 20) -> tuple[str, dict]:
    """(Markdown, values) of a case: its figures, its best matches, and where they meet the query's own vertices.

    papers (id, title) name the vertices; only those that the report shows are read.
    """
    k = case.query.size
    rows = ranked(case.matches, k, top, case.query.sources).collect()
    shown = sorted({r[f"q{u}"] for r in rows for u in range(k)} | set(case.query.sources))
    titles = {str(r["id"]): r["title"] for r in papers.where(F.col("id").cast("string").isin([str(s) for s in shown])).select("id", "title").collect()} if papers is not None else {}
    name = lambda v: f"{v} ({titles[str(v)]})" if titles.get(str(v)) else str(v)
    best = [{"mapping": [r[f"q{u}"] for u in range(k)], "min_similarity": r["min_sim"], "sum_similarity": r["sum_sim"], "is_ground_truth": r["is_truth"], "shared_with_query": sorted(set(r[f"q{u}"] for u in range(k)) & set(case.query.sources))} for r in rows]
    values = {"query": {key: v for key, v in asdict(case.query).items() if key != "vectors"}, **case.record, "top_matches": best}
    lines = ["# Matches", "", *[f"- {key}: {v}" for key, v in case.record.items()], "", "## Query", ""]
    lines += [f"- q{u + 1}: {name(v)}" for u, v in enumerate(case.query.sources)] + [f"- q{a + 1} - q{b + 1}" for a, b in case.query.edges]
    lines += ["", "## Best", "", "| # | " + " | ".join(f"q{u + 1}" for u in range(k)) + " | min | sum | truth | shared |", "|" + "-|" * (k + 5)]
    lines += [f"| {n} | " + " | ".join(name(v) for v in b["mapping"]) + f" | {b['min_similarity']:.4f} | {b['sum_similarity']:.4f} | {b['is_ground_truth']} | {b['shared_with_query']} |" for n, b in enumerate(best, 1)]
    return "\n".join(lines) + "\n", values
