import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import export, match, ranked
from lodegraph.operators.graph import Graph
from lodegraph.plans.query import SHAPES, Query, densities, nested
from lodegraph.sources import files


def made(spark, vectors, edges, normalize=False):
    v = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(vectors)], "id long, x array<float>")
    return Graph.of(v, spark.createDataFrame(edges, "src long, dst long"), normalize)


def brute(vectors, edges, query, tau):
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    ok = [[v for v, x in enumerate(vectors) if sum(a * b for a, b in zip(x, q, strict=True)) >= tau] for q in query.vectors]
    return sorted(m for m in itertools.product(*ok) if len(set(m)) == len(m) and all((m[a], m[b]) in both for a, b in query.edges))


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(3)
    vectors = [[r.choice((-1.0, -0.5, 0.5, 1.0)) for _ in range(4)] for _ in range(12)]
    edges = [(a, b) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.4]
    return vectors, edges, made(spark, vectors, edges)


@pytest.mark.parametrize("shape", ["triangle", "cycle4"])
@pytest.mark.parametrize("options", [{}, {"strategy": "late"}, {"arc_rounds": 1, "blocks": 4}])
def test_matches_brute_force(small, shape, options):
    vectors, edges, g = small
    q = g.query_of(list(range(max(max(e) for e in SHAPES[shape]) + 1)), SHAPES[shape])
    got = sorted(tuple(r) for r in match.match(g, q, 0.5, **options).collect())
    assert got == brute(vectors, edges, q, 0.5)


def test_automorphic_and_non_induced(spark):
    g = made(spark, [[1, 0]] * 4, [(a, b) for a in range(4) for b in range(a + 1, 4)])
    assert match.match(g, Query([[1.0, 0.0]] * 4, SHAPES["cycle4"]), 0.9).count() == 24


def test_late_filter_reads_edges_between_candidates(spark, monkeypatch):
    """A hub with many leaves that are no candidates: late joined all pairs of its leaves."""
    leaves = 60
    vectors, edges = [[1, 0]] * 3 + [[0, 1]] * leaves, [(0, 1), (1, 2), (0, 2)] + [(0, k) for k in range(3, 3 + leaves)]
    g = made(spark, vectors, edges)
    sizes = []
    monkeypatch.setattr(match, "written", lambda d, w=match.written: sizes.append((d.columns, (out := w(d)).count())) or out)
    q = g.query_of([0, 1, 2], SHAPES["triangle"])
    got = sorted(map(tuple, match.match(g, q, 0.9, strategy="late").collect()))
    assert got == brute(vectors, edges, q, 0.9) and len(got) == 6
    assert [n for c, n in sizes if c == ["src", "dst"]] == [6]


def test_single_vertex_disconnected_and_limit(spark):
    g = made(spark, [[1, 0], [0, 1], [1, 0]], [(0, 1)])
    assert {r[0] for r in match.match(g, Query([[1.0, 0.0]], []), 0.9).collect()} == {0, 2}
    with pytest.raises(ValueError):
        match.match(g, Query([[1.0, 0.0]] * 2, []), 0.9)
    assert match.match(g, Query([[1.0, 0.0]], []), 0.9, max_matches=1).collect()[0][0] == 0


def test_ranked_exact_flags_agree(small):
    vectors, edges, g = small
    q = g.query_of([0, 1, 2], SHAPES["path3"])
    exact = set(brute(vectors, edges, q, 0.5))
    for rows in (ranked.loss_search(g, q, 0.5, topk=50), ranked.neighbourhood_cost(g, q, 0.5, topk=50, rounds=2)):
        got = rows.collect()
        assert got and [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert all(r["exact_valid"] is False or (r["q0"], r["q1"], r["q2"]) in exact for r in got)


def test_context_and_export(spark):
    g = made(spark, [[1, 0]] * 5, [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert {(r["id"], r["hop"]) for r in g.context(spark.createDataFrame([(0,)], "id long"), 2).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {(r["src"], r["dst"], r["dist"]) for r in g.within(2).where("src = 0").collect()} == {(0, 1, 1), (0, 2, 2)}
    q = Query([[1.0, 0.0]] * 2, [(0, 1)])
    found = match.match(g, q, 0.9).where("q0 = 0")
    nodes, links = export.neighbourhood(g, found, q, 1)
    assert {(r["source"], r["target"], r["edge_kind"]) for r in links.collect()} == {(0, 1, "matched_query_edge"), (1, 2, "context_incident_edge")}


def test_families():
    assert nested([(0, 1), (1, 2), (0, 2)], [2, 0, 1], 2) == [(0, 1)]
    assert [len(e) for e in densities(5, 4)] == [10, 9, 8, 7, 6, 5, 4]


def test_loader_rules(spark, tmp_path):
    v, e = tmp_path / "v.csv", tmp_path / "e.csv"
    v.write_text("id,f0,f1\r\n0,1,\r\n\r\n3,0,2\r\n0,3,4\r\nx\r\n")
    e.write_text("src,dst\r\n0,3\n3,0\n1,1\n")
    g = files.read_graph(spark, str(v), str(e))
    assert {r["id"]: [round(z, 3) for z in r["x"]] for r in g.vertices.collect()} == {0: [0.6, 0.8], 1: [0, 0], 2: [0, 0], 3: [0, 1]}
    assert sorted(tuple(r) for r in g.edges.collect()) == [(0, 3), (3, 0)]
    e.write_text("src,dst\n0,9\n")
    with pytest.raises(ValueError):
        files.read_graph(spark, str(v), str(e))
    v.write_text("id,f0,f1\n0,1,2\n1,3\n")
    with pytest.raises(ValueError):
        files.read_vertices(spark, str(v))


def test_entry_without_corpus():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and F is not None
