import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lodegraph.operators import cases, export, match, ranked, structure
from lodegraph.operators import text as ops
from lodegraph.operators.graph import Graph, undirected
from lodegraph.plans.query import Query
from lodegraph.session import shared_dir


def small(spark, n=30, m=60, dim=4, seed=1, unit=True):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = {tuple(sorted(p)) for p in r.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
    v = spark.createDataFrame([(i, [float(e) for e in x[i]]) for i in range(n)], "id long, x array<double>")
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return Graph(v, undirected(e)), x, near


def plain_matches(q, x, near, tau):
    out = []
    for m in itertools.permutations(range(len(x)), q.size):
        if all(b in near[a] for a, b in ((m[a], m[b]) for a, b in q.edges)) and all(np.dot(q.vectors[u], x[m[u]]) >= tau for u in range(q.size)):
            out.append(m)
    return out


def test_landmarks_keep_vectors_of_any_length(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 3.0]), (2, [5.0, 0.1])], "id long, x array<double>")
    g = Graph(v, undirected(spark.createDataFrame([(0, 1)], "src long, dst long")))
    q = Query([[1.0, 0.0], [0.9, 3.0]], [(0, 1)])
    rows = lambda **o: sorted(map(tuple, match.candidates(g, q, 0.8, **o).collect()))
    assert rows() == rows(landmarks=True) and len(rows()) > 3
    g, _, _ = small(spark)
    q = g.query_of([0, 1, 2], [(0, 1), (1, 2)])
    assert sorted(r["v"] for r in match.candidates(g, q, 0.5).collect()) == sorted(r["v"] for r in match.candidates(g, q, 0.5, landmarks=True).collect())


def test_numbers_and_statistics(spark):
    rows = [(random.Random(k).randrange(50), k) for k in range(300)]
    d = spark.createDataFrame(rows, "q0 long, q1 long")
    got = match.numbered(d.repartition(7), ["q0", "q1"]).collect()
    assert [(r["q0"], r["q1"]) for r in sorted(got, key=lambda r: r["match_id"])] == sorted(rows) and {r["match_id"] for r in got} == set(range(1, 301))
    truth = sorted(rows)[77]
    s = match.truth_statistics(d, 2, list(truth)).first()
    assert tuple(s) == (300, 1, 78)
    assert tuple(match.truth_statistics(d, 2, [-1, 0]).first()) == (300, 0, None)
    assert match.numbered(d.limit(0), ["q0"]).count() == 0


def test_representatives_and_run(spark):
    g, x, near = small(spark, 14, 40)
    q = g.query_of([0, 1, 2], [(0, 1), (1, 2)])
    tau = 0.2
    want = plain_matches(q, x, near, match._float(tau))
    score = lambda m: (min(np.dot(q.vectors[u], x[m[u]]) for u in range(3)), sum(np.dot(q.vectors[u], x[m[u]]) for u in range(3)))
    case = cases.run_query(g, q, tau)
    assert case.record["match_count"] == len(want) and case.record["ground_truth_recovered"] == ((0, 1, 2) in want)
    apart = [m for m in want if not set(m) & {0, 1, 2}]
    assert case.record["disjoint_found"] == bool(apart)
    if apart:
        assert math.isclose(case.record["disjoint_min_similarity"], max(score(m) for m in apart)[0])
    a, b = match.representatives(case.matches, 3, list(want[0]))
    rest = [m for m in want if not set(m) & set(want[0])]
    assert a == list(want[0]) and (b is None) == (not rest) and (not rest or math.isclose(score(b)[0], max(map(score, rest))[0]))
    assert match.representatives(case.matches, 3)[0] == list(max(want, key=score))
    markdown, values = cases.report(case, spark.createDataFrame([(0, "zero")], "id long, title string"), 3)
    assert markdown.startswith("# Matches") and len(values["top_matches"]) == min(3, len(want)) and "0 (zero)" in markdown
    told = cases.summary(q, case.matches, {"load": 1.0, "match": 2.0}, 2)
    assert told["matches"] == len(want) and told["preview"] == [list(m) for m in sorted(want)[:2]] and told["seconds"]["total"] == 3


def test_case_search(spark):
    g, _, _ = small(spark, 30, 90)
    case, log = cases.search(g, 3, cases.Bounds((2, 3)), 0.1, attempts=5, require_disjoint=False)
    assert case.record["ground_truth_recovered"] and log[-1] == case.record
    with pytest.raises(RuntimeError):
        cases.search(g, 3, cases.Bounds((99, 99)), 0.1, attempts=2)
    b = cases.Bounds((1, 3), 0.5, 0.2, (2, 5))
    assert b.holds(2, 0.6, 0.3, [2, 5]) and not b.holds(4, 0.6, 0.3) and not b.holds(2, 0.4, 0.3) and not b.holds(2, 0.6, 0.1) and not b.holds(2, 0.6, 0.3, [1, 5]) and not b.holds(2, 0.6, 0.3, [2, 6])


def test_refined_keeps_what_structure_allows(spark):
    g, x, near = small(spark, 40, 45, seed=3)
    q = Query([[1.0, 0, 0, 0]] * 4, [(0, 1), (1, 2), (0, 2), (2, 3)])
    got = {(r["u"], r["v"]) for r in structure.refined(g, q).collect()}
    kept = {(u, m[u]) for m in plain_matches(q, np.ones((40, 4)), near, -9) for u in range(4)} if len(near) < 20 else set()
    every = {(r["u"], r["v"]) for r in structure.domains(g, q).collect()}
    assert every == {(u, v) for u in range(4) for v in range(40) if len(near[v]) >= len(q.neighbours[u])}
    assert kept <= got <= every
    for u, v in got:
        if u == 2:
            assert all(any((w, z) in got for z in near[v]) for w in (0, 1, 3))


def test_directions_and_supports_read_once(spark):
    """Each direction made the distinct edges again, and each other query vertex dealt all edges."""
    pairs = spark.range(40).selectExpr("id % 7 AS src", "id % 5 AS dst")
    both = undirected(pairs)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" not in plan
    assert sorted(map(tuple, both.collect())) == sorted({p for k in range(40) if k % 7 != k % 5 for p in ((k % 7, k % 5), (k % 5, k % 7))})
    g, _, near = small(spark, 40, 45, seed=3)
    kept = spark.createDataFrame([(u, v) for u in range(3) for v in range(40) if v % (u + 2)], "u int, v long")
    own = structure._supported(g, kept, 0, [1, 2])
    assert {r["v"] for r in own.collect()} == {v for v in range(40) if v % 2 and any(w % 3 for w in near[v]) and any(w % 4 for w in near[v])}
    assert own._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + own._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 3 + 1


def test_orders_and_tree(spark):
    g, x, near = small(spark)
    q = g.query_of([0, 1, 2], [(0, 1), (1, 2), (0, 2)])
    c = match.candidates(g, q, 0.1)
    for by, key in (("score", lambda r: (-r["score"], r["v"])), ("degree", lambda r: (len(near[r["v"]]), r["v"]))):
        got = structure.in_order(c, by, g).collect()
        for u in range(3):
            own = sorted((r for r in got if r["u"] == u), key=key)
            assert [r["place"] for r in own] == list(range(1, len(own) + 1))
    sim = lambda a, b: np.dot(x[a], x[b])
    first = 1 if sim(0, 1) >= sim(0, 2) else 2
    assert structure.query_tree(q, 0) == [(0, None), (first, 0), (3 - first, 0)]
    assert np.allclose(structure.similarity_sums(q), [sum(sim(a, b) for b in range(3) if b != a) for a in range(3)])
    pairs = lambda d: sorted(map(tuple, d.collect()))
    assert pairs(structure.support_by_roles(g, q, c)) == pairs(match.support(g, q, c))
    assert [r[:2] for r in pairs(structure.angle_candidates(g, q, 0.1, 1))] == [r[:2] for r in pairs(c)]


def test_ball_query(spark):
    g, _, near = small(spark, 40, 80)
    q = g.sample_ball_query(5, 7)
    assert q.sources == g.sample_ball_query(5, 7).sources and len(set(q.sources)) == 5
    assert q.edges == sorted((a, b) for a in range(5) for b in range(a + 1, 5) if q.sources[b] in near[q.sources[a]])
    ball = {q.sources[0]} | near[q.sources[0]] | {w for v in near[q.sources[0]] for w in near[v]}
    assert set(q.sources) <= ball
    with pytest.raises(ValueError):
        g.sample_ball_query(41)


def test_random_walk_against_rounds(spark):
    g, _, near = small(spark, 25, 30, seed=5)
    seeds = spark.createDataFrame([(0,), (3,), (24,)], "id long")
    got = {(r["seed"], r["id"]): r["mass"] for r in g.random_walk(seeds, 6).collect()}
    for s in (0, 3, 24):
        mass = {s: 1.0}
        for _ in range(6):
            new = defaultdict(float, {s: 0.15})
            for v, m in mass.items():
                for w in near[v]:
                    new[w] += 0.85 * m / len(near[v])
            total = sum(new.values())
            mass = {v: m / total for v, m in new.items()}
        assert all(math.isclose(got[s, v], m, rel_tol=1e-9) for v, m in mass.items()) and sum(k[0] == s for k in got) == len(mass)


def plain_hops(near, s, hops):
    dist, ring = {s: 0}, [s]
    for d in range(1, hops + 1):
        ring = [w for v in ring for w in near[v] if w not in dist and not dist.update({w: d})]
    return {v: d for v, d in dist.items() if v != s}


def test_walks_and_hops_from_packed_lists(spark, monkeypatch):
    """Ids far apart, starts without edges and more starts than walk together; only wanted ids are told."""
    from lodegraph.operators import packed

    monkeypatch.setattr(packed, "WIDE", 3)
    g, _, near = small(spark, 25, 40, seed=6)
    far = Graph(g.vertices, g.edges.selectExpr("src * 5000000000 - 7 AS src", "dst * 5000000000 - 7 AS dst"))
    name = lambda v: v * 5000000000 - 7
    starts = spark.createDataFrame([(name(v),) for v in (*range(25), 99)], "id long")
    every = {(r["seed"], r["id"]): r["mass"] for r in far.random_walk(starts, 4).collect()}
    assert every[name(99), name(99)] == 1.0 and all(math.isclose(sum(m for (s, _), m in every.items() if s == name(v)), 1) for v in range(25))
    only = [name(v) for v in (3, 5, 99)]
    assert {k: round(m, 12) for k, m in every.items() if k[1] in only} == {(r["seed"], r["id"]): round(r["mass"], 12) for r in far.random_walk(starts, 4, only=only).collect()}
    for hops in (1, 2, 3):
        want = {(name(v), name(w), d) for v in range(25) for w, d in plain_hops(near, v, hops).items()}
        assert set(map(tuple, far.within(hops, starts).collect())) == want == set(map(tuple, far.within(hops).collect()))
        ends = spark.createDataFrame([(name(v),) for v in (1, 2, 8)], "id long")
        assert sorted(map(tuple, far.within(hops, starts, ends).collect())) == sorted(w for w in want if w[1] in {name(v) for v in (1, 2, 8)})


def test_ranked_searches_keep_only_what_a_slot_may_take(spark, monkeypatch):
    g, x, near = small(spark, 16, 26, seed=11)
    q = g.query_of([0, 1, 2, 3], [(0, 1), (1, 2), (0, 2), (2, 3)])
    tables, seeds = [], []
    monkeypatch.setattr(ranked, "written", lambda d, w=ranked.written: tables.append(out := w(d)) or out)
    monkeypatch.setattr(Graph, "random_walk", lambda self, s, *a, f=Graph.random_walk, **b: seeds.append([r[0] for r in s.collect()]) or f(self, s, *a, **b))
    takes = {v for u in range(4) for v in range(16) if len(near[v]) >= len(q.neighbours[u]) and float(np.dot(q.vectors[u], x[v])) >= 0.4}
    for search in (ranked.loss_search, ranked.proximity_search):
        tables.clear()
        search(g, q, 0.4, beam=2).collect()
        hops = [t for t in tables if t.columns[:2] == ["src", "dst"] and len(t.columns) == 3]
        assert hops and {r["dst"] for t in hops for r in t.collect()} <= takes
    assert 0 < sum(map(len, seeds)) == len({v for s in seeds for v in s})  # a vertex walks once


@pytest.mark.parametrize("soft,miss", [(False, 0), (True, 1)])
def test_loss_search_against_plain_beam(spark, soft, miss):
    g, x, near = small(spark, 16, 24, seed=9)
    q = g.query_of([0, 1, 2, 3], [(0, 1), (1, 2), (0, 2), (2, 3)])
    tau, beam, local, topk = 0.1, 12, 5, 10
    qn = q.neighbours
    sim = [[float(np.dot(q.vectors[u], x[v])) for v in range(16)] for u in range(4)]
    pool = lambda u, less: [v for v in range(16) if len(near[v]) >= max(0, len(qn[u]) - less) and (soft or sim[u][v] >= match._float(tau) or sim[u][v] >= tau)]
    counts = [sum(len(near[v]) >= len(qn[u]) and sim[u][v] >= tau for v in range(16)) for u in range(4)]
    root = min(range(4), key=lambda u: (counts[u] / max(1, len(qn[u])), -len(qn[u]), u))
    order = q.order(root, lambda u: (-len(qn[u]), u))
    states = sorted(((2 * max(0, tau - sim[root][v]), -sim[root][v], v) for v in pool(root, 0)))[: max(20 * topk, 1000)]
    states = [(loss, 2 * sim[root][v], 0, 0, {root: v}) for loss, _, v in states]
    for u in order[1:]:
        new = []
        for loss, total, me0, in0, m in states:
            back = [w for w in m if w in qn[u]]
            there = [w for w in back if m[w] >= 0]
            hops = {w: plain_hops(near, m[w], 2) for w in there}
            reach = {v for h in hops.values() for v in h} if there else set(range(16))
            options = []
            for v in pool(u, miss):
                if v not in reach or v in m.values():
                    continue
                dist = [hops[w].get(v) for w in there]
                me, inter, nv = dist.count(None), sum(d - 1 for d in dist if d and d >= 2), dist.count(1)
                if me <= miss:
                    options.append((me + inter + 2 * max(0, tau - sim[u][v]), -(2 * sim[u][v] + 1.5 * nv / max(1, len(qn[u])) - me - 0.4 * inter), -sim[u][v], v, me, inter))
            for dl, dg, _, v, me, inter in sorted(options)[:local]:
                new.append((loss + dl, total - dg, me0 + me, in0 + inter, {**m, u: v}))
            if not options:
                new.append((loss + 5, total - 5, me0, in0, {**m, u: -1}))
        placed = list(new[0][4])
        states = sorted(new, key=lambda s: (round(s[0], 9), round(-s[1], 9), [s[4][w] for w in placed]))[:beam]
    want = [(round(s[0], 6), round(s[1], 6), [s[4][u] for u in range(4)]) for s in sorted(states, key=lambda s: (round(s[0], 9), round(-s[1], 9), [s[4][u] for u in range(4)]))[:topk]]
    got = ranked.loss_search(g, q, tau, topk=topk, beam=beam, local=local, soft=soft, miss_edges=miss).orderBy("rank").collect()
    assert [(round(r["loss"], 6), round(r["score"], 6), [r[f"q{u}"] for u in range(4)]) for r in got] == want


@pytest.mark.parametrize("hard", [True, False])
def test_proximity_search_against_plain_beam(spark, hard):
    g, x, near = small(spark, 16, 26, seed=11)
    q = g.query_of([0, 1, 2, 3], [(0, 1), (1, 2), (0, 2), (2, 3)])
    tau, beam, local, topk, seeds = 0.05, 9, 4, 8, 6
    qn = q.neighbours
    sim = [[float(np.dot(q.vectors[u], x[v])) for v in range(16)] for u in range(4)]
    pool = lambda u: [v for v in range(16) if len(near[v]) >= len(qn[u]) and (not hard or sim[u][v] >= tau)]
    walk = {}
    for s in range(16):
        mass = {s: 1.0}
        for _ in range(10):
            new = defaultdict(float, {s: 0.15})
            for v, m in mass.items():
                for w in near[v]:
                    new[w] += 0.85 * m / len(near[v])
            total = sum(new.values())
            mass = {v: m / total for v, m in new.items()}
        walk[s] = mass
    centre = min(range(4), key=lambda u: (-len(qn[u]), u))
    order = [centre]
    while len(order) < 4:
        touching = [u for u in range(4) if u not in order and any(w in order for w in qn[u])]
        order.append(max(touching, key=lambda u: (sum(w in order for w in qn[u]), len(qn[u]), sum(w not in order for w in qn[u]), -u)))
    first = sorted(pool(centre), key=lambda v: (-(sim[centre][v] + 1e-6 * math.log1p(len(near[v]))), -sim[centre][v], v))[:seeds]
    states = [(sim[centre][v], 0, sim[centre][v], {centre: v}) for v in first]
    for u in order[1:]:
        new = []
        for total, missing, sem, m in states:
            options = []
            for v in pool(u):
                if v in m.values():
                    continue
                back = [m[w] for w in m if w in qn[u]]
                dist = [plain_hops(near, b, 2).get(v) for b in back]
                prox = max(0.0, *[walk[b].get(v, 0.0) for b in back])
                edge = sum(1.0 if d == 1 else 1 / d if d else 0.0 for d in dist)
                options.append((-(sim[u][v] + prox + edge), sum(d != 1 for d in dist), -sim[u][v], -prox, v))
            for s, lost, _, _, v in sorted(options, key=lambda o: (round(o[0], 9), o[1], round(o[2], 9), round(o[3], 9), o[4]))[:local]:
                new.append((total - s, missing + lost, sem + sim[u][v], {**m, u: v}))
        placed = list(new[0][3])
        states = sorted(new, key=lambda s: (round(-s[0], 9), s[1], round(-s[2], 9), [s[3][w] for w in placed]))[:beam]
    exact = lambda m: all(m[b] in near[m[a]] for a, b in q.edges) and all(sim[u][m[u]] >= tau and len(near[m[u]]) >= len(qn[u]) for u in range(4))
    states.sort(key=lambda s: (not exact(s[3]), round(-s[0], 9), s[1], round(-s[2], 9), [s[3][u] for u in range(4)]))
    want = [(round(s[0], 6), s[1], exact(s[3]), [s[3][u] for u in range(4)]) for s in states[:topk]]
    got = ranked.proximity_search(g, q, tau, topk=topk, seeds=seeds, beam=beam, local=local, hard=hard).orderBy("rank").collect()
    assert [(round(r["total_score"], 6), r["missing_edges"], r["exact_valid"], [r[f"q{u}"] for u in range(4)]) for r in got] == want


def test_neighbourhood_cost_against_plain_beam(spark):
    g, x, near = small(spark, 14, 22, seed=13)
    q = g.query_of([0, 1, 2, 3], [(0, 1), (1, 2), (0, 2), (2, 3)])
    beam, topk, limit, lam, alpha = 10, 6, 5, 0.4, 0.5
    qd = q.distances(2)
    prox = [{w: alpha**d for w, d in qd[u].items() if w != u} for u in range(4)]
    beta = [1 / sum(p.values()) for p in prox]
    sim = [[float(np.dot(q.vectors[u], x[v])) for v in range(14)] for u in range(4)]
    cand = [sorted([v for v in range(14) if sim[u][v] >= 0.0] or range(14), key=lambda v: (1 - sim[u][v], v))[:limit] for u in range(4)]
    lc = [{v: max(0.0, 1 - sim[u][v]) for v in cand[u]} for u in range(4)]
    gp = lambda a, b: 1.0 if a == b else alpha ** plain_hops(near, a, 2)[b] if b in plain_hops(near, a, 2) else 0.0
    cost = [dict(c) for c in lc]
    for _ in range(4):
        cost = [{v: lam * lc[u][v] + sum(min((1 - lam) * beta[u] * max(0.0, p - gp(v, z)) + cost[w][z] for z in cand[w]) for w, p in prox[u].items()) for v in cand[u]} for u in range(4)]
    key = lambda u: (len(cand[u]), -len(q.neighbours[u]), u)
    order = q.order(min(range(4), key=key), key)
    take = max(topk, min(limit, 200))
    top = lambda u: sorted(cand[u], key=lambda v: (round(cost[u][v], 9), v))
    states = [(cost[order[0]][v], {order[0]: v}) for v in top(order[0])[:beam]]
    for u in order[1:]:
        new = []
        for c, m in states:
            for v in top(u)[:take]:
                if v not in m.values():
                    new.append((c + lam * lc[u][v] + sum((1 - lam) * beta[u] * max(0.0, prox[u][w] - gp(m[w], v)) for w in m if w in prox[u]), {**m, u: v}))
        placed = list(new[0][1])
        states = sorted(new, key=lambda s: (round(s[0], 9), [s[1][w] for w in placed]))[:beam]
    states = sorted(states, key=lambda s: (round(s[0], 9), [s[1][u] for u in range(4)]))[:topk]
    want = [(round(c, 6), round(sum(lc[u][m[u]] for u in range(4)), 6), round(sum(beta[u] * sum(max(0.0, p - gp(m[u], m[w])) for w, p in prox[u].items()) for u in range(4)), 6), [m[u] for u in range(4)]) for c, m in states]
    got = ranked.neighbourhood_cost(g, q, 0.1, topk=topk, candidate_limit=limit, beam=beam).orderBy("rank").collect()
    assert [(round(r["total_cost"], 6), round(r["label_cost"], 6), round(r["neighborhood_cost"], 6), [r[f"q{u}"] for u in range(4)]) for r in got] == want


def test_exports_first_ids(spark):
    q = Query([[1.0]] * 2, [(0, 1)])
    rows = [(1, k) for k in range(2, 90)] + [(k, 1) for k in range(2, 90)]
    found = spark.createDataFrame(rows, "q0 long, q1 long")
    at = {m: n for n, m in enumerate(sorted(rows), 1)}
    assert {(r["a"], r["b"]): (r["n"], r["match_ids"]) for r in export.edge_counts(found, q).collect()} == {(1, k): (2, sorted((at[1, k], at[k, 1]))) for k in range(2, 90)}
    got = {r["id"]: r["match_ids"] for r in export.node_support(found, 2, 5).collect()}
    assert got[1] == [1, 2, 3, 4, 5] and got[2] == sorted((at[1, 2], at[2, 1]))


def test_term_counts_leave_a_task_once():
    """A task's counts go out summed by term, also in several parts; before, each document's terms were dealt."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([["b", "a", "b"], ["a"], None])], ["w"])
    for most, rows in ((9, 4), (1, 5)):
        out = [r for b in ops._term_counts(iter([batch]), 2, most) for r in b.to_pylist()]
        assert len(out) == rows
        told = defaultdict(lambda: [0, 0])
        for r in out:
            told[r["term"]][0] += r["df"]
            told[r["term"]][1] += r["n"]
        assert dict(told) == {"b": [1, 2], "a": [2, 2], "b a": [1, 1], "a b": [1, 1]}


def test_weights_deal_nothing_by_document(spark):
    docs = spark.createDataFrame([(k, " ".join(["word"] * (k + 1) + ["other", "more"])) for k in range(4)], "doc_id int, text string")
    w = ops.tfidf(docs, max_df=1.0)
    assert "Exchange" not in w._jdf.queryExecution().executedPlan().toString() and w.schema["doc_id"].dataType.simpleString() == "int"
    got = {(r["doc_id"], r["term"]): (r["tf"], r["weight"]) for r in w.collect()}
    assert got[2, "word"][0] == 3 and got[2, "word word"][0] == 2 and all(math.isclose(sum(v[1] ** 2 for k, v in got.items() if k[0] == d), 1) for d in range(4))


def test_keywords_of_many_words(spark):
    from lodegraph.functions import text as txt

    many = " ".join(f"w{k:05d}" for k in range(30000)) + " zebra zebra w00007"  # counted word by word, 900 million comparisons
    one = spark.createDataFrame([(many,)], "text string").select(txt.query_text("text", "keywords", 3).alias("t"))
    assert one.first()["t"] == "paper about w00007, zebra, w00000"


def test_encoder_keeps_products(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "the", "and"]
    docs = spark.createDataFrame([(k, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for k in range(25)] + [(99, None)], "doc_id long, text string")
    x = {i["doc_id"]: np.array(i["x"]) for i in ops.encoded(docs, dims=64, grams=1, min_df=1, max_df=1.0).collect()}
    w = defaultdict(dict)
    for i in ops.tfidf(docs, grams=1, min_df=1, max_df=1.0, stop_words=["the", "and"]).collect():
        w[i["doc_id"]][i["term"]] = i["weight"]
    assert len(x) == 26 and not x[99].any() and all(t not in w[k] for k in w for t in ("the", "and"))
    for a in range(25):
        for b in range(25):
            assert abs(np.dot(x[a], x[b]) - sum(v * w[b].get(t, 0) for t, v in w[a].items())) < 1e-5
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 or not v.any() for v in x.values())


def test_shared_folder_is_named_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return self

        def get(self, _, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
