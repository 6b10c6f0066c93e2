"""Further queries over the test tables, and their SQL: structure, orders, files, papers, statistics and exports of matches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.vectors import shell
from ..operators import cases, export, match, ranked, structure
from ..operators import text as ops
from ..session import shared_dir, written
from ..sources import files
from .query import SHAPES, densities
from .registry import _BASE, _CAND, _QE, _STOP, _SUPPORT, _TFIDF, TAU, _cand, _cand_sql, _context_sql, _found, _match_sql, _query, _seeds, _WORDS, data_graph, data_vertices, read_table, shape_query

_NEED = "need AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 1)) t(u, need))"
_DOMAIN = f"{_BASE}, {_NEED}, dom AS (SELECT u, vx.id AS v FROM need, vx LEFT JOIN deg ON deg.id = vx.id WHERE coalesce(deg, 0) >= need)"


def _some_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query("structural_domain_sizes", f"WITH {_DOMAIN} SELECT u, count(*) AS n FROM dom GROUP BY u")
def _domain_sizes(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    return structure.domains(g, shape_query(g, "tailed")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))


def _refined_sql(rounds: int) -> str:
    near = lambda c, w: f"EXISTS (SELECT 1 FROM e JOIN c{w} k ON k.v = e.dst WHERE e.src = {c}.v)"
    out = f"WITH {_DOMAIN}, a2 AS (SELECT v FROM dom WHERE u = 2)"
    for u in (0, 1, 3):
        out += f", a{u} AS (SELECT v FROM dom WHERE u = {u} AND EXISTS (SELECT 1 FROM e JOIN a2 k ON k.v = e.dst WHERE e.src = dom.v))"
    last = {u: f"a{u}" for u in range(4)}
    for n in range(rounds):
        for u, others in ((3, ()), (1, (0,)), (0, (1,)), (2, (0, 1, 3))):
            tests = [f"EXISTS (SELECT 1 FROM e JOIN {last[w]} k ON k.v = e.dst WHERE e.src = x.v)" for w in others]
            out += f", r{n}_{u} AS (SELECT v FROM {last[u]} x{' WHERE ' if tests else ''}{' AND '.join(tests)})"
            last[u] = f"r{n}_{u}"
    return out + " " + " UNION ALL ".join(f"SELECT {u} AS u, v FROM {last[u]}" for u in range(4))


@_query("structure_refined", _refined_sql(5))
def _refined(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    return structure.refined(g, shape_query(g, "tailed"), 2)


@_query("query_similarity_sums", f"WITH {_BASE} SELECT CAST(a.id AS INTEGER) AS u, round(sum(list_dot_product(a.x, b.x)), 4) AS total FROM vx a JOIN vx b ON a.id <> b.id WHERE a.id < 4 AND b.id < 4 GROUP BY a.id")
def _similarity_sums(spark: SparkSession, d: str) -> DataFrame:
    sums = structure.similarity_sums(shape_query(data_vertices(spark, d), "tailed"))
    return spark.createDataFrame(list(enumerate(sums)), "u int, total double").withColumn("total", F.round("total", 4))


@_query("candidate_order_score", f"WITH {_BASE}, {_cand_sql(4)} SELECT u, v, CAST(row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS INTEGER) AS place FROM cand")
def _by_score(spark: SparkSession, d: str) -> DataFrame:
    return structure.in_order(_cand(spark, d, False)[2], "score").select("u", "v", "place")


@_query("candidate_order_degree", f"WITH {_BASE}, {_cand_sql(4)} SELECT u, v, CAST(row_number() OVER (PARTITION BY u ORDER BY coalesce(deg, 0), v) AS INTEGER) AS place FROM cand LEFT JOIN deg ON deg.id = v")
def _by_degree(spark: SparkSession, d: str) -> DataFrame:
    g, _, c = _cand(spark, d)
    return structure.in_order(c, "degree", g).select("u", "v", "place")


@_query("candidate_shells", f"WITH {_BASE}, {_cand_sql(4)} SELECT u, v, CAST(least(15, greatest(0, floor(acos(least(1, greatest(-1, score))) / acos({TAU}::DOUBLE) * 16))) AS INTEGER) AS by_angle, CAST(least(15, greatest(0, floor((1::DOUBLE - score) / (1 - {TAU}::DOUBLE) * 16))) AS INTEGER) AS by_score FROM cand")
def _shells(spark: SparkSession, d: str) -> DataFrame:
    return _cand(spark, d, False)[2].select("u", "v", shell(F.col("score"), TAU, True).alias("by_angle"), shell(F.col("score"), TAU).alias("by_score"))


@_query("angle_range_candidates", _CAND)
def _angles(spark: SparkSession, d: str) -> DataFrame:
    g = data_vertices(spark, d)
    return structure.angle_candidates(g, shape_query(g, "tailed"), TAU).withColumn("score", F.round("score", 4))


@_query("support_by_roles", f"WITH {_BASE}, {_cand_sql(4)}, {_QE}, {_SUPPORT} SELECT u, w, a, b FROM sup")
def _by_roles(spark: SparkSession, d: str) -> DataFrame:
    return structure.support_by_roles(*_cand(spark, d))


_CAP = 3


@_query("khop_context_capped", _context_sql(_CAP))
def _capped(spark: SparkSession, d: str) -> DataFrame:
    g, s = _seeds(spark, d)
    return g.context(s, 2, _CAP)


def _steps_sql(shape: str, tau: float) -> str:
    """As _match_sql, a query vertex at a time, for shapes of many edges."""
    edges = SHAPES[shape]
    k = max(max(e) for e in edges) + 1
    near = {u: [w for e in edges for w in e if u in e and w != u] for u in range(k)}
    order = [0]
    while len(order) < k:
        order.append(next(u for u in range(k) if u not in order and any(w in order for w in near[u])))
    out = f"WITH {_BASE}, {_cand_sql(k, tau)}, m0 AS MATERIALIZED (SELECT v AS q0 FROM cand WHERE u = 0)"
    for n, u in enumerate(order[1:], 1):
        placed = order[:n]
        back = [w for w in placed if w in near[u]]
        tests = [f"c.v <> p.q{w}" for w in placed] + [f"(p.q{w}, c.v) IN (SELECT (src, dst) FROM e)" for w in back[1:]]
        out += f", m{n} AS MATERIALIZED (SELECT p.*, c.v AS q{u} FROM m{n - 1} p JOIN e ON e.src = p.q{back[0]} JOIN cand c ON c.u = {u} AND c.v = e.dst WHERE {' AND '.join(tests)})"
    return f"{out}, m AS (SELECT {', '.join(f'q{u}' for u in range(k))} FROM m{k - 1})"


for _shape, _tau in (("star6", 0.3), ("path6", 0.3), ("tree6", 0.3), ("cycle6", 0.25), ("dense6", 0.2)):
    _query(f"match_{_shape}", f"{_steps_sql(_shape, _tau)} SELECT * FROM m")(lambda spark, d, s=_shape, t=_tau: _found(spark, d, s, tau=t)[2])
for _edges in densities(5, 4):
    if len(_edges) in (10, 7, 4):
        SHAPES[f"density{len(_edges)}"] = _edges
        _query(f"match_density{len(_edges)}", f"{_steps_sql(f'density{len(_edges)}', 0.2)} SELECT * FROM m")(lambda spark, d, s=f"density{len(_edges)}": _found(spark, d, s, tau=0.2)[2])
_query("match_default_threshold", f"WITH {_match_sql('path3', 0.9700000286102295)} SELECT * FROM m")(lambda spark, d: _found(spark, d, "path3", tau=0.97)[2])

_PATH = f"WITH {_match_sql('path3', scores=True)}"
_LOW = "least(s0, s1, s2)"
_NUMBERED = f"{_PATH}, num AS (SELECT *, row_number() OVER (ORDER BY q0, q1, q2) AS match_id FROM m)"
_TRUTH = "q0 = 0 AND q1 = 1 AND q2 = 2"


def _path(spark: SparkSession, d: str) -> tuple:
    return _found(spark, d, "path3", scores=True)


@_query("mapping_keys", f"{_PATH} SELECT q0 || ',' || q1 || ',' || q2 AS key FROM m")
def _keys(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d)[2].select(match.mapping_key(3).alias("key"))


@_query("match_preview", f"{_NUMBERED} SELECT match_id, q0, q1, q2 FROM num WHERE match_id <= 20")
def _preview(spark: SparkSession, d: str) -> DataFrame:
    return match.numbered(_path(spark, d)[2].select("q0", "q1", "q2"), ["q0", "q1", "q2"]).where("match_id <= 20")


@_query("match_statistics", f"{_NUMBERED} SELECT count(*) AS n, count(*) FILTER ({_TRUTH}) AS truth_count, min(match_id) FILTER ({_TRUTH}) AS truth_first_id FROM num")
def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return match.truth_statistics(_path(spark, d)[2], 3, [0, 1, 2])


@_query("match_representatives", f"{_PATH}, r AS (SELECT *, row_number() OVER (ORDER BY {_LOW} DESC, s0 + s1 + s2 DESC, q0, q1, q2) AS k, {_TRUTH} AS truth FROM m), a AS (SELECT * FROM r ORDER BY truth DESC, k LIMIT 1), b AS (SELECT r.* FROM r, a WHERE NOT list_has_any([r.q0, r.q1, r.q2], [a.q0, a.q1, a.q2]) ORDER BY r.k LIMIT 1) SELECT a.q0 || ',' || a.q1 || ',' || a.q2 AS a, b.q0 || ',' || b.q1 || ',' || b.q2 AS b FROM a LEFT JOIN b ON true")
def _representatives(spark: SparkSession, d: str) -> DataFrame:
    a, b = match.representatives(written(_path(spark, d)[2]), 3, [0, 1, 2])
    shown = [",".join(map(str, x)) if x else None for x in (a, b)]
    return spark.createDataFrame([tuple(shown)] if a else [], "a string, b string")


_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


def _cut(s: str, n: int) -> str:
    return f"CASE WHEN length({s}) > {n} THEN rtrim(substr({s}, 1, {n - 3})) || '...' ELSE {s} END"


def _papers(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), txt.truncated("text", 90).alias("title"), txt.clean("text").alias("text"), F.col("lang").alias("label"), F.col("source").alias("year"))


_ROW = ", ".join(f"num.q{u} AS q{u + 1}_node_id, round(s{u}, 4) AS q{u + 1}_similarity, p{u}.label AS q{u + 1}_label, p{u}.year AS q{u + 1}_year, p{u}.title AS q{u + 1}_title" for u in range(3))
_NAMED = " ".join(f"LEFT JOIN p p{u} ON p{u}.id = num.q{u}" for u in range(3))


@_query("match_rows", f"{_NUMBERED}, p AS (SELECT doc_id AS id, lang AS label, source AS year, {_cut(_CLEAN, 90)} AS title FROM documents) SELECT match_id, round({_LOW}, 4) AS min_similarity, round(s0 + s1 + s2, 4) AS sum_similarity, {_TRUTH} AS is_ground_truth, {_ROW} FROM num {_NAMED}")
def _rows(spark: SparkSession, d: str) -> DataFrame:
    out = files.match_rows(_path(spark, d)[2], 3, _papers(spark, d).drop("text"), [0, 1, 2])
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("similarity")})


@_query("match_files", f"{_NUMBERED} SELECT CAST(match_id AS VARCHAR) AS match_id, 'q' || role AS qid, CAST(node AS VARCHAR) AS node FROM (SELECT match_id, 1 AS role, q0 AS node FROM num UNION ALL SELECT match_id, 2, q1 FROM num UNION ALL SELECT match_id, 3, q2 FROM num) t")
def _match_files(spark: SparkSession, d: str) -> DataFrame:
    path = _some_path(spark, "matches")
    files.write_all_matches(_path(spark, d)[2], 3, path, path + "-lines", truth=[0, 1, 2])
    return files.read_match_nodes(spark, path)


@_query("match_lines", f"{_PATH} SELECT q0 || ' ' || q1 || ' ' || q2 AS value FROM m")
def _match_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _some_path(spark, "lines")
    files.write_matches(_path(spark, d)[2], 3, path)
    return spark.read.text(path)


@_query("csv_graph_edges", f"WITH {_BASE} SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM und")
def _csv_edges(spark: SparkSession, d: str) -> DataFrame:
    return _csv_graph(spark, d).edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@_query("csv_graph_vertices", f"WITH {_BASE} SELECT CAST(id AS INTEGER) AS id, round(list_sum(x), 4) AS total FROM vx")
def _csv_vertices(spark: SparkSession, d: str) -> DataFrame:
    v = _csv_graph(spark, d).vertices
    return v.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double")), 4).alias("total"))


def _csv_graph(spark: SparkSession, d: str):  # noqa: ANN202
    path = _some_path(spark, "graph")
    files.write_graph(data_graph(spark, d), path + "-v", path + "-e")
    return files.read_graph(spark, path + "-v", path + "-e", normalize=False)


@_query("paper_selection", "SELECT doc_id AS node, lang AS label FROM documents WHERE (SELECT count(*) FROM documents) <= 200 OR lang IN ('en', 'de') ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def _selection(spark: SparkSession, d: str) -> DataFrame:
    return files.selected(read_table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("lang").alias("label")), 200, ["en", "de"])


_PAPERS = rf"""{_BASE}, pap AS (SELECT vx.id AS node, vx.id % 7 AS label, CAST(vx.id AS VARCHAR) AS id, coalesce(lang, '') AS title,
  coalesce(trim(regexp_replace(concat_ws('. ', lang, text), '\s+', ' ', 'g')), '') AS text
  FROM vx LEFT JOIN documents ON doc_id = vx.id AND doc_id % 3 <> 0 WHERE vx.id % 2 = 0),
enough AS (SELECT *, row_number() OVER (ORDER BY node, id) - 1 AS idx FROM pap WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 50)"""


def _paper_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = data_graph(spark, d)
    ids = g.vertices.select(F.col("id").alias("node"))
    nodes = ids.withColumn("label", F.col("node") % 7)
    texts = read_table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("title"), F.col("text").alias("abstract"))
    held = files.looked_up(nodes, ids.where("node % 2 = 0").withColumn("paper_id", F.col("node")), texts)
    return files.paper_graph(held, g.edges.where("src < dst"), 50)


@_query("paper_lookups", f"WITH {_PAPERS} SELECT node, label, id, title, length(text) AS n, idx FROM enough")
def _lookups(spark: SparkSession, d: str) -> DataFrame:
    return _paper_graph(spark, d)[0].select("node", "label", "id", "title", F.length("text").cast("long").alias("n"), "idx")


@_query("paper_edges", f"WITH {_PAPERS} SELECT s.idx AS src, t.idx AS dst FROM und JOIN enough s ON s.node = und.a JOIN enough t ON t.node = und.b")
def _paper_edges(spark: SparkSession, d: str) -> DataFrame:
    return _paper_graph(spark, d)[1]


@_query("text_truncated", f"SELECT doc_id, {_cut(_CLEAN, 260)} AS text FROM documents")
def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", txt.truncated("text").alias("text"))


@_query("query_texts", f"WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) t GROUP BY doc_id, word), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM w), t AS (SELECT doc_id, string_agg(word, ', ' ORDER BY k) AS words FROM r WHERE k <= 10 GROUP BY doc_id) SELECT d.doc_id, CASE WHEN words IS NOT NULL THEN 'paper about ' || words ELSE {_cut(_CLEAN, 200)} END AS text FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.doc_id % 20 = 0")
def _query_texts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("doc_id % 20 = 0").select("doc_id", txt.query_text("text", "keywords").alias("text"))


_EDGES = f"{_NUMBERED}, ue AS (SELECT match_id, least(q0, q1) AS a, greatest(q0, q1) AS b FROM num UNION ALL SELECT match_id, least(q1, q2), greatest(q1, q2) FROM num), ur AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY match_id) AS k FROM ue)"


@_query("export_edge_support", f"{_EDGES} SELECT a, b, count(*) AS n, string_agg(match_id, ';' ORDER BY match_id) FILTER (k <= 50) AS ids FROM ur GROUP BY a, b")
def _edge_support(spark: SparkSession, d: str) -> DataFrame:
    _, q, found = _path(spark, d)
    return export.edge_counts(found, q).select("a", "b", "n", F.array_join("match_ids", ";").alias("ids"))


@_query("export_node_support", f"{_NUMBERED}, un AS (SELECT match_id, unnest([q0, q1, q2]) AS id FROM num), ur AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY match_id) AS k FROM un) SELECT id, string_agg(match_id, ';' ORDER BY match_id) AS ids FROM ur WHERE k <= 50 GROUP BY id")
def _node_support(spark: SparkSession, d: str) -> DataFrame:
    return export.node_support(_path(spark, d)[2], 3).select("id", F.array_join("match_ids", ";").alias("ids"))


_MARKS = {"A": [0, 1, 2], "B": [3, 1, 4]}


@_query("export_highlights", f"{_PATH}, mv AS (SELECT DISTINCT unnest([q0, q1, q2]) AS id FROM m), sel AS (SELECT id FROM mv UNION SELECT e.dst FROM e JOIN mv ON mv.id = e.src) SELECT id, concat_ws(';', CASE WHEN id IN (0, 1, 2) THEN 'A' END, CASE WHEN id IN (3, 1, 4) THEN 'B' END) AS highlight, CASE WHEN id IN (0, 1, 2, 3, 4) THEN 'highlight_match_vertex' WHEN id IN (SELECT id FROM mv) THEN 'matched_vertex' ELSE 'context_vertex' END AS node_kind FROM sel")
def _highlights(spark: SparkSession, d: str) -> DataFrame:
    g, q, found = _path(spark, d)
    return export.neighbourhood(g, found, q, highlight=_MARKS)[0].select("id", "highlight", "node_kind")


_SCORES = "s AS (SELECT vx.id AS v, list_dot_product(q.x, vx.x) AS score, coalesce(deg, 0) AS deg FROM vx q, vx LEFT JOIN deg ON deg.id = vx.id WHERE q.id = 2)"


@_query("loss_pool", f"WITH {_BASE}, {_SCORES} SELECT v, round(score, 4) AS score FROM s WHERE deg >= 2 AND score >= {TAU}")
def _loss_pool(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    q = shape_query(g, "tailed")
    return ranked.loss_pool(ranked._scores(g, q), q, 2, TAU, 1).withColumn("score", F.round("score", 4))


@_query("proximity_pool", f"WITH {_BASE}, {_SCORES} SELECT v, round(score, 4) AS score FROM s WHERE deg >= 3")
def _proximity_pool(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    q = shape_query(g, "tailed")
    return ranked.proximity_pool(ranked._scores(g, q), q, 2, TAU, False).select("v", F.round("score", 4).alias("score"))


_TRIPLES = f"{_BASE}, {_cand_sql(3, 0.2)}, k AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS n FROM cand), t AS (SELECT a.v AS q0, b.v AS q1, c.v AS q2 FROM k a JOIN k b ON b.n = a.n AND b.u = 1 JOIN k c ON c.n = a.n AND c.u = 2 WHERE a.u = 0)"
_OK = " AND ".join(f"EXISTS (SELECT 1 FROM vx q, vx x LEFT JOIN deg ON deg.id = x.id WHERE q.id = {u} AND x.id = t.q{u} AND list_dot_product(q.x, x.x) >= {TAU} AND coalesce(deg, 0) >= {1 + (u == 1)})" for u in range(3))
_JOINED = " AND ".join(f"EXISTS (SELECT 1 FROM e WHERE e.src = t.q{a} AND e.dst = t.q{b})" for a, b in ((0, 1), (1, 2)))


@_query("exact_flags", f"WITH {_TRIPLES}, f AS (SELECT *, q0 <> q1 AND q1 <> q2 AND q0 <> q2 AS injective_valid, {_JOINED} AS edge_valid, {_OK} AS ok FROM t) SELECT q0, q1, q2, injective_valid, edge_valid, injective_valid AND edge_valid AND ok AS exact_valid FROM f")
def _flags(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    q = shape_query(g, "path3")
    k = structure.in_order(match.candidates(g, q, 0.2, single_tau=False), "score")
    rows = None
    for u in range(3):
        own = k.where(F.col("u") == u).select("place", F.col("v").alias(f"q{u}"))
        rows = own if rows is None else rows.join(own, "place")
    out = ranked.exact_flags(written(rows.drop("place")), g, q, TAU, True)
    return out.select("q0", "q1", "q2", "injective_valid", "edge_valid", "exact_valid")


@_query("case_run", f"{_PATH}, d AS (SELECT {_LOW} AS low, s0 + s1 + s2 AS total FROM m WHERE NOT list_has_any([q0, q1, q2], [0, 1, 2]) ORDER BY low DESC, total DESC LIMIT 1) SELECT 2::BIGINT AS edge_count, (SELECT count(*) FROM m) AS match_count, (SELECT count(*) > 0 FROM m WHERE {_TRUTH}) AS ground_truth_recovered, (SELECT count(*) > 0 FROM d) AS disjoint_found, (SELECT round(low, 4) FROM d) AS disjoint_min_similarity, (SELECT round(total, 4) FROM d) AS disjoint_sum_similarity")
def _case_run(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    r = cases.run_query(g, shape_query(g, "path3"), TAU).record
    names = ("edge_count", "match_count", "ground_truth_recovered", "disjoint_found", "disjoint_min_similarity", "disjoint_sum_similarity")
    out = spark.createDataFrame([tuple(r[n] for n in names)], "edge_count long, match_count long, ground_truth_recovered boolean, disjoint_found boolean, disjoint_min_similarity double, disjoint_sum_similarity double")
    return out.withColumns({n: F.round(n, 4) for n in names[4:]})


@_query("case_search")
def _case_search(spark: SparkSession, d: str) -> DataFrame:
    _, log = cases.search(data_graph(spark, d), 4, cases.Bounds((3, 6)), TAU, attempts=20)
    return spark.createDataFrame([(r["attempt"], ",".join(r["source_node_ids"]), r["edge_count"], r["match_count"], r["ground_truth_recovered"], r["disjoint_found"]) for r in log], "attempt int, sources string, edge_count int, match_count long, ground_truth_recovered boolean, disjoint_found boolean")


@_query("sampled_query")
def _sampled(spark: SparkSession, d: str) -> DataFrame:
    q = data_graph(spark, d).sample_ball_query(5)
    return spark.createDataFrame([(u, s, len(n)) for u, (s, n) in enumerate(zip(q.sources, q.neighbours, strict=True))], "u int, source long, degree int")


_WITHOUT = _TFIDF.replace("regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w", f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_STOP}], w)) AS w")


@_query("tfidf_without_stop_words", _WITHOUT)
def _without(spark: SparkSession, d: str) -> DataFrame:
    return ops.tfidf(read_table(spark, d, "documents"), stop_words=txt.STOP_WORDS).withColumn("weight", F.round("weight", 4))
