"""Queries over the test tables, and their SQL.

The data graph: a vertex for each embedding; parts of consecutive lines of an
order, by part number modulo the number of vertices, are joined by an edge. The
query graph of k vertices has the vectors of vertices 0 to k - 1 and the edges
of a named shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.vectors import norm, normalized
from ..operators import export, match, ranked
from ..operators import text as ops
from ..operators.graph import Graph, undirected
from ..session import written
from .query import SHAPES, Query

Build = Callable[[SparkSession, str], DataFrame]
TAU = 0.25
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}

_BASE = """n AS (SELECT count(*) AS n FROM embeddings),
und AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM (
  SELECT x.l_partkey % n.n AS s, y.l_partkey % n.n AS t FROM n, lineitem x JOIN lineitem y
  ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) p WHERE s <> t),
e AS (SELECT a AS src, b AS dst FROM und UNION ALL SELECT b, a FROM und),
deg AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY src),
vx AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data_vertices(spark: SparkSession, sf_dir: str) -> Graph:
    """The vertices alone, for what reads no edges."""
    return Graph(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), None)


def data_graph(spark: SparkSession, sf_dir: str) -> Graph:
    v = data_vertices(spark, sf_dir).vertices
    n = v.count()
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % n).alias("p")).distinct()
    nxt = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p").alias("dst"))
    pairs = line.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("p").alias("src"), "dst")
    return Graph(v, written(undirected(pairs)))  # every operator reads the edges several times


def shape_query(graph: Graph, shape: str) -> Query:
    edges = SHAPES[shape]
    return graph.query_of(list(range(max(max(e) for e in edges) + 1)), edges)


def _cand_sql(k: int, tau: float = TAU) -> str:
    return f"""cand AS (SELECT CAST(q.id AS INTEGER) AS u, d.id AS v, list_dot_product(q.x, d.x) AS score
  FROM vx q, vx d WHERE q.id < {k} AND list_dot_product(q.x, d.x) >= {tau})"""


def _match_sql(shape: str, tau: float = TAU, scores: bool = False) -> str:
    edges = SHAPES[shape]
    k = max(max(e) for e in edges) + 1
    parts = [f"c{u}.v AS q{u}" for u in range(k)] + ([f"c{u}.score AS s{u}" for u in range(k)] if scores else [])
    tables = [f"cand c{u}" for u in range(k)] + [f"e e{n}" for n in range(len(edges))]
    tests = [f"c{u}.u = {u}" for u in range(k)] + [f"e{n}.src = c{a}.v AND e{n}.dst = c{b}.v" for n, (a, b) in enumerate(edges)]
    tests += [f"c{a}.v <> c{b}.v" for a in range(k) for b in range(a + 1, k)]
    return f"{_BASE}, {_cand_sql(k, tau)}, m AS (SELECT {', '.join(parts)} FROM {', '.join(tables)} WHERE {' AND '.join(tests)})"


def _query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(f: Build) -> Build:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_query("graph_edges", f"WITH {_BASE} SELECT a, b FROM und")
def _graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return data_graph(spark, d).edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@_query("graph_degrees", f"WITH {_BASE} SELECT id, deg FROM deg")
def _graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return data_graph(spark, d).degrees()


@_query("vertex_norms", f"WITH {_BASE} SELECT id, round(sqrt(list_dot_product(x, x)), 5) AS norm, sqrt(list_dot_product(x, x)) > 1e-12 AS nonzero FROM vx")
def _vertex_norms(spark: SparkSession, d: str) -> DataFrame:
    return data_vertices(spark, d).vertices.select("id", F.round(norm("x"), 5).alias("norm"), (norm("x") > 1e-12).alias("nonzero"))


@_query("normalized_vectors", f"WITH {_BASE} SELECT id, round(list_sum(list_transform(x, lambda z: z / sqrt(list_dot_product(x, x)))), 4) AS total FROM vx")
def _normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = data_vertices(spark, d).vertices.select("id", normalized("x").alias("x"))
    return v.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double")), 4).alias("total"))


_CAND = f"WITH {_BASE}, {_cand_sql(4)} SELECT u, v, round(score, 4) AS score FROM cand"


def _cand(spark: SparkSession, d: str, edges: bool = True, **options: object) -> tuple[Graph, Query, DataFrame]:
    g = (data_graph if edges else data_vertices)(spark, d)
    q = shape_query(g, "tailed")
    return g, q, match.candidates(g, q, TAU, **options)


def _rounded(c: DataFrame) -> DataFrame:
    return c.select("u", "v", F.round("score", 4).alias("score"))


for _name, _options in (("semantic_candidates", {}), ("landmark_filter", {"landmarks": True}), ("block_bound_filter", {"blocks": 8})):
    _query(_name, _CAND)(lambda spark, d, o=_options: _rounded(_cand(spark, d, False, **o)[2]))


@_query("degree_filter", f"WITH {_BASE}, {_cand_sql(4)} SELECT u, v, round(score, 4) AS score FROM cand JOIN deg ON deg.id = v WHERE deg >= CASE u WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END")
def _degree_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_cand(spark, d, degree_filter=True)[2])


@_query("candidate_counts", f"WITH {_BASE}, {_cand_sql(4)} SELECT u, count(*) AS n, round(avg(deg), 4) AS mean_degree FROM cand LEFT JOIN deg ON deg.id = v GROUP BY u")
def _candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    g, _, c = _cand(spark, d)
    return c.join(g.degrees(), F.col("v") == F.col("id"), "left").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("deg"), 4).alias("mean_degree"))


@_query("role_masks", f"WITH {_BASE}, {_cand_sql(4)} SELECT v, bit_or(CAST(1 AS BIGINT) << u) AS mask FROM cand GROUP BY v")
def _role_masks(spark: SparkSession, d: str) -> DataFrame:
    return match.roles(_cand(spark, d, False)[2])


_QE = "qe AS (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0), (2, 3), (3, 2)) t(u, w))"
_SUPPORT = "sup AS (SELECT qe.u, qe.w, e.src AS a, e.dst AS b FROM qe JOIN cand c ON c.u = qe.u JOIN e ON e.src = c.v JOIN cand k ON k.u = qe.w AND k.v = e.dst)"


@_query("support_edges", f"WITH {_BASE}, {_cand_sql(4)}, {_QE}, {_SUPPORT} SELECT u, w, a, b FROM sup")
def _support_edges(spark: SparkSession, d: str) -> DataFrame:
    return match.support(*_cand(spark, d))


@_query("support_counts", f"WITH {_BASE}, {_cand_sql(4)}, {_QE}, {_SUPPORT} SELECT u, w, a, count(*) AS n FROM sup GROUP BY u, w, a")
def _support_counts(spark: SparkSession, d: str) -> DataFrame:
    return match.support(*_cand(spark, d)).groupBy("u", "w", "a").agg(F.count(F.lit(1)).alias("n"))


def _arc_sql(rounds: int) -> str:
    out, last = f"WITH {_BASE}, {_cand_sql(4)}, {_QE}", "cand"
    for n in range(rounds):
        out += f", s{n} AS (SELECT qe.u, c.v FROM qe JOIN {last} c ON c.u = qe.u JOIN e ON e.src = c.v JOIN {last} k ON k.u = qe.w AND k.v = e.dst GROUP BY qe.u, c.v HAVING count(DISTINCT qe.w) = (SELECT count(*) FROM qe x WHERE x.u = qe.u)), c{n} AS (SELECT c.* FROM {last} c JOIN s{n} s ON s.u = c.u AND s.v = c.v)"
        last = f"c{n}"
    return f"{out} SELECT u, v FROM {last}"


@_query("arc_consistent_candidates", _arc_sql(6))
def _arc(spark: SparkSession, d: str) -> DataFrame:
    return match.arc_consistent(*_cand(spark, d)).select("u", "v")


def _found(spark: SparkSession, d: str, shape: str, tau: float = TAU, **options: object) -> tuple[Graph, Query, DataFrame]:
    g = data_graph(spark, d)
    q = shape_query(g, shape)
    return g, q, match.match(g, q, tau, **options)


for _shape in ("path3", "triangle", "path4", "star4", "cycle4", "tree5", "tailed"):
    _query(f"match_{_shape}", f"WITH {_match_sql(_shape)} SELECT * FROM m")(lambda spark, d, s=_shape: _found(spark, d, s)[2])
_query("match_late_filter", f"WITH {_match_sql('triangle')} SELECT * FROM m")(lambda spark, d: _found(spark, d, "triangle", strategy="late")[2])
_query("match_all_pruning", f"WITH {_match_sql('tailed')} SELECT * FROM m")(lambda spark, d: _found(spark, d, "tailed", arc_rounds=2, degree_filter=True, landmarks=True, blocks=8)[2])
_query("match_first", f"WITH {_match_sql('star4')} SELECT * FROM m ORDER BY q0, q1, q2, q3 LIMIT 100")(lambda spark, d: _found(spark, d, "star4", max_matches=100)[2])
_query("match_count", f"WITH {_match_sql('path4')} SELECT count(*) AS n FROM m")(lambda spark, d: _found(spark, d, "path4")[2].agg(F.count(F.lit(1)).alias("n")))

_LOW = "least(s0, s1, s2)"
_TOP = f"SELECT q0, q1, q2, round({_LOW}, 4) AS min_sim, round(s0 + s1 + s2, 4) AS sum_sim, q0 = 0 AND q1 = 1 AND q2 = 2 AS is_truth FROM m"


def _shown(r: DataFrame) -> DataFrame:
    return r.withColumns({c: F.round(c, 4) for c in ("min_sim", "sum_sim")})


@_query("match_topk", f"WITH {_match_sql('path3', scores=True)} {_TOP} ORDER BY {_LOW} DESC, s0 + s1 + s2 DESC, q0, q1, q2 LIMIT 20")
def _topk(spark: SparkSession, d: str) -> DataFrame:
    g, q, found = _found(spark, d, "path3", scores=True)
    return _shown(match.ranked(found, 3, 20, [0, 1, 2]))


@_query("match_best_disjoint", f"WITH {_match_sql('path3', scores=True)} {_TOP} WHERE q0 NOT IN (0, 1, 2) AND q1 NOT IN (0, 1, 2) AND q2 NOT IN (0, 1, 2) ORDER BY {_LOW} DESC, s0 + s1 + s2 DESC, q0, q1, q2 LIMIT 1")
def _best_disjoint(spark: SparkSession, d: str) -> DataFrame:
    g, q, found = _found(spark, d, "path3", scores=True)
    return _shown(match.ranked(match.disjoint(found, 3, [0, 1, 2]), 3, 1, [0, 1, 2]))


@_query("vector_range_single_vertex", f"WITH {_BASE}, {_cand_sql(1)} SELECT v AS q0 FROM cand")
def _single(spark: SparkSession, d: str) -> DataFrame:
    g = data_vertices(spark, d)
    return match.candidates(g, g.query_of([0], []), TAU).select(F.col("v").alias("q0"))


_SEEDS = f"WITH {_BASE}, {_cand_sql(1)}, seed AS (SELECT v AS id FROM cand)"
_NEAR = f"{_SEEDS}, h1 AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM seed)), h2 AS (SELECT DISTINCT h1.src, e.dst FROM h1 JOIN e ON e.src = h1.dst WHERE e.dst <> h1.src AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.src = h1.src AND o.dst = e.dst)), near AS (SELECT src, dst, 1 AS dist FROM h1 UNION ALL SELECT src, dst, 2 FROM h2)"


def _seeds(spark: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = data_graph(spark, d)
    return g, match.candidates(g, g.query_of([0], []), TAU).select(F.col("v").alias("id"))


@_query("khop_distance", f"{_NEAR} SELECT src, dst, dist FROM near")
def _khop(spark: SparkSession, d: str) -> DataFrame:
    g, s = _seeds(spark, d)
    return g.within(2, s)


@_query("linker_scores", f"{_NEAR} SELECT src, dst, 1.0::DOUBLE / dist AS linker, power(0.5::DOUBLE, dist) AS proximity FROM near")
def _linker(spark: SparkSession, d: str) -> DataFrame:
    g, s = _seeds(spark, d)
    return g.within(2, s).select("src", "dst", (F.lit(1.0) / F.col("dist")).alias("linker"), F.pow(F.lit(0.5), "dist").alias("proximity"))


@_query("induced_subgraph", f"{_SEEDS} SELECT src, dst FROM e WHERE src IN (SELECT id FROM seed) AND dst IN (SELECT id FROM seed)")
def _induced(spark: SparkSession, d: str) -> DataFrame:
    g, s = _seeds(spark, d)
    return g.induced(s)


@_query("khop_context", f"{_SEEDS}, r1 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed)) SELECT id, 0 AS hop FROM seed UNION ALL SELECT id, 1 FROM r1")
def _context(spark: SparkSession, d: str) -> DataFrame:
    g, s = _seeds(spark, d)
    return g.context(s, 1)


def _context_sql(cap: int) -> str:
    """Two hops of context, of each vertex no more than its first neighbours."""
    near = f"few AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e) t WHERE n <= {cap})"
    first = "r1 AS (SELECT DISTINCT dst AS id FROM few WHERE src IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed))"
    second = "r2 AS (SELECT DISTINCT dst AS id FROM few WHERE src IN (SELECT id FROM r1) AND dst NOT IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM r1))"
    return f"{_SEEDS}, {near}, {first}, {second} SELECT id, 0 AS hop FROM seed UNION ALL SELECT id, 1 FROM r1 UNION ALL SELECT id, 2 FROM r2"


def _walk_sql(rounds: int) -> str:
    out = f"{_SEEDS}, w0 AS (SELECT id AS seed, id, 1.0::DOUBLE AS mass FROM seed)"
    for n in range(rounds):
        out += f", t{n} AS (SELECT seed, id, sum(mass) AS mass FROM (SELECT w.seed, e.dst AS id, 0.85 * w.mass / deg.deg AS mass FROM w{n} w JOIN e ON e.src = w.id JOIN deg ON deg.id = w.id UNION ALL SELECT id, id, 1.0 - 0.85 FROM seed) x GROUP BY seed, id), w{n + 1} AS (SELECT seed, id, mass / sum(mass) OVER (PARTITION BY seed) AS mass FROM t{n})"
    return f"{out} SELECT seed, id, round(mass, 6) AS mass FROM w{rounds}"


@_query("rwr_scores", _walk_sql(10))
def _walk(spark: SparkSession, d: str) -> DataFrame:
    g, s = _seeds(spark, d)
    return g.random_walk(s).withColumn("mass", F.round("mass", 6))


@_query("cost_candidates", f"WITH {_BASE}, s AS (SELECT CAST(q.id AS INTEGER) AS u, d.id AS v, list_dot_product(q.x, d.x) AS score FROM vx q, vx d WHERE q.id < 4), k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY 1 - score, v) AS n FROM s WHERE score >= 0.2) SELECT u, v, round(greatest(0, 1 - score), 4) AS lc FROM k WHERE n <= 50")
def _cost_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    c = ranked.cost_candidates(ranked._scores(g, shape_query(g, "tailed")), 0.2, 50)
    return c.withColumn("lc", F.round("lc", 4))


@_query("rank_neighbourhood_cost")
def _neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    return ranked.neighbourhood_cost(g, shape_query(g, "tailed"), TAU)


@_query("rank_loss_search")
def _loss(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    return ranked.loss_search(g, shape_query(g, "tailed"), TAU)


@_query("rank_proximity_search")
def _proximity(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    return ranked.proximity_search(g, shape_query(g, "tailed"), TAU)


@_query("query_cohesion", f"WITH {_BASE}, s AS (SELECT * FROM vx WHERE id < 5), c AS (SELECT list(m ORDER BY k) AS c FROM (SELECT k, avg(z) AS m FROM (SELECT unnest(x) AS z, unnest(range(len(x))) AS k FROM s) y GROUP BY k) t) SELECT (SELECT round(avg(list_dot_product(a.x, b.x)), 4) FROM s a JOIN s b ON a.id < b.id) AS pair_avg, (SELECT round(min(list_dot_product(s.x, c.c) / sqrt(list_dot_product(c.c, c.c))), 4) FROM s, c) AS centroid_min")
def _cohesion(spark: SparkSession, d: str) -> DataFrame:
    return ops.cohesion(data_vertices(spark, d).vertices, list(range(5))).select(F.round("pair_avg", 4).alias("pair_avg"), F.round("centroid_min", 4).alias("centroid_min"))


_STOP = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)
_WORDS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}'), lambda w: length(w) >= 4 AND NOT list_contains([{_STOP}], w))"


@_query("clean_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _clean(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", txt.clean("text").alias("text"))


@_query("keyword_counts", f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) t GROUP BY word")
def _keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.keyword_counts(read_table(spark, d, "documents"))


@_query("keyword_topk", f"WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) t GROUP BY doc_id, word), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM w) SELECT d.doc_id, coalesce(string_agg(word, ', ' ORDER BY k), '') AS keywords FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k <= 10 GROUP BY d.doc_id")
def _keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    docs = read_table(spark, d, "documents")
    w = docs.select("doc_id", F.explode(txt.keyword_list(txt.clean("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    top = w.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).where("k <= 10")
    told = top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda s: s["word"]), ", ").alias("keywords"))
    return docs.select("doc_id").join(told, "doc_id", "left").select("doc_id", F.coalesce("keywords", F.lit("")).alias("keywords"))


@_query("query_sentences", r"SELECT doc_id, substr(split_part(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1), 1), 1, 400) AS sentence FROM documents")
def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", txt.query_text("text", "sentence").alias("sentence"))


_TFIDF = r"""WITH b AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM b UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df, sum(tf) AS a FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM documents) ORDER BY a DESC, term LIMIT 80000),
r AS (SELECT doc_id, tf.term, tf, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.term = tf.term)
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 4) AS weight FROM r"""


@_query("tfidf_weights", _TFIDF)
def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    return ops.tfidf(read_table(spark, d, "documents")).withColumn("weight", F.round("weight", 4))


_ROLES = f"WITH {_match_sql('path3')}, r AS (SELECT id, role, count(*) AS n FROM (SELECT q0 AS id, 1 AS role FROM m UNION ALL SELECT q1, 2 FROM m UNION ALL SELECT q2, 3 FROM m) t GROUP BY id, role)"


@_query("export_node_roles", f"{_ROLES} SELECT id, CAST(sum(n) AS BIGINT) AS match_count, string_agg('q' || role || ':' || n, ';' ORDER BY n DESC, role) AS roles FROM r GROUP BY id")
def _node_roles(spark: SparkSession, d: str) -> DataFrame:
    return export.node_roles(_found(spark, d, "path3")[2], 3)


_AROUND = f"{_ROLES}, mv AS (SELECT DISTINCT id FROM r), sel AS (SELECT id FROM mv UNION SELECT e.dst FROM e JOIN mv ON mv.id = e.src), used AS (SELECT a, b, count(*) AS n FROM (SELECT least(q0, q1) AS a, greatest(q0, q1) AS b FROM m UNION ALL SELECT least(q1, q2), greatest(q1, q2) FROM m) t GROUP BY a, b)"


@_query("export_edge_kinds", f"{_AROUND} SELECT und.a AS source, und.b AS target, coalesce(n, 0) AS match_edge_count, (1 + coalesce(n, 0))::DOUBLE AS weight, CAST((x.id IS NOT NULL)::INT + (y.id IS NOT NULL)::INT AS INTEGER) AS matched_endpoint_count, CASE WHEN n > 0 THEN 'matched_query_edge' WHEN x.id IS NOT NULL OR y.id IS NOT NULL THEN 'context_incident_edge' ELSE 'context_edge' END AS edge_kind FROM und JOIN sel s ON s.id = und.a JOIN sel t ON t.id = und.b LEFT JOIN used ON used.a = und.a AND used.b = und.b LEFT JOIN mv x ON x.id = und.a LEFT JOIN mv y ON y.id = und.b")
def _edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    g, q, found = _found(spark, d, "path3")
    return export.neighbourhood(g, found, q)[1].select("source", "target", "match_edge_count", "weight", "matched_endpoint_count", "edge_kind")


@_query("export_node_kinds", f"{_AROUND} SELECT sel.id, CASE WHEN mv.id IS NULL THEN 'context_vertex' ELSE 'matched_vertex' END AS node_kind, mv.id IS NOT NULL AS is_matched_vertex FROM sel LEFT JOIN mv ON mv.id = sel.id")
def _node_kinds(spark: SparkSession, d: str) -> DataFrame:
    g, q, found = _found(spark, d, "path3")
    return export.neighbourhood(g, found, q)[0].select("id", "node_kind", "is_matched_vertex")
