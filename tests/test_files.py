import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text as txt
from lodegraph.operators import cases, export, match
from lodegraph.operators.graph import Graph, undirected
from lodegraph.plans.query import Query
from lodegraph.sources import files
from lodegraph.streaming import matches as streaming


@pytest.fixture(scope="module")
def graph(spark):
    x = [[1.0, 0.0], [0.9, 0.1], [0.8, 0.2], [0.1, 0.9], [0.95, 0.05], [0.0, 1.0]]
    v = spark.createDataFrame([(i, p) for i, p in enumerate(x)], "id int, x array<double>")
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (1, 4), (4, 2), (3, 5)], "src int, dst int")
    return Graph(v, undirected(e))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_lines_are_split_once(spark, graph, tmp_path):
    """Each reader of the edges split all lines again."""
    v, e = f"{tmp_path}/v", f"{tmp_path}/e"
    files.write_graph(graph, v, e)
    plan = files.read_graph(spark, v, e, normalize=False).edges._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("Relation") == 1


def test_graph_files_of_many_parts(spark, graph, tmp_path):
    v, e = f"{tmp_path}/v", f"{tmp_path}/e"
    files.write_graph(Graph(graph.vertices.repartition(3), graph.edges.repartition(3)), v, e)
    again = files.read_graph(spark, v, e, normalize=False)
    assert rows(again.edges) == rows(graph.edges)
    assert [(i, [round(z, 6) for z in x]) for i, x in rows(again.vertices)] == [(i, [round(z, 6) for z in x]) for i, x in rows(graph.vertices)]
    assert all(line.split(",")[0] < line.split(",")[1] for line in (r["value"] for r in spark.read.text(e).collect()) if line != "src,dst")
    (tmp_path / "one.csv").write_text("id,a,b\r\n0,1.5,\r\n\n3,2,x\n")
    with pytest.raises(Exception):
        files.read_vertices(spark, f"{tmp_path}/one.csv").collect()
    (tmp_path / "gap.csv").write_text("id,a,b\r\n0,1.5,\r\n\n2,2,3\n2,4,5\nlone\n")
    assert rows(files.read_vertices(spark, f"{tmp_path}/gap.csv")) == [(0, [1.5, 0.0]), (1, [0.0, 0.0]), (2, [4.0, 5.0])]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        files.read_vertices(spark, f"{tmp_path}/empty.csv")


def test_resolve_query(spark, graph, tmp_path):
    prefix = f"{tmp_path}/{files.query_prefix('data/some/vertices.csv', 3, 5)}"
    assert prefix.endswith("query/some/q_k3_seed5")
    with pytest.raises(FileNotFoundError):
        files.resolve_query(graph, prefix, 3, 5, sample=False)
    first, sampled = files.resolve_query(graph, prefix, 3, 5)
    again, more = files.resolve_query(graph, prefix, 3, 5, normalize=False)
    assert sampled and not more and again.edges == first.edges
    assert all(abs(a - b) < 1e-6 for x, y in zip(first.vectors, again.vectors, strict=True) for a, b in zip(x, y, strict=True))
    os.rename(f"{prefix}_edges.csv", f"{prefix}_gone.csv")
    with pytest.raises(ValueError):
        files.resolve_query(graph, prefix, 3, 5)


def test_paths(spark, tmp_path):
    assert files.output_path("", "m.txt") == files.output_path(None, "m.txt") == "m.txt"
    assert files.output_path("out/", "m.txt") == "out/m.txt" and files.output_path("out", "m.txt") == "out"
    assert files.output_path("out", "m.txt", dotless=True) == "out/m.txt" and files.output_path("a.b", "m.txt", dotless=True) == "a.b"
    assert files.output_path(str(tmp_path), "m.txt", spark) == f"{tmp_path}/m.txt" and files.output_path(f"{tmp_path}/x", "m.txt", spark) == f"{tmp_path}/x"
    assert files.scores_path("out/m.txt", "given.csv", "s.csv") == "given.csv"
    assert files.scores_path("", None, "s.csv") == "s.csv" and files.scores_path("out/", None, "s.csv") == "out/s.csv"
    assert files.scores_path("out/m.txt", None, "s.csv") == "out/s.csv" and files.scores_path("out/m.txt", None, "s.csv", by_stem=True) == "out/m_scores.csv"
    assert files.scores_path("out", None, "s.csv", dotless=True, by_stem=True) == "out/s.csv"
    assert files.scores_path(str(tmp_path), None, "s.csv", spark) == f"{tmp_path}/s.csv"


def test_query_file(spark, graph, tmp_path):
    q = graph.query_of([2, 1, 0])
    files.write_query(q, f"{tmp_path}/q.json", spark, {"q1": "text"})
    assert files.read_query(graph, f"{tmp_path}/q.json") == q
    files.write_query(Query(q.vectors, q.edges, [2, 1, 77]), f"{tmp_path}/lost.json", spark)
    with pytest.raises(ValueError):
        files.read_query(graph, f"{tmp_path}/lost.json")


def test_papers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,title,abstract,area,when\n1,"A, b",text  here,x,1999\n2,,"only ""this""",,\n3,c,,y,2001\n')
    got = files.read_papers(spark, f"{tmp_path}/p.csv", label_col="area", year_col="when")
    assert rows(got) == [("1", "A, b", "A, b. text here", "x", "1999"), ("2", "", '. only "this"', "nan", "nan"), ("3", "c", "c.", "y", "2001")]
    assert files.read_papers(spark, f"{tmp_path}/p.csv", text_cols=["abstract"], label_col="none").columns == ["id", "title", "text"]
    for bad in ({"id_col": "no"}, {"text_cols": ["no"]}):
        with pytest.raises(ValueError):
            files.read_papers(spark, f"{tmp_path}/p.csv", **bad)
    (tmp_path / "e.csv").write_text("from,to,x\n1,2,a\n2,9,b\n3,3,c\n")
    edges = files.read_paper_edges(spark, f"{tmp_path}/e.csv", "from", "to")
    assert rows(edges) == [("1", "2"), ("2", "9"), ("3", "3")] and rows(files.read_citations(got, edges)) == [("1", "2")]
    with pytest.raises(ValueError):
        files.read_paper_edges(spark, f"{tmp_path}/e.csv")
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write('10\tA "title\tSome  text\n11\tOnly title\n12\ta\tb\tc\n')
    texts = files.read_title_abstracts(spark, f"{tmp_path}/t.tsv.gz")
    assert rows(texts.fillna("")) == [("10", 'A "title', "Some  text"), ("11", "Only title", "")]
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "node long, label string")
    held = files.looked_up(nodes, spark.createDataFrame([(0, 10), (1, 11), (3, 99)], "node long, paper_id long"), texts)
    assert rows(held) == [(0, "a", "10", 'A "title', 'A "title. Some text'), (1, "b", "11", "Only title", "Only title"), (3, "c", "99", "", "")]
    papers, e = files.paper_graph(held, spark.createDataFrame([(0, 1), (1, 1), (1, 3), (1, 0)], "src long, dst long"), 2)
    assert [(r["node"], r["idx"]) for r in papers.orderBy("idx").collect()] == [(0, 0), (1, 1)] and rows(e) == [(0, 1), (1, 0)]
    assert rows(files.selected(nodes, 0, ["a"])) == rows(nodes) == rows(files.selected(nodes, 4, ["a"]))
    assert rows(files.selected(nodes, 3, ["a"])) == [(0, "a"), (2, "a")] and files.selected(nodes, 1).count() == 1
    assert rows(files.selected(nodes, 2, seed=1)) == rows(files.selected(nodes, 2, seed=1))


def test_match_files(spark, graph, tmp_path):
    q = graph.query_of([0, 1, 2], [(0, 1), (1, 2)])
    found = match.match(graph, q, 0.5, scores=True)
    papers = spark.createDataFrame([(0, "t0", "x", "1"), (1, "t1", "y", "2")], "id int, title string, label string, year string")
    out = files.write_all_matches(found, 3, f"{tmp_path}/m.csv", f"{tmp_path}/m.jsonl", papers, [0, 1, 2])
    told = out.orderBy("match_id").collect()
    assert [r["match_id"] for r in told] == list(range(1, len(told) + 1)) and sum(r["is_ground_truth"] for r in told) == 1
    assert out.columns == ["match_id", "min_similarity", "sum_similarity", "is_ground_truth", *[f"q{u}_{c}" for u in (1, 2, 3) for c in ("node_id", "similarity", "label", "year", "title")]]
    assert all(r["q1_title"] == {0: "t0", 1: "t1"}.get(r["q1_node_id"]) for r in told)
    assert len(spark.read.json(f"{tmp_path}/m.jsonl").columns) == len(out.columns) and spark.read.csv(f"{tmp_path}/m.csv", header=True).count() == len(told)
    nodes = files.read_match_nodes(spark, f"{tmp_path}/m.csv")
    wide = files.mappings(nodes)
    assert sorted((int(r["match_id"]), int(r["q0"]), int(r["q1"]), int(r["q2"])) for r in wide.collect()) == [(r["match_id"], r["q1_node_id"], r["q2_node_id"], r["q3_node_id"]) for r in told]
    ids = spark.createDataFrame([(k, 10 * k) for k in range(6)], "id int, idx int")
    assert {(int(r["match_id"]), r["qid"]): r["idx"] for r in files.renamed_matches(nodes, ids).collect()}[1, "q1"] == 10 * told[0]["q1_node_id"]
    with pytest.raises(ValueError):
        files.renamed_matches(nodes, ids.where("id <> 1"))
    files.write_matches(found, 3, f"{tmp_path}/lines")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/lines").collect()) == sorted(f"{r['q1_node_id']} {r['q2_node_id']} {r['q3_node_id']}" for r in told)
    ranked = spark.createDataFrame([(1, 0.5, 3, 4), (2, 0.4, -1, 4)], "rank int, loss double, q0 long, q1 long")
    files.write_ranked(ranked, f"{tmp_path}/scores", f"{tmp_path}/full")
    assert spark.read.csv(f"{tmp_path}/scores", header=True).count() == 2 and [r["value"] for r in spark.read.text(f"{tmp_path}/full").collect()] == ["3 4"]
    a, b = match.representatives(found, 3, [0, 1, 2])
    around, edges = export.neighbourhood(graph, found, q, 1, highlight={n: m for n, m in (("A", a), ("B", b)) if m})
    papers = papers.withColumn("text", F.lit("some text"))
    done = files.write_neighbourhood(around, edges, f"{tmp_path}/nodes", f"{tmp_path}/edges", papers)
    n = spark.read.csv(f"{tmp_path}/nodes", header=True, escape='"').collect()
    assert done["nodes"] == len(n) and n[0].asDict().keys() == {"Id", "Label", "node_kind", "is_matched_vertex", "match_count", "query_roles", "highlight", "metadata", "title", "text", "support_match_ids"}
    assert {r["Id"]: (r["Label"], r["metadata"]) for r in n}["0"] == ("t0", "label=x; year=1") and {r["Id"]: r["Label"] for r in n}["3"] == "3"
    assert done["edges"] == spark.read.csv(f"{tmp_path}/edges", header=True).count() == edges.count()
    assert files.write_neighbourhood(around, edges, f"{tmp_path}/nodes2", f"{tmp_path}/edges2")["matched_vertices"] == done["matched_vertices"]
    case = cases.run_query(graph, q, 0.5)
    files.write_attempts([case.record, case.record], f"{tmp_path}/log", spark)
    assert [json.loads(r["value"])["match_count"] for r in spark.read.text(f"{tmp_path}/log").collect()] == [case.record["match_count"]] * 2
    files.write_report(*cases.report(case), f"{tmp_path}/report", spark)
    assert json.loads("".join(r["value"] for r in spark.read.text(f"{tmp_path}/report/case_study.json").collect()))["match_count"] == case.record["match_count"]


def test_text_functions(spark):
    d = spark.createDataFrame([(" TRUE ", "a " * 200, 1, 2), ("no", None, 5, 3), (None, "short", 1, 1)], "b string, t string, x int, y int")
    got = d.select(txt.parsed_bool("b").alias("b"), txt.truncated("t", 20).alias("t"), *txt.edge_key(F.col("x"), F.col("y"))).collect()
    assert [r["b"] for r in got] == [True, False, False] and [r["t"] for r in got] == ["a a a a a a a a a...", "", "short"] and [(r["a"], r["b"]) for r in d.select(*txt.edge_key(F.col("x"), F.col("y"))).collect()] == [(1, 2), (3, 5), (1, 1)]


def test_stream_of_vertices(spark, graph, tmp_path):
    q = graph.query_of([0, 3], [])
    graph.vertices.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(graph.vertices.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.append_candidates(stream, q, 0.5, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("u", "v")) == rows(match.candidates(graph, q, 0.5).select("u", "v"))
