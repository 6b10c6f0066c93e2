"""Readers and writers of graphs, queries, papers and results."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, truncated
from ..operators.graph import Graph
from ..operators.match import numbered
from ..plans.query import Query
from ..session import written


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of the lines after each file's header; lines without a second field are left out, carriage returns dropped."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), F.input_file_name().alias("file"))
    heads = raw.groupBy("file").agg(F.min("n").alias("head"))  # a row for each file
    if not heads.limit(1).count():
        raise ValueError(f"{path} is empty")
    fields = F.split(F.regexp_replace("value", "\r", ""), ",", -1)
    # Lines that are left out have no fields, wherever the optimizer moves what reads them.
    kept = (F.col("n") > F.col("head")) & (fields[0] != "") & (F.size(fields) >= 2)
    return raw.join(F.broadcast(heads), "file").select("n", F.when(kept, fields).alias("f")).where(F.col("f").isNotNull())


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) from id,f0,f1,...; empty cells are 0, gaps in the ids zero vectors, the last of equal ids stays; ragged rows raise."""
    rows = _lines(spark, path).select("n", F.col("f")[0].cast("int").alias("id"), F.transform(F.expr("slice(f, 2, size(f) - 1)"), lambda c: F.when(F.trim(c) == "", F.lit(0.0)).otherwise(c.cast("float")).cast("float")).alias("x"))
    shape = rows.agg(F.max("id").alias("top"), F.min("id").alias("low"), F.max_by(F.size("x"), -F.col("n")).alias("dim"), F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if shape["top"] is None:
        raise ValueError(f"{path} has no vertices")
    if shape["a"] != shape["b"]:
        raise ValueError(f"{path} has rows of {shape['a']} and of {shape['b']} values")
    if shape["low"] < 0:
        raise ValueError(f"{path} has a negative id")
    last = rows.groupBy("id").agg(F.max_by("x", "n").alias("x"))
    every = spark.range(shape["top"] + 1).select(F.col("id").cast("int").alias("id"))
    return every.join(last, "id", "left").select("id", F.coalesce("x", F.array_repeat(F.lit(0.0).cast("float"), shape["dim"])).alias("x"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from the first two fields."""
    return _lines(spark, path).select(F.col("f")[0].cast("int").alias("src"), F.col("f")[1].cast("int").alias("dst"))


def read_graph(spark: SparkSession, vertices: str, edges: str, normalize: bool = True) -> Graph:
    """The lines of edges are split once; as vertices have every id from 0 to the last, the ends' extremes tell whether an edge names another."""
    v, e = read_vertices(spark, vertices), written(read_edges(spark, edges))
    ends = e.agg(F.least(F.min("src"), F.min("dst")).alias("low"), F.greatest(F.max("src"), F.max("dst")).alias("top"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("none")).first()
    if ends["none"] or ends["top"] is not None and (ends["low"] < 0 or ends["top"] > v.agg(F.max("id")).first()[0]):
        raise ValueError("an edge names a vertex that does not exist")
    return Graph.of(v, e, normalize, check=False)


def write_graph(graph: Graph, vertices: str, edges: str) -> None:
    """id,f0,... with 9 significant digits, and each edge once with src < dst."""
    dim = graph.vertices.select(F.size("x")).first()[0]
    number = lambda c: F.format_string("%.9g", c.cast("double"))
    graph.vertices.select("id", *[number(F.col("x")[k]).alias(f"f{k}") for k in range(dim)]).write.mode("overwrite").csv(vertices, header=True)
    graph.edges.where("src < dst").write.mode("overwrite").csv(edges, header=True)


def query_prefix(graph_path: str, k: int, seed: int) -> str:
    """query/<folder of the graph>/q_k<k>_seed<seed>."""
    parts = [p for p in graph_path.rstrip("/").split("/") if p]
    return f"query/{parts[-2] if len(parts) > 1 else 'graph'}/q_k{k}_seed{seed}"


def _exists(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether something is at the path, and whether it is a folder, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at), fs.exists(at) and fs.getFileStatus(at).isDirectory()


def resolve_query(graph: Graph, prefix: str, k: int, seed: int = 42, sample: bool = True, normalize: bool = True) -> tuple[Query, bool]:
    """(query, whether it was sampled): read from <prefix>_vertices.csv and <prefix>_edges.csv if both are there; an error if only one is;
    else sampled by its seed and saved there, or an error unless ``sample``."""
    spark = graph.vertices.sparkSession
    paths = [f"{prefix}_vertices.csv", f"{prefix}_edges.csv"]
    there = [_exists(spark, p)[0] for p in paths]
    if any(there) and not all(there):
        raise ValueError(f"of the query {prefix}, only {paths[there.index(True)]} exists")
    if all(there):
        own = read_graph(spark, *paths, normalize)
        rows = {r["id"]: [float(e) for e in r["x"]] for r in own.vertices.collect()}
        return Query([rows[i] for i in sorted(rows)], [(r["src"], r["dst"]) for r in own.edges.where("src < dst").collect()]), False
    if not sample:
        raise FileNotFoundError(f"there is no query {prefix}")
    query = graph.sample_ball_query(k, seed)
    kind = "id int, x array<float>"
    edges = spark.createDataFrame([(a, b) for a, b in query.edges], "src int, dst int")
    own = Graph(spark.createDataFrame([(n, x) for n, x in enumerate(query.vectors)], kind), edges.unionAll(edges.select("dst", "src")))
    write_graph(own, *paths)
    return query, True


def output_path(path: str | None, name: str, spark: SparkSession | None = None, dotless: bool = False) -> str:
    """Where a result goes: ``name`` if no path is given, or in the path if that is a folder, else the path itself.

    A folder ends with a slash (or backslash), is there already (if a session is
    given to look), or, where ``dotless``, has no dot in its path.
    """
    if not path:
        return name
    if path[-1] in "/\\":
        return path + name
    if dotless and "." not in path or spark is not None and _exists(spark, path)[1]:
        return f"{path}/{name}"
    return path


def scores_path(path: str | None, given: str | None, name: str, spark: SparkSession | None = None, dotless: bool = False, by_stem: bool = False) -> str:
    """Where the scores of a result go: as given, ``name`` in the result's folder, or, by its stem, <stem>_scores.csv beside it."""
    if given:
        return given
    at = output_path(path, "", spark, dotless)
    if not path or at != path or path[-1] in "/\\":
        return at + name
    if by_stem:
        stem, dot, _ = path.rpartition(".")
        return (stem if dot else path) + "_scores.csv"
    return path[: max(path.rfind("/"), path.rfind("\\")) + 1] + name


def write_matches(found: DataFrame, k: int, path: str) -> None:
    """One mapping a line, ids joined by spaces."""
    found.select(F.concat_ws(" ", *[F.col(f"q{u}").cast("string") for u in range(k)])).write.mode("overwrite").text(path)


def write_ranked(rows: DataFrame, scores: str, matches: str | None = None) -> None:
    """The score table as CSV; complete mappings as lines, by rank."""
    rows.orderBy("rank").coalesce(1).write.mode("overwrite").csv(scores, header=True)
    if matches:
        names = [c for c in rows.columns if c[0] == "q" and c[1:].isdigit()]
        full = rows.where(F.forall(F.array(*names), lambda v: v >= 0)).orderBy("rank")
        write_matches(full, len(names), matches)


def match_rows(found: DataFrame, k: int, papers: DataFrame | None = None, truth: Sequence[int] | None = None) -> DataFrame:
    """match_id (1, 2, ... by mapping), min and sum of cosines, whether it is the truth, and for each query vertex its node, cosine and
    (as far as papers (id, title, and label or year) have them) label, year and title."""
    names = [f"q{u}" for u in range(k)]
    out = numbered(found, names)
    for u in range(k) if papers is not None else ():
        held = [c for c in ("label", "year", "title") if c in papers.columns]
        out = out.join(papers.select(F.col("id").alias(f"q{u}"), *[F.col(c).alias(f"{c}{u}") for c in held]), f"q{u}", "left")
    told = []
    for u in range(k):
        told += [F.col(f"q{u}").alias(f"q{u + 1}_node_id"), F.col(f"s{u}").alias(f"q{u + 1}_similarity")]
        told += [F.col(f"{c}{u}").alias(f"q{u + 1}_{c}") for c in ("label", "year", "title") if papers is not None and c in papers.columns]
    low = F.least(*[F.col(f"s{u}") for u in range(k)]) if k > 1 else F.col("s0")
    total = sum((F.col(f"s{u}") for u in range(1, k)), F.col("s0"))
    same = reduce(lambda a, b: a & b, [F.col(q) == t for q, t in zip(names, truth, strict=True)]) if truth else F.lit(False)
    return out.select("match_id", low.alias("min_similarity"), total.alias("sum_similarity"), same.alias("is_ground_truth"), *told)


def write_all_matches(found: DataFrame, k: int, csv: str | None = None, json_lines: str | None = None, papers: DataFrame | None = None, truth: Sequence[int] | None = None) -> DataFrame:
    """The rows of ``match_rows``, written once and then as CSV, as JSON lines, or as both."""
    out = written(match_rows(found, k, papers, truth))
    if csv:
        out.write.mode("overwrite").csv(csv, header=True)
    if json_lines:
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(json_lines)
    return out


def read_match_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, qid, node) from a match CSV; query columns are those named <qid>_node_id."""
    df = spark.read.csv(path, header=True)
    qids = sorted((c[:-8] for c in df.columns if c.endswith("_node_id")), key=lambda q: (len(q), q))
    return df.select("match_id", F.explode(F.array(*[F.struct(F.lit(q).alias("qid"), F.col(f"{q}_node_id").alias("node")) for q in qids])).alias("x")).select("match_id", "x.qid", "x.node")


def read_papers(spark: SparkSession, path: str, id_col: str = "id", text_cols: Sequence[str] | None = None, label_col: str | None = None, year_col: str | None = None) -> DataFrame:
    """(id, title, text, and label and year where named and present), all strings, from CSV with a header.

    text: the text columns joined by '. ', cleaned; without names, "text", or those
    of title, abstract, keywords and description that are there. Papers without a
    title column are titled by the start of their text.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if id_col not in df.columns:
        raise ValueError(f"{path} has no column {id_col}")
    if text_cols is None:
        text_cols = ["text"] if "text" in df.columns else [c for c in ("title", "abstract", "keywords", "description") if c in df.columns]
    if not text_cols or any(c not in df.columns for c in text_cols):
        raise ValueError(f"{path} lacks text columns ({', '.join(text_cols) or 'none known'})")
    text = clean(F.concat_ws(". ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))
    title = clean(F.col("title")) if "title" in df.columns else truncated(text, 90)
    more = [F.coalesce(F.col(c), F.lit("nan")).alias(n) for n, c in (("label", label_col), ("year", year_col)) if c and c in df.columns]
    return df.select(F.col(id_col).alias("id"), title.alias("title"), text.alias("text"), *more)


def read_paper_edges(spark: SparkSession, path: str, src_col: str = "src", dst_col: str = "dst") -> DataFrame:
    """(src, dst), strings, from CSV with a header."""
    df = spark.read.csv(path, header=True)
    if src_col not in df.columns or dst_col not in df.columns:
        raise ValueError(f"{path} lacks the columns {src_col} and {dst_col}")
    return df.select(F.col(src_col).alias("src"), F.col(dst_col).alias("dst"))


def looked_up(nodes: DataFrame, papers: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label, id, title, text): nodes (node, label) with their paper (node, paper_id) and its title and text (paper_id, title, abstract); nodes without a paper go, papers without a text have an empty one."""
    held = nodes.join(papers.select("node", F.col("paper_id").cast("string").alias("id")), "node")
    known = texts.groupBy(F.col("paper_id").cast("string").alias("id")).agg(F.min(F.struct(clean("title").alias("title"), clean(F.concat_ws(". ", "title", "abstract")).alias("text"))).alias("t"))
    return held.join(known, "id", "left").select("node", "label", "id", F.coalesce("t.title", F.lit("")).alias("title"), F.coalesce("t.text", F.lit("")).alias("text"))


def selected(nodes: DataFrame, max_nodes: int = 0, labels: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """nodes (node, label, ...), at most ``max_nodes`` if that is less than there are: of the given labels, by a seeded order."""
    if not max_nodes or nodes.count() <= max_nodes:
        return nodes  # the labels count only where nodes are left out
    pool = nodes.where(F.col("label").cast("string").isin(*labels)) if labels else nodes
    return pool.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("node").cast("string")).cast("binary")), "node").limit(max_nodes)


def paper_graph(nodes: DataFrame, edges: DataFrame, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(papers, edges): nodes (node, label, id, title, text) with enough words, renumbered 0, 1, ... by node as ``idx``, and edges between them (src, dst)."""
    enough = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least_words
    papers = written(numbered(nodes.where(enough), ["node", "id"], "idx").withColumn("idx", F.col("idx") - 1))
    at = papers.select("node", "idx")
    e = edges.where("src <> dst").join(at.select(F.col("node").alias("src"), F.col("idx").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("idx").alias("b")), "dst")
    return papers, e.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def renamed_matches(matches: DataFrame, papers: DataFrame) -> DataFrame:
    """(match_id, qid, idx): match nodes (match_id, qid, node) by the papers' (id, idx); nodes that no paper has raise."""
    lost = matches.join(papers.select(F.col("id").cast("string").alias("node")), "node", "left_anti").select("match_id", "node").orderBy("match_id", "node").limit(5).collect()
    if lost:
        raise ValueError(f"match {lost[0]['match_id']} holds nodes that the graph lacks: {[r['node'] for r in lost]}")
    return matches.join(papers.select(F.col("id").cast("string").alias("node"), "idx"), "node").select("match_id", "qid", "idx")


def mappings(nodes: DataFrame, value: str = "node") -> DataFrame:
    """Matches (match_id, q0, q1, ...) from (match_id, qid, value); the query vertices in the order of their numbers."""
    qids = sorted((r["qid"] for r in nodes.select("qid").distinct().collect()), key=lambda q: (len(q), q))  # a query's vertices
    wide = nodes.groupBy("match_id").pivot("qid", qids).agg(F.first(value))
    return wide.select("match_id", *[F.col(q).alias(f"q{n}") for n, q in enumerate(qids)])


def write_neighbourhood(nodes: DataFrame, edges: DataFrame, nodes_path: str, edges_path: str, papers: DataFrame | None = None) -> dict:
    """Node and edge tables as CSV for graph viewers; papers (id, title, text, and label or year) name the nodes. Returns how many of each there are."""
    out = nodes.withColumn("match_flag", F.col("is_matched_vertex").cast("int"))
    if papers is None:
        out = out.withColumns({"title": F.lit(""), "text": F.lit(""), "metadata": F.lit("")})
    else:
        meta = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in ("label", "year") if c in papers.columns])
        out = out.join(papers.select("id", "title", "text", meta.alias("metadata")), "id", "left")
    label = F.coalesce(F.nullif(truncated("title", 80), F.lit("")), F.col("id").cast("string"))
    out = written(out.select(F.col("id").alias("Id"), label.alias("Label"), "node_kind", F.col("match_flag").alias("is_matched_vertex"), "match_count", "query_roles", "highlight", F.coalesce("metadata", F.lit("")).alias("metadata"), F.coalesce("title", F.lit("")).alias("title"), truncated("text", 500).alias("text"), "support_match_ids"))
    told = written(edges.select(F.col("source").alias("Source"), F.col("target").alias("Target"), F.col("type").alias("Type"), F.col("weight").alias("Weight"), "edge_kind", "matched_endpoint_count", "match_edge_count", "highlight", "support_match_ids"))
    out.write.mode("overwrite").csv(nodes_path, header=True)
    told.write.mode("overwrite").csv(edges_path, header=True)
    return {"nodes": out.count(), "matched_vertices": out.where("is_matched_vertex = 1").count(), "edges": told.count(), "node_csv": nodes_path, "edge_csv": edges_path}


def write_attempts(log: Sequence[dict], path: str, spark: SparkSession) -> None:
    """One attempt of a case search a line, as JSON."""
    spark.createDataFrame([(json.dumps(r),) for r in log], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(markdown: str, values: dict, folder: str, spark: SparkSession, name: str = "case_study") -> None:
    """<folder>/<name>.md and <folder>/<name>.json."""
    for kind, text in (("md", markdown), ("json", json.dumps(values, indent=2, ensure_ascii=False))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/{name}.{kind}")


def read_title_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, title, abstract) from TSV without header or quoting, plain or gzip; lines with more fields are skipped."""
    f = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.size(f) <= 3).select(f[0].alias("paper_id"), F.get(f, 1).alias("title"), F.get(f, 2).alias("abstract"))


def read_citations(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Citations (src, dst) with both ends known and no self-loops."""
    ids = papers.select("id").distinct()
    known = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return known.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def write_query(query: Query, path: str, spark: SparkSession, texts: dict[str, str] | None = None) -> None:
    row = {"qids": [f"q{n + 1}" for n in range(query.size)], "source_node_ids": [str(s) for s in query.sources], "query_edges": [list(e) for e in query.edges], "query_texts": texts or {}}
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_query(graph: Graph, path: str) -> Query:
    spark = graph.vertices.sparkSession
    row = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    ids = [int(s) for s in row["source_node_ids"]]
    known = {r["id"] for r in graph.vertices.where(F.col("id").isin(ids)).select("id").collect()}
    if missing := sorted(set(ids) - known):
        raise ValueError(f"the query names vertices that do not exist: {missing}")
    return graph.query_of(ids, [tuple(e) for e in row["query_edges"]])
