"""What each stage keeps, row by row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodegraph.llm import bpe, decontaminate, pii, simhash

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    where = str(tmp_path_factory.mktemp("tables"))
    items = [words(r, 30) for _ in range(5)]
    rows = [(k, words(r, 40) + (" horrid vile" * 3 if k % 6 == 0 else ""), "en", f"s{k % 3}", 1) for k in range(120)]
    rows += [(200 + k, f"{words(r, 20)} {t} {words(r, 20)}", "en", "s", 2) for k, t in enumerate(items)]
    rows += [(300, rows[1][1], "en", "s", 3), (301, rows[1][1] + " more", None, None, None), (302, "mail bob@x.com now please", "en", "s", 25)]
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (None, words(r, 30), "en", "s", 9), (None, rows[2][1], "en", "s", 9), (402, "x " * 60_000, "en", "s", 9)]
    rows += [rows[3], rows[3], (3, rows[3][1], "de", "t", 5), (403, words(r, 30), None, None, None), (403, words(r, 30), "en", "s", 1)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, None), (9, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(k, 1, int(k % 6 == 0)) for k in range(120)] + [(None, 0, 1), (7, None, None), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, [tuple(x) for x in rows]


def told(df):
    assert df.columns == cp.COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage(spark, tables):
    where, rows = tables
    d = spark.read.parquet(f"{where}/documents.parquet").withColumns({"_key": F.lit(1), "score": F.lit(2), "n": F.lit(3), "_items": F.lit(4), "spans": F.lit(5), "id": F.lit(6)})
    # Toxic texts go; all others stay, repeated rows and null ids too.
    assert told(cp.drop_toxic(spark, d, where)) == sorted([x for x in rows if "horrid" not in (x[1] or "")], key=str)
    # Items' texts go.
    assert told(cp.drop_contaminated(spark, d, where)) == sorted([x for x in rows if not 200 <= (x[0] or 0) < 300], key=str)
    # Personal data goes, and its text's length follows.
    out = told(cp.redact_personal_data(spark, d, where))
    assert len(out) == len(rows) and [x for x in out if x[0] == 302] == [(302, "mail <EMAIL> now please", "en", "s", 23)]
    assert [x for x in out if x[0] != 302] == sorted([x for x in rows if x[0] != 302], key=str)
    ids = cp.tokenize(spark, d, where).collect()
    assert sorted(str(x["doc_id"]) for x in ids) == sorted(str(x[0]) for x in rows)


def test_near_duplicates(spark, tables):
    where, rows = tables
    sets = [frozenset(simhash.shingle_hashes(x[1] or "", 5).tolist()) for x in rows]
    group = list(range(len(rows)))
    for _ in range(4):
        for a in range(len(rows)):
            for b in range(a):
                if (rows[a][1] or "") == (rows[b][1] or "") or len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b])):
                    group[a] = group[b] = min(group[a], group[b])
    out = told(cp.drop_near_duplicates(spark, spark.read.parquet(f"{where}/documents.parquet"), where))
    assert len(out) == len(set(group))
    kept = {g: [x for x in out if x in [rows[k] for k in range(len(rows)) if group[k] == g]] for g in group}
    for g, mine in kept.items():
        own = [rows[k][0] for k in range(len(rows)) if group[k] == g]
        assert len(mine) == 1 and mine[0][0] == min((i for i in own if i is not None), default=None)


def test_empty_tables_and_whole_run(spark, tables, tmp_path):
    where, rows = tables
    none = spark.createDataFrame([], KIND)
    for _, stage in cp.STAGES:
        assert stage(spark, none, where).count() == 0
    out = cp.run(spark, where).collect()
    text = {x["doc_id"]: x["decoded"] for x in out}
    plain = bpe.pieces(bpe.default_path())
    assert 6 not in text and 200 not in text and 300 not in text and 301 not in text and 302 in text and 1 in text
    assert text[2] == bpe.encoded(rows[2][1], plain)[1] and sum(x["doc_id"] == 3 for x in out) == 1
    for name in ("labels", "benchmark"):  # without these all documents stay
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    d = spark.read.parquet(f"{where}/documents.parquet")
    assert cp.drop_toxic(spark, d, f"{tmp_path}/none").count() == cp.drop_contaminated(spark, d, f"{tmp_path}/none").count() == len(rows)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.Index([]).found(["a"]) == [[]] and pii.train({})[1] == 0
