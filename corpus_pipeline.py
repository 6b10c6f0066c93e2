"""A training-corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last keep the
columns of documents. Every stage reads these columns only, so further ones of
any name do no harm; an empty table leaves an empty table; a null text counts
as empty; and but for the near-duplicate stage, which says what it does, rows
that repeat, or have no id, are rows like any other and keep their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import bpe, common, decontaminate, pii, simhash, toxicity
from lodegraph.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; without any label all score 0.5 and would go, so then all stay."""
    ship(spark)
    labels = toxicity.training_labels(common.table(spark, sf_dir, "labels"))
    index = toxicity.fit(docs, labels)
    if not index.n_examples:
        return docs.select(*COLUMNS)
    scored = docs.select(*COLUMNS, toxicity.scores(index, spark, F.col("text")).alias("_score"))
    return scored.where(F.col("_score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are alike (five-word shingles, similarity 0.8 or more), one row: that of least id, null ids last.

    Rows of one id come by the text's SHA-256, then lang, source and n_chars;
    of rows equal in all columns one stays. A null text counts as empty, and
    texts without words are alike.
    """
    ship(spark)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "lang", "source", "n_chars")
    rows = docs.select(*COLUMNS, key.alias("_key"))
    found = simhash.similar(rows, "_key")
    kept = common.materialize(found.where(F.col("key") == F.col("component")).select(F.xxhash64("key").alias("_hash"), F.col("key").alias("_kept"), "n"))
    # Equality without nulls: null parts of a key are equal here.
    rows = rows.withColumn("_hash", F.xxhash64("_key")).join(kept, "_hash").where(F.col("_key").eqNullSafe(F.col("_kept")))
    once = rows.where(F.col("n") == 1).select(*COLUMNS)
    return once.unionByName(rows.where(F.col("n") > 1).dropDuplicates(["_hash", "_key"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; an empty benchmark leaves all."""
    ship(spark)
    found = decontaminate.marked(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"), "_items")
    return found.where(F.size("_items") == 0).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks; n_chars follows the text where it changed. Null texts stay null."""
    found = pii.detect(docs.select(*COLUMNS), spans_col="_spans")
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("_spans")))
    return found.withColumn("_text", text).select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(F.size("_spans") > 0, F.length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they stand for, a row for each row."""
    ship(spark)
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]
#: Learned scores, hashes and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = common.materialize(docs)
    return docs
